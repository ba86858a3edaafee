"""Token ids as flat binary files with 64-bit document offsets, as a data source that is written and read by Spark.

A folder holds parts and ``manifest.json``. Part ``p`` is three files without headers, all little-endian:

- ``p.ids``: the ids of its documents one after the other, unsigned, of 2 or 4 bytes (``width``)
- ``p.offsets``: unsigned 64-bit; where each document starts in ``p.ids``, counted in ids, and last the number of ids
- ``p.docs``: the documents' ids, signed 64-bit; null ids are a part's last ``nulls`` documents

The manifest lists the parts in order with their sizes and, as prefix sums, the documents and ids before each: a
document's place in the whole is its part's base plus its offset. Parts are numbers a task, never a row's.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

END = 0
FORMAT = "token_files"
#: Words of which a worker remembers the ids; beyond, those not used since the last time are forgotten.
REMEMBERED = 300_000
#: Bytes of ids that one read task takes, and documents of one batch of it.
READ_BYTES, READ_ROWS = 64 << 20, 4096
#: Places before a space where the tokenizer always cuts: after other characters than white space, or where one space is left of a run.
_CUTS = re.compile(r"(?<!\s)(?= )|(?= \S)")
#: A space inside or at the end of a run of white space; every other one may be cut at.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: A space or none with letters, digits or ASCII marks, then ASCII marks: the tokenizer's rules cut such a stretch there alone.
_PLAIN = re.compile(r"( ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-/:-@\[-`{-~]+))([!-/:-@\[-`{-~]*)\Z")


# Encoding


class _Shown(dict):
    """How the tokenizer's model sees each character, by code point."""

    def __init__(self, rules) -> None:
        super().__init__()
        self.rules = rules

    def __missing__(self, point: int) -> str:
        self[point] = "".join(p for p, _ in self.rules.pre_tokenize_str(chr(point)))
        return self[point]


class ChunkIds(dict):
    """Ids, as little-endian bytes, of a space with the stretch of text behind it; an unknown one is encoded when looked up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{id_width(path)}")
        self.pack = {2: "H", 4: "I"}[self.kind.itemsize]
        # Packers of up to 15 ids, made once: most stretches have few.
        self.packers = [struct.Struct(f"<{n}{self.pack}").pack for n in range(16)]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.shown = _Shown(self.tokenizer.pre_tokenizer)

    def __missing__(self, rest: str) -> bytes:
        ids = self.before.get(rest)
        if ids is None:
            plain = rest.isascii() and rest.isalpha()
            ids = self.part(" " + rest) if plain else self.chunk(" " + rest)
        self[rest] = ids
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.pack}", *ids)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch that ``encoded_bytes`` cut out: of its words and line breaks where it has nothing else."""
        plain = _PLAIN.match(chunk)
        if plain:
            word, marks = plain.groups()
            return self.part(word) + self.part(marks) if marks else self.part(word)
        found = b""
        for nth, line in enumerate(chunk.split("\n")):
            plain = _PLAIN.match(line)
            if plain is None or (nth and line[0] == " "):
                return self.whole(chunk)
            if nth:
                found += self.part("\n")
            word, marks = plain.groups()
            found += self.part(word)
            if marks:
                found += self.part(marks)
        return found

    def part(self, part: str) -> bytes:
        """Ids of what the tokenizer's rules never cut, by its model alone."""
        ids = self.parts.get(part)
        if ids is None:
            # Letters and digits are shown as they are, the space in front of them as one mark.
            plain = part.isascii() and part[1:].isalnum() and part[0] == " "
            shown = self.shown[32] + part[1:] if plain else part.translate(self.shown)
            found = [t.id for t in self.tokenizer.model.tokenize(shown)]
            pack = self.packers[len(found)] if len(found) < 16 else struct.Struct(f"<{len(found)}{self.pack}").pack
            ids = self.parts[part] = pack(*found)
        return ids

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()


_loaded: dict[str, ChunkIds] = {}


def id_width(path: str) -> int:
    """Bytes an id takes: 2 for vocabularies of up to 65,536 ids, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def encoded_bytes(text: str, path: str) -> bytes:
    """Ids of a whole text, little-endian and of ``id_width`` bytes, then id 0.

    A byte-level tokenizer of this kind cuts before a space that follows other characters, and before the last space
    of a run, whatever stands around; so the stretches between such places are encoded once and then remembered.
    Texts that hold a special token are encoded as they are.
    """
    if path not in _loaded:
        _loaded[path] = ChunkIds(path)
    known = _loaded[path]
    known.forget()
    if any(s in text for s in known.special):
        ids = known.whole(text)
    elif _RUN.search(text):
        ids = b"".join([known[c[1:]] if c[:1] == " " else known.whole(c) for c in _CUTS.split(text)])
    else:
        first, *rest = text.split(" ")
        ids = known.whole(first) + b"".join(map(known.__getitem__, rest))
    return ids + END.to_bytes(known.kind.itemsize, "little")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Columns ``doc_id`` (long), ``ids`` (binary) of every row, in the order of ``docs``; see ``encoded_bytes``.

    Null texts count as empty. Other columns are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array([encoded_bytes(t.as_py() or "", tokenizer) for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "doc_id long, ids binary")


# Files


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def _numbers(path: str, kind: str, first: int, count: int) -> np.ndarray:
    """``count`` numbers of a file: memory-mapped where the file system is mounted, else read as a range."""
    size = np.dtype(kind).itemsize
    if not count:
        return np.empty(0, kind)
    system, name = _opened(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, kind, "r", first * size, (count,))
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read_at(count * size, first * size), kind)


def manifest(path: str) -> dict | None:
    """What the folder holds; nothing if it was never written."""
    system, name = _opened(path)
    if system.get_file_info(f"{name}/manifest.json").type == fs.FileType.NotFound:
        return None
    with system.open_input_file(f"{name}/manifest.json") as file:
        return json.loads(file.read())


@dataclass
class _Part(WriterCommitMessage):
    order: int
    name: str
    documents: int
    tokens: int
    nulls: int


class _Writer(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own; only those named by the manifest count."""

    def __init__(self, path: str, width: int, tokenizer: str | None, overwrite: bool) -> None:
        self.path, self.width, self.tokenizer, self.overwrite = path, width, tokenizer, overwrite

    def _ids(self, batch: pa.RecordBatch) -> list:
        """The ids of each row as bytes: those given, or those of its text."""
        if self.tokenizer:
            return [encoded_bytes(t.as_py() or "", self.tokenizer) for t in batch.column("text")]
        if batch.column("ids").null_count:
            raise ValueError("ids may not be null")
        return [i.as_buffer() for i in batch.column("ids")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        order = TaskContext.get().partitionId()
        part = _Part(order, f"part-{order:05d}-{uuid.uuid4().hex}", 0, 0, 0)
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = None
        for batch in (b.slice(at, 512) for b in iterator for at in range(0, b.num_rows, 512)):
            if files is None:
                files = [system.open_output_stream(f"{folder}/{part.name}.{end}") for end in ("ids", "offsets", "docs")]
            docs, ids = batch.column("doc_id"), self._ids(batch)
            if part.nulls and docs.null_count < len(docs):
                raise ValueError("rows without doc_id come last")
            sizes = np.array([len(i) for i in ids], np.uint64) // np.uint64(self.width)
            starts = np.uint64(part.tokens) + np.cumsum(sizes, dtype=np.uint64) - sizes
            for i in ids:
                files[0].write(i)
            files[1].write(starts.astype("<u8").tobytes())
            files[2].write(docs.fill_null(0).to_numpy().astype("<i8").tobytes())
            part.documents += len(docs)
            part.tokens += int(sizes.sum())
            part.nulls += docs.null_count
        if files is not None:
            files[1].write(np.uint64(part.tokens).astype("<u8").tobytes())
            for file in files:
                file.close()
        return part

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        known = None if self.overwrite else manifest(self.path)
        parts = known["parts"] if known else []
        documents, tokens = (known["documents"], known["tokens"]) if known else (0, 0)
        if known and known["width"] != self.width:
            raise ValueError(f"the folder holds ids of {known['width']} bytes")
        for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.order):
            sizes = {"documents": m.documents, "tokens": m.tokens, "nulls": m.nulls}
            parts.append({"name": m.name, **sizes, "first_document": documents, "first_token": tokens})
            documents, tokens = documents + m.documents, tokens + m.tokens
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        fresh = f"{folder}/manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as file:
            file.write(json.dumps({"width": self.width, "documents": documents, "tokens": tokens, "parts": parts}).encode())
        system.move(fresh, f"{folder}/manifest.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.path)
        for m in messages:
            if m and m.documents:
                for end in ("ids", "offsets", "docs"):
                    system.delete_file(f"{folder}/{m.name}.{end}")


@dataclass
class _Slice(InputPartition):
    """Documents of a part: from ``first`` on, ``count`` of them."""

    part: dict
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, as_numbers: bool) -> None:
        self.path, self.as_numbers = path, as_numbers
        self.held = manifest(path)
        if self.held is None:
            raise FileNotFoundError(f"no manifest in {path}")

    def partitions(self) -> list[InputPartition]:
        slices: list[InputPartition] = []
        for part in self.held["parts"]:
            cuts = max(1, min(part["documents"], -(-part["tokens"] * self.held["width"] // READ_BYTES)))
            bounds = [part["documents"] * k // cuts for k in range(cuts + 1)]
            slices += [_Slice(part, a, b - a) for a, b in zip(bounds, bounds[1:])]
        return slices or [_Slice({}, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part, kind = partition.part, f"<u{self.held['width']}"
        for first in range(partition.first, partition.first + partition.count, READ_ROWS):
            count = min(READ_ROWS, partition.first + partition.count - first)
            base = f"{self.path}/{part['name']}"
            offsets = np.asarray(_numbers(f"{base}.offsets", "<u8", first, count + 1)).astype(np.int64)
            docs = np.asarray(_numbers(f"{base}.docs", "<i8", first, count))
            ids = _numbers(f"{base}.ids", kind, int(offsets[0]), int(offsets[-1] - offsets[0])).astype("<u4")
            within = offsets - offsets[0]
            if self.as_numbers:
                held = pa.ListArray.from_arrays(pa.array(within.astype(np.int32)), pa.array(ids.astype(np.int64)))
            else:
                held = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((4 * within).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            absent = np.arange(first, first + count) >= part["documents"] - part["nulls"]
            starts = part["first_token"] + offsets[:-1]
            columns = [pa.array(docs, pa.int64(), mask=absent), pa.array(starts), pa.array(np.diff(offsets)), held]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """Format ``token_files``. Written from ``doc_id`` (long), ``ids`` (binary), in the order of the rows; append goes on
    behind the last document. With option ``tokenizer`` it takes a ``text`` in place of the ids. Other options: ``path``;
    ``width`` of an id for writing; for reading ``ids``: ``bytes`` (binary, little-endian unsigned 32-bit, the
    default) or ``numbers`` (array of long).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = "array<bigint>" if self.options.get("ids") == "numbers" else "binary"
        return f"doc_id bigint, start bigint, n_tokens bigint, ids {kind}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), self.options.get("ids") == "numbers")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        tokenizer = self.options.get("tokenizer")
        width = id_width(tokenizer) if tokenizer else int(self.options.get("width", "4"))
        return _Writer(self.options["path"].rstrip("/"), width, tokenizer, overwrite)


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """All ``docs`` to ``path`` in ascending order of doc_id, null ids last; whatever the folder held counts no more.

    Rows of one doc_id, null ones too, are ordered by a hash of the text and spread over tasks, equal rows as well.
    A null text is an empty one: the end id alone. No rows make a manifest without parts.
    """
    at = F.monotonically_increasing_id()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), at.alias("at"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "at")
    docs.sparkSession.dataSource.register(TokenFiles)
    ordered.select("doc_id", "text").write.format(FORMAT).option("tokenizer", tokenizer).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, ids: str = "bytes") -> DataFrame:
    """Columns ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` of the documents in ``path``."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).option("ids", ids).load(path)
