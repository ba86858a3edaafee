"""Best-fit packing of token pieces into sequences: matched pairs of large pieces, gaps filled by small ones."""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import ranked, settled

CAPACITY = 2048
END = 0
#: Words of which a worker remembers the ids; beyond, the words not used since the last time are forgotten.
REMEMBERED = 250_000
#: Letters, then ASCII marks: the tokenizer's rules cut such a word there, and its letters need no normalizing but lower case.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)\Z")


#: Packers of up to 15 ids, made once: most words have few.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _bytes(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes; a word that is not known is encoded when it is looked up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.shown: dict[int, str] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._whole(word.decode())
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a run of letters in lower case or of marks, by the tokenizer's model alone."""
        ids = self.parts.get(part)
        if ids is None:
            shown = part
            if not part.isascii():
                for c in set(part):
                    if ord(c) not in self.shown:
                        self.shown[ord(c)] = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
                shown = part.translate(self.shown)
            ids = self.parts[part] = _bytes([t.id for t in self.tokenizer.model.tokenize(shown)])
        return ids

    def _whole(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        plain = _PLAIN.match(word)
        if plain is None:
            return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        return self._part(letters.lower()) + (self._part(marks) if marks else b"")

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()


_loaded: dict[str, WordIds] = {}


def token_bytes(text: str, path: str) -> bytes:
    """Little-endian 32-bit ids of a text, then id 0.

    The tokenizer's rules never join characters across ASCII white space, so that each distinct word
    between white space is encoded once and then remembered.
    """
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    known = _loaded[path]
    known.forget()
    return b"".join(map(known.__getitem__, text.encode().split())) + END.to_bytes(4, "little")


def file_order(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``text`` with ``part`` and ``nth``, which sort the rows of ``docs`` as they were written.

    A scan deals the files out by size, so that rows read again come in another order: their order is that of the
    part numbers and names of the files and of the rows in them. ``docs`` must be read from files as they are;
    a table that no file holds keeps its own order. A part has 65,536 rows at most.
    """
    try:
        own = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        own = docs.select("doc_id", "text", at.alias("at")).select(
            "doc_id", "text", F.shiftright("at", 33).cast("string").alias("file"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")
        )
    number = F.lpad(F.regexp_extract("file", r"(\d+)", 1), 12, "0")
    within = F.lpad(F.shiftright("nth", 16).cast("string"), 12, "0")
    return own.select("doc_id", "text", F.concat_ws("/", number, "file", within).alias("part"), "nth")


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True, carried: Sequence[str] = ()
) -> DataFrame:
    """Columns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``: the pieces of every row.

    A document's ids end with id 0. Only documents longer than ``capacity`` are cut, every ``capacity``
    tokens. Null and empty texts give one piece, the single id 0. ``ids`` (binary, little-endian 32-bit)
    is null unless ``keep_ids``. Columns other than doc_id, text and those ``carried`` are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                of = []
                for nth, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                    ids = token_bytes(text.as_py() or "", tokenizer)
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        rows.append((doc_id, piece, a // 4, len(cut) // 4, zlib.crc32(cut), cut if keep_ids else None))
                        of.append(nth)
                columns = [pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)]
                columns += [part.column(2 + k).take(pa.array(of)) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *carried])

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32")), ("ids", pa.binary())]
    schema = pa.schema(fields)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    kinds = ", ".join([kinds, *(f"`{n}` {t}" for n, t in docs.select(*carried).dtypes)])
    return narrow.mapInArrow(apply, kinds)


class _Bins:
    """Bins of equal history as runs: for each free space, lists of (first bin, number of bins)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.free: dict[int, list[list[int]]] = {}
        self.spaces: list[int] = []
        self.used = 0

    def put(self, space: int, first: int, count: int) -> None:
        if space and count:
            if space not in self.free:
                bisect.insort(self.spaces, space)
                self.free[space] = []
            self.free[space].append([first, count])

    def new(self, count: int) -> int:
        self.used += count
        return self.used - count

    def take(self, at_least: int, most: int) -> tuple[int, int, int] | None:
        """Bins of the smallest space that is large enough: (space, first bin, number of bins)."""
        i = bisect.bisect_left(self.spaces, at_least)
        if i == len(self.spaces):
            return None
        space = self.spaces[i]
        run = self.free[space][-1]
        count = min(most, run[1])
        first = run[0]
        run[0] += count
        run[1] -= count
        if not run[1]:
            self.free[space].pop()
            if not self.free[space]:
                del self.free[space], self.spaces[i]
        return space, first, count


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, from rank, number, first bin, pieces a bin, offset).

    ``lengths`` counts the pieces of each length (1 to ``capacity``). Pieces above a third of the capacity
    are matched first: the longest one left takes the longest other one that fits beside it, so a bin
    holds two at most. Shorter pieces then go, longest first, to the fullest bin with room, in as many
    copies as it holds. Work and result depend on the capacity, not on the number of pieces.
    """
    bins = _Bins(capacity)
    moves: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in lengths.items() if c}
    rank = dict.fromkeys(left, 0)

    def place(length: int, count: int, first: int, per_bin: int, offset: int) -> None:
        moves.append((length, rank[length], count, first, per_bin, offset))
        rank[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        i = bisect.bisect_right(large, capacity - longest) - 1
        if i < 0:
            count = left[longest]
            first = bins.new(count)
            place(longest, count, first, 1, 0)
            bins.put(capacity - longest, first, count)
        else:
            partner = large[i]
            count = left[longest] // 2 if partner == longest else min(left[longest], left[partner])
            if not count:  # one piece is left, its equal is itself
                i -= 1
                if i >= 0:
                    partner, count = large[i], 1
                else:
                    partner, count = 0, 1
            first = bins.new(count)
            place(longest, count, first, 1, 0)
            if partner:
                place(partner, count, first, 1, longest)
            bins.put(capacity - longest - partner, first, count)
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            n = left[length]
            taken = bins.take(length, n)
            if taken is None:
                taken = capacity, bins.new(c := -(-n // (capacity // length))), c
            space, first, count = taken
            per_bin = space // length
            full = min(count, n // per_bin)
            if full:
                place(length, full * per_bin, first, per_bin, capacity - space)
                bins.put(space - per_bin * length, first, full)
            if full < count:
                rest = min(per_bin, left[length])
                if rest:
                    place(length, rest, first + full, rest, capacity - space)
                    bins.put(space - rest * length, first + full, 1)
                    full += 1
                # What was taken and not needed stays as it was.
                bins.put(space, first + full, count - full)
    return moves


def assigned(pieces: DataFrame, moves: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length`` and ``rank`` (within the length)."""
    table = np.array(sorted(moves), np.int64).reshape(-1, 6)
    span = np.int64(1) << 48
    keys = table[:, 0] * span + table[:, 1]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows.pop("length_of").to_numpy(), rows.pop("rank").to_numpy()
            move = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - move[:, 1]
            rows["sequence_id"] = move[:, 3] + nth // move[:, 4]
            rows["offset"] = move[:, 5] + nth % move[:, 4] * length
            yield rows

    keep = [c for c in pieces.columns if c != "rank"]
    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.select(*keep).dtypes)
    sent = pieces.select(*keep, F.col("length").alias("length_of"), "rank")
    return sent.mapInPandas(apply, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` (see ``token_pieces``) with ``sequence_id`` and ``offset``.

    Pieces are tokenized once and settled in the shared folder. The driver gets the number of pieces of
    each length, at most ``capacity`` numbers, and plans whole classes of equal bins. A piece finds its place by
    its rank within its length, in the order of the rows, counted by part of the table: neither a length
    nor a document held by a third of all rows meets in one task. Nothing is dropped. An empty
    table gives an empty one; repeated rows and null ids are packed like any others.
    """
    pieces = token_pieces(docs, tokenizer, capacity, keep_ids).withColumn("at", F.monotonically_increasing_id())
    pieces = settled(pieces, "pieces").withColumn("part", F.shiftright("at", 33))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = pieces if keep_ids else pieces.drop("ids")
    place = ranked(narrow, ["length"], "part", ["at"], "rank").drop("part", "at")
    return assigned(place, plan(lengths, capacity))


def packed_in_order(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Like ``packed``, by the order in which the rows of ``docs`` were written (see ``file_order``).

    Pieces of equal length keep that order, and sequences are numbered in the order of their first pieces: whoever
    reads sequences by number reads documents as near to the written order as the packing allows.
    """
    pieces = settled(token_pieces(file_order(docs), tokenizer, capacity, keep_ids, ["part", "nth"]), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = pieces if keep_ids else pieces.drop("ids")
    place = ranked(narrow, ["length"], "part", ["nth", "piece"], "rank")
    place = settled(assigned(place, plan(lengths, capacity)), "places")
    first = place.groupBy("sequence_id").agg(F.min(F.struct("part", "nth", "piece")).alias("first"))
    first = settled(first.select("sequence_id", "first.*"), "firsts")
    numbers = ranked(first, [], "part", ["nth", "piece"], "number").select(F.col("sequence_id").alias("of"), "number")
    columns = [F.col("number").alias(c) if c == "sequence_id" else F.col(c) for c in place.columns if c not in ("part", "nth")]
    return place.join(numbers, F.col("sequence_id") == F.col("of")).select(*columns)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """Columns ``sequence_id``, ``doc_ids``, ``offsets``, ``ids``: the token ids of each sequence, from ``packed`` pieces with ids."""
    one = F.struct("offset", "doc_id", "piece", "ids")
    whole = packed_pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    joined = F.aggregate("parts.ids", F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return whole.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"), joined.alias("ids"))
