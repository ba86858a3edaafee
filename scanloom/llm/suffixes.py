"""Removal of long repeats by a logarithmic family of sparse suffix arrays.

A window is any run of 50 bytes of a text. Suffixes are indexed where the least hash of a window's 20-byte
strings changes: each such run of windows has one entry, the hash (its anchor) and a hash of all its
bytes. Both depend on the bytes alone, so that equal windows have equal anchors in all texts. Entries are
split by anchor, and each split keeps a family of sorted arrays: a new batch is sorted, scanned
against the arrays there are for long matches, and arrays of like size are merged.

Runs equal in all their bytes are decided by that. Where a repeat starts or ends inside a run, the run's single
windows go through a second family in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import settled

WINDOW = 50
GRAM = 20
_SPAN = WINDOW - GRAM + 1
#: Text of a batch, and text whose entries one split holds.
BATCH_BYTES = 2 << 20
SPLIT_BYTES = 8 << 20
_CHUNK = 1 << 19
#: A null id: after all others, and like no other document.
NO_ID = np.iinfo(np.int64).max
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
UNIQUE, REMOVED, OPEN = 0, 1, 2


def _join(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    out = a ^ (a >> np.uint64(29))
    out *= odd
    out += b
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    return x


def string_hashes(data: np.ndarray, odd: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of ``GRAM`` and of ``WINDOW`` bytes, by their start."""
    h = (data.astype(np.uint64) + np.uint64(1)) * odd
    width = 1
    while width < 16:
        h = _join(h[:-width], h[width:], odd)
        width *= 2
    gram = _mix(_join(h[: len(h) - (GRAM - 16)], h[GRAM - 16 :], odd))
    h = _join(h[:-16], h[16:], odd)
    rest = WINDOW - 32
    return gram, _mix(_join(h[: len(h) - rest], h[rest:], odd))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(text: bytes, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays (start, windows, anchor, whole, doc) of the runs of windows with one anchor.

    ``stops`` are the ends of the documents in ``text``; no window crosses one. A run has 50 windows at most, so that
    its first and last window cover all its bytes.
    """
    data = np.frombuffer(text, np.uint8)
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    begins = np.concatenate([[0], stops[:-1]])
    for at in range(0, len(data) - WINDOW + 1, _CHUNK):
        part = data[at : at + _CHUNK + WINDOW - 1]
        gram, window = string_hashes(part, _ODD[0])
        least = _least(gram, _SPAN)
        n = len(least)
        valid = np.ones(n, bool)
        lo, hi = np.searchsorted(stops, at, side="right"), np.searchsorted(stops, at + n + WINDOW, side="right")
        cuts = np.zeros(n + 1, bool)
        for k in range(lo, min(hi + 1, len(stops))):
            a, b = max(begins[k], stops[k] - WINDOW + 1) - at, stops[k] - at
            valid[max(0, a) : max(0, b)] = False
            if 0 <= b < n:
                cuts[b] = True
        cuts[0] = True
        cuts[1:n] |= (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(cuts[:n])
        length = np.diff(np.append(start, n))
        keep = valid[start]
        start, length = start[keep], length[keep]
        if len(length) and length.max() > WINDOW:
            times = -(-length // WINDOW)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = np.repeat(start, times) + nth * WINDOW
            length = np.minimum(WINDOW, np.repeat(length, times) - nth * WINDOW)
        whole = _mix(_join(window[start], window[start + length - 1], _ODD[1]) + length.astype(np.uint64))
        for into, values in zip(found, (start + at, length, least[start], whole, np.searchsorted(stops, start + at, side="right")), strict=True):
            into.append(values)
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return tuple(np.concatenate(v).astype(k) if v else np.zeros(0, k) for v, k in zip(found, kinds, strict=True))


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; all have one length."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.nbytes // max(1, len(a))).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + _zip(planes)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(_unzip(blob[8:]), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


#: Bytes of the two hashes that an entry keeps; the rest of the first names the split.
_SIX = np.uint64((1 << 48) - 1)
_FIVE = np.uint64((1 << 40) - 1)


def _entries(start: np.ndarray, length: np.ndarray, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> bytes:
    """Entries in the order of the text: places and ids as steps, hashes cut to five and six bytes."""
    steps = np.diff(start, prepend=0).astype("<u4")
    five = (first & _FIVE).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    six = (second & _SIX).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return _pack(steps, length.astype(np.uint8), five, six, np.diff(ids, prepend=np.int64(0)).astype("<i8"))


def _read_entries(blob: bytes) -> tuple[np.ndarray, ...]:
    steps, length, five, six, ids = _unpack(blob, "<u4", "u1", "V5", "V6", "<i8")
    wide = np.zeros((2, len(steps), 8), np.uint8)
    wide[0, :, :5] = five.view(np.uint8).reshape(-1, 5)
    wide[1, :, :6] = six.view(np.uint8).reshape(-1, 6)
    first, second = wide.view("<u8").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), length.astype(np.int64), first, second, np.cumsum(ids)


class Family:
    """Sorted arrays of (anchor, whole, least id, largest id), each about twice the next one's size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def _sorted(first: np.ndarray, second: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        if not len(first):
            return first, second, low, high
        return first[heads], second[heads], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads)

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> None:
        """Sorts a batch and merges it with the levels that are not larger."""
        level = self._sorted(first, second, ids, ids)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._sorted(*(np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)))
        self.levels.append(level)

    def close(self) -> None:
        """One level holds everything; ``several`` tells whether other runs of other documents share the anchor."""
        merged = self._sorted(*(np.concatenate(x) for x in zip(*self.levels, strict=True)))
        self.first, self.second, self.low, high = merged
        heads = np.flatnonzero(np.append(True, self.first[1:] != self.first[:-1]))
        counts = np.diff(np.append(heads, len(self.first)))
        other = np.minimum.reduceat(self.low, heads) != np.maximum.reduceat(high, heads)
        self.several = np.repeat(other & (counts > 1), counts)
        self.levels = []
        # Both hashes as one sortable key: the anchors' rank, then the hash of the whole run.
        self.heads, self.anchors = heads, self.first[heads]

    def codes(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """REMOVED if the run is in a document with a smaller id, OPEN if only parts of it can be."""
        order = np.lexsort((second, first))
        same = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))
        # Every queried pair is in the family, so that merging both sorted lists numbers them alike.
        every = np.lexsort((np.concatenate([self.second, second[order][same]]), np.concatenate([self.first, first[order][same]])))
        known = np.flatnonzero(every < len(self.first))
        place = np.empty(len(every), np.int64)
        place[every] = np.searchsorted(known, np.arange(len(every)), side="right") - 1
        queried = place[len(self.first) :]
        # Of two equal keys lexsort puts the family's first: it came first.
        at = np.empty(len(first), np.int64)
        at[order] = queried[np.cumsum(same) - 1]
        return np.where(self.low[at] < ids, REMOVED, np.where(self.several[at], OPEN, UNIQUE)).astype(np.uint8)


def _batches(docs: DataFrame) -> DataFrame:
    """Columns ``batch``, ``ids`` (array), ``stops`` and ``text`` (binary): whole texts, about 2 MB together."""

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            stops = np.cumsum([len(t) for t in texts], dtype="<i8")
            values = [[number], [ids], [_pack(stops)], [_zip(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for part in parts:
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("stops", pa.binary()), ("text", pa.binary())])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "batch long, ids array<long>, stops binary, text binary")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    (stops,) = _unpack(row["stops"], "<i8")
    return ids, stops, _unzip(row["text"]) if stops[-1] else b""


def _firsts(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of entries to send and of entries that another of the same batch with a smaller id removes."""
    order = np.lexsort((ids, second, first))
    a, b, i = first[order], second[order], ids[order]
    head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    least = i[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else i
    removed = np.zeros(len(order), bool)
    removed[order] = i > least
    return ~removed, removed


_SENT = pa.schema([("split", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_SENT_SQL = "split long, batch long, blob binary"


def _send(batch: int, splits: int, start, length, first, second, ids) -> Iterator[tuple[int, int, bytes]]:
    """Entries by split; what the batch itself decides goes to a split of its own, decided."""
    send, removed = _firsts(first, second, ids)
    yield -1 - batch, batch, _pack(start[removed].astype("<i8"), length[removed].astype("<u1"), np.full(int(removed.sum()), REMOVED, np.uint8))
    start, length, first, second, ids = (x[send] for x in (start, length, first, second, ids))
    split = ((first >> np.uint64(40)) % np.uint64(splits)).astype(np.int64)
    order = np.argsort(split, kind="stable")
    bounds = np.flatnonzero(np.diff(split[order], prepend=-1))
    for part in np.split(order, bounds[1:]) if len(order) else []:
        yield int(split[part[0]]), batch, _entries(start[part], length[part], first[part], second[part], ids[part])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _decided(sent: DataFrame) -> DataFrame:
    """The entries of each batch that are not unique, with their codes: columns ``batch``, ``blob``."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        if group["split"].iloc[0] < 0:
            return group[["batch", "blob"]]
        read = [_read_entries(b) for b in group["blob"]]
        family = Family()
        pending, size = [], 0
        for entries in read:
            pending.append(entries)
            size += len(entries[0])
            if size >= 1 << 16:
                family.add(*(np.concatenate([e[k] for e in pending]) for k in (2, 3, 4)))
                pending, size = [], 0
        if pending:
            family.add(*(np.concatenate([e[k] for e in pending]) for k in (2, 3, 4)))
        family.close()
        codes = family.codes(*(np.concatenate([e[k] for e in read]) for k in (2, 3, 4)))
        out, at = [], 0
        for batch, (start, length, *_rest) in zip(group["batch"], read, strict=True):
            code = codes[at : at + len(start)]
            at += len(start)
            told = code != UNIQUE
            if told.any():
                out.append((batch, _pack(start[told].astype("<i8"), length[told].astype("<u1"), code[told])))
        return pd.DataFrame(out, columns=["batch", "blob"])

    return sent.groupBy("split").applyInPandas(decide, "batch long, blob binary")


def _told(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = [_unpack(b, "<i8", "u1", "u1") for b in blobs or []]
    if not read:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    start, length, code = (np.concatenate(x) for x in zip(*read, strict=True))
    return start, length.astype(np.int64), code


def _spans(start: np.ndarray, stop: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals, each inside one document: (document, start, stop)."""
    if not len(start):
        return start, start, start
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    doc = np.searchsorted(stops, start, side="right")
    reach = np.maximum.accumulate(stop)
    head = np.append(True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))
    heads = np.flatnonzero(head)
    return doc[heads], start[heads], reach[np.append(heads[1:] - 1, len(start) - 1)]


def _answers(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("batch").agg(F.collect_list("blob").alias("told"))


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``n_bytes``, ``spans``, ``kept``: one row for each row of ``docs``.

    ``spans`` are the maximal removed runs (start, stop) in the UTF-8 bytes of the text: all bytes covered by a
    50-byte string that also starts in a document with a smaller id. ``kept`` are the other bytes.
    Strings are judged on the input. Null and empty texts have no bytes; rows with equal ids do not
    remove from each other; a null id is larger than any other. Other columns are not read.

    Texts are packed into batches in the shared folder. A batch sends each of its runs once: what one of its
    own documents repeats is decided before anything is shuffled. Splits hold the entries of about 8 MB of text,
    whatever the size of the corpus, and answer each batch with the runs that are not unique.
    """
    texts = settled(_batches(docs), "batches")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # zstd leaves about a third of the text.
    splits = max(1, -(-3 * total // SPLIT_BYTES))

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, stops, text = _opened(row)
                start, length, first, second, doc = runs(text, stops)
                yield _rows(list(_send(row["batch"], splits, start, length, first, second, ids[doc])))

    whole = settled(_decided(texts.mapInArrow(index, _SENT_SQL)), "runs")

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, stops, text = _opened(row)
                start, length, code = _told(row["told"])
                left = code == OPEN
                order = np.argsort(start[left], kind="stable")
                start, length = start[left][order], length[left][order]
                data = np.frombuffer(text, np.uint8)
                found: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(start), 1 << 13):
                    a, n = start[at : at + (1 << 13)], length[at : at + (1 << 13)]
                    size = n + WINDOW - 1
                    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    bytes_ = data[np.repeat(a, size) + nth]
                    real = np.flatnonzero((nth < np.repeat(n, size))[: len(nth) - WINDOW + 1])
                    one, two = (string_hashes(bytes_, odd)[1][real] for odd in _ODD[:2])
                    found.append((np.repeat(a, size)[real] + nth[real], one, two))
                if found:
                    start, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
                    ids_ = ids[np.searchsorted(stops, start, side="right")]
                    yield _rows(list(_send(row["batch"], splits, start, np.ones(len(start), np.int64), one, two, ids_)))

    told = texts.join(_answers(whole), "batch")
    single = settled(_decided(told.select(*texts.columns, "told").mapInArrow(windows, _SENT_SQL)), "windows")

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, stops, text = _opened(row)
                start, length, code = _told(row["told"])
                gone = code == REMOVED
                doc, a, b = _spans(start[gone], start[gone] + length[gone] + WINDOW - 1, stops)
                bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
                out = []
                begin = 0
                for k, stop in enumerate(stops.tolist()):
                    spans = list(zip(a[bounds[k] : bounds[k + 1]].tolist(), b[bounds[k] : bounds[k + 1]].tolist(), strict=True))
                    edges = [begin, *(x for s in spans for x in s), stop]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    out.append((row["ids"][k], stop - begin, [{"start": x - begin, "stop": y - begin} for x, y in spans], kept))
                    begin = stop
                columns = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), result, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=result)

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    answers = _answers(whole.union(single))
    answered = texts.join(answers, "batch", "left").select(*texts.columns, "told")
    return answered.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
