"""Importance resampling towards target texts: hashed word runs, log-ratio gains, a seeded draw without replacement.

Runs of frequent words and frequent pairs are known ahead: a broadcast table holds their CRC-32, from which longer runs go
on. All other runs are hashed whole. Both give the same buckets, so the table changes the cost and never the result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import placed, settled

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words, and pairs, that are at least this fraction of all are frequent: there can be no more than HEAD of each.
HEAD = 50_000
#: A frequent word has this many bytes at most, a pair twice as many and the space: the table is below 25 MB.
HEAD_BYTES = 64
#: Runs a task counts at once before it forgets the rarest, and runs of which a worker remembers the value.
COUNTED, REMEMBERED = 400_000, 400_000
#: Letters A-Z in lower case; all ASCII that makes no word becomes a space.
_WORD = bytes.maketrans(
    bytes(range(128)), bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128))
)


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: digits, letters a-z and all beyond ASCII; none for null."""
    return (text or "").encode().translate(_WORD).split()


def runs(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, repeats included."""
    every = list(found)
    for n in range(2, longest + 1):
        every += map(b" ".join, zip(*(found[k:] for k in range(n))))
    return every


def crc(run: bytes, head: dict[bytes, int]) -> int:
    """CRC-32 of a run, from the state of its first two words or its first one where the head has it."""
    known = head.get(run)
    if known is not None:
        return known
    second = run.find(b" ", run.find(b" ") + 1) if b" " in run else -1
    for end in (second, run.find(b" ")):
        state = head.get(run[:end]) if end > 0 else None
        if state is not None:
            return zlib.crc32(run[end:], state)
    return zlib.crc32(run)


class _Values(dict):
    """A number for each run: of its bucket. Values of the head are known, others are remembered for a while."""

    def __init__(self, head: dict[bytes, int], of_bucket: list[int]) -> None:
        super().__init__()
        self.head, self.of_bucket = head, of_bucket

    def __missing__(self, run: bytes) -> int:
        value = self.of_bucket[crc(run, self.head) % len(self.of_bucket)]
        self[run] = value
        return value

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, Iterator[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, (t.as_py() for t in part.column(column))


def frequent(texts: DataFrame, longest: int) -> dict[bytes, int]:
    """CRC-32 of the frequent words and, if runs are longer than a word, of the frequent pairs of column ``text``.

    A task counts within bounded memory, forgetting what is rare, and hands on what is frequent in its own rows. What is
    frequent in all rows is so in at least one task. A frequent one that is missed costs time, it changes no result.
    """
    kinds = min(longest, 2)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [Counter() for _ in range(kinds)], [0] * kinds
        for _, part in _texts(batches):
            for text in part:
                found = words(text)
                for k in range(kinds):
                    every = found if k == 0 else list(map(b" ".join, zip(found, found[1:])))
                    counts[k].update(every)
                    totals[k] += len(every)
            for k in range(kinds):
                if len(counts[k]) > COUNTED:
                    least = totals[k] / HEAD / 2
                    counts[k] = Counter({w: n for w, n in counts[k].items() if n > least})
        for k in range(kinds):
            kept = [(w, n) for w, n in counts[k].items() if n * HEAD >= totals[k] and len(w) <= HEAD_BYTES * (k + 1) + k]
            columns = [pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())]
            rows = [(k, columns[0], columns[1], False), (k, pa.array([b""], pa.binary()), pa.array([totals[k]], pa.int64()), True)]
            for kind, run, n, total in rows:
                size = len(run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * size, pa.int32()), run, n, pa.array([total] * size, pa.bool_())], names=["kind", "run", "n", "total"]
                )

    partial = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(apply, "kind int, run binary, n long, total boolean")
    summed = settled(partial.groupBy("kind", "run", "total").agg(F.sum("n").alias("n")), "frequent")
    totals = {r.kind: r.n for r in summed.where("total").collect()}
    head: dict[bytes, int] = {}
    for kind, total in totals.items():
        # At most HEAD rows: each is at least that fraction of the total.
        for row in summed.where(f"not total and kind = {kind} and n * {HEAD} >= {total} and n > 0").collect():
            head[bytes(row.run)] = zlib.crc32(row.run)
    return head


def bucket_totals(texts: DataFrame, head, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of column ``text`` fall into each bucket, exactly; ``head`` is a broadcast of ``frequent``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Values(head.value, list(range(buckets)))
        totals = np.zeros(buckets, np.int64)
        for _, part in _texts(batches):
            for text in part:
                every = runs(words(text), longest)
                totals += np.bincount(np.fromiter(map(bucket_of.__getitem__, every), np.int64, len(every)), minlength=buckets)
            bucket_of.forget()
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["bucket", "n"])

    partial = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(apply, "bucket long, n long")
    totals = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[row.bucket] = row.n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket, floor(1000 ln) of how much likelier the target's runs fall into it than the source's, both plus one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return [
        math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]


def weighed(docs: DataFrame, head, of_bucket: list[int], longest: int = LONGEST) -> DataFrame:
    """Columns ``doc_id``, ``n_words``, ``n_features``, ``weight``: the floored mean of the gains of a row's runs, 0 without any."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = _Values(head.value, of_bucket)
        for part, texts in _texts(batches, 1):
            rows = []
            for text in texts:
                found = words(text)
                every = runs(found, longest)
                rows.append((len(found), len(every), sum(map(gain_of.__getitem__, every)) // len(every) if every else 0))
            gain_of.forget()
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts], names=["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Columns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs`` (doc_id, text).

    The score is the weight towards the texts of ``target`` plus seeded noise, so that the highest scores are a
    draw without replacement. Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn and
    ranked from 1 by score, then doc_id, null ids last; rows equal in both, in any order. The others have no rank.
    Null texts have no words. Repeated rows count each. Without targets the gains favour rare buckets alone.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(frequent(docs, longest))
    source = bucket_totals(docs, head, longest, buckets)
    wanted = bucket_totals(target, head, longest, buckets)
    scored = weighed(docs, head, gains(source, wanted), longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = settled(scored, "scored")

    able = F.col("n_words") >= least_words
    # Scores are whole thousandths of logarithms of counts and of 32-bit hashes: below 200,000 different ones.
    levels = sorted(((r.score, r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    draw = sum(n for _, n in levels) * percent // 100
    cut, above = None, 0
    for score, n in levels:
        if above >= draw:
            break
        cut, above = score, above + n
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    high = able & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    drawn = placed(scored.where(high), order, "place").select(*columns, F.when(F.col("place") < draw, F.col("place") + 1).alias("rank"))
    return drawn.union(scored.where(~high).select(*columns, none))
