"""SimHash near-duplicates by deletion variants of three segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import settled
from scanloom.llm.components import connected_components

#: (lowest bit, width): with up to five differing bits, one of three segments holds at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *stops[:-1]]
    last = stops[shingle - 1 :] or stops[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    count = len(last)
    for at in range(0, count, _BLOCK):
        spans = zip(starts[at : at + _BLOCK], last[at : at + _BLOCK], strict=False)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Columns ``doc_id``, ``bits`` (long): a fingerprint for every row, over the whole text.

    Null and empty texts have fingerprint zero; texts of fewer words than a shingle hash all their
    words at once. Votes are counted in blocks, so a long text needs no more memory than its words.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["doc_id", "bits"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "doc_id long, bits long")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(nodes: DataFrame) -> DataFrame:
    """64 rows a fingerprint: each segment with one bit left out; ``key`` tells segment, bit and the rest."""
    kinds = []
    for low, width in SEGMENTS:
        whole = ((1 << width) - 1) << low
        for bit in range(low, low + width):
            mask = whole & ~(1 << bit)
            kinds.append((bit, low, mask - (1 << 64) if mask >> 63 else mask))
    spec = F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(w).alias("low"), F.lit(m).cast("long").alias("mask")) for b, w, m in kinds))
    rows = nodes.select("bits", F.explode(spec).alias("kind"))
    rest = F.expr("shiftrightunsigned(bits & kind.mask, kind.low)")
    return rows.select(F.expr("shiftleft(cast(kind.bit as bigint), 32)").bitwiseOR(rest).alias("key"), "bits")


def _first_shared(key: Column, x: Column) -> Column:
    """Whether ``key`` is the first variant that two fingerprints with difference ``x`` share."""
    bit = F.shiftright(key, 32).cast("int")
    hit = F.lit(False)
    earlier = F.lit(True)
    for low, width in SEGMENTS:
        whole = ((1 << width) - 1) << low
        part = x.bitwiseAND(F.lit(whole - (1 << 64) if whole >> 63 else whole).cast("long"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        here = (bit >= low) & (bit < low + width) & ((part == one) | ((part == 0) & (bit == low)))
        hit = hit | (earlier & here)
        earlier = earlier & (F.bit_count(part) > 1)
    return hit


def fingerprint_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct ``bits`` with ``most`` or fewer differing bits.

    Two such fingerprints share a variant of a segment. In each variant's bucket every member is
    compared with the bucket's smallest; members near it are linked through it, so that a dense bucket
    needs no pairs. In a bucket of two that is all. In a larger one, a member that is not near the smallest is
    compared with the whole bucket, if that bucket comes first for the pair. Both joins are on the variant alone and can be split by
    adaptive execution; no bucket is capped and no group is collected.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"three segments find at most {MOST_BITS} differing bits")
    variants = _variants(nodes)
    centres = variants.groupBy("key").agg(F.min("bits").alias("centre"), F.count(F.lit(1)).alias("n"))
    # Without the hint the planner takes the size before the explode for the size of a side.
    centres = centres.where("n > 1").withColumnRenamed("key", "of")
    linked = (_differing("bits", "centre") <= most) & (F.col("bits") != F.col("centre"))
    members = variants.hint("merge").join(centres, (variants["key"] == centres["of"]) & ((F.col("n") > 2) | linked))
    members = members.select("key", "bits", "centre", (_differing("bits", "centre") <= most).alias("near"))
    members = settled(members, "variants")
    stars = members.where("near and bits <> centre").select(F.col("bits").alias("u"), F.col("centre").alias("v"))
    far = members.where("not near").select("key", F.col("bits").alias("u"))
    every = members.select("key", F.col("bits").alias("v"), "near")
    x = F.col("u").bitwiseXOR(F.col("v"))
    # bit_count leads: it refuses nearly all pairs.
    near = (F.bit_count(x) <= most) & (F.col("near") & (F.col("u") != F.col("v")) | (F.col("u") < F.col("v")))
    pairs = far.join(every, (far["key"] == every["key"]) & near & _first_shared(far["key"], x)).select("u", "v")
    return stars.union(pairs).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, most: int = MOST_BITS) -> DataFrame:
    """Columns ``doc_id``, ``bits``, ``component_id``: one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links; null doc_ids are listed but never
    smallest, and a component of null ids alone has none. Rows that share a fingerprint are one
    node. An empty table gives an empty one; columns other than doc_id and text are not read.
    """
    marked = settled(fingerprints(docs, shingle), "fingerprints")
    nodes = settled(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    roots = settled(connected_components(fingerprint_links(nodes, most)), "components")
    rooted = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, most: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near-duplicates stays.

    Of a group, the row with the smallest doc_id stays, null ids last; of rows with equal ids, any
    one. All columns are carried as they are.
    """
    at = F.monotonically_increasing_id()
    numbered = settled(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("at", at), "numbered")
    found = near_duplicates(numbered.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), shingle, most)
    names = numbered.select(F.col("at").alias("doc_id"), F.col("row.doc_id").alias("name"))
    order = F.struct(F.col("name").isNull().alias("last"), F.col("name").alias("name"), F.col("doc_id").alias("at"))
    stays = found.join(names, "doc_id").groupBy("component_id").agg(F.min(order).alias("stays")).select("stays.at")
    return numbered.join(settled(stays, "staying"), "at", "left_semi").select("row.*")
