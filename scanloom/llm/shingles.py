"""Near-duplicates by word shingles: SimHash fingerprints and MinHash bands find candidates, the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from scanloom.llm.common import settled
from scanloom.llm.components import connected_components
from scanloom.llm.simhash import MOST_BITS, fingerprint, fingerprint_links

#: Jaccard similarity of the sets of word shingles from which two documents are near-duplicates.
SIMILAR = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8, 0.9999998 at 0.9.
BANDS, ROWS = 20, 6
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 12
_FLIP, _TIMES = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_TIMES |= np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """The words of a text between ASCII white space, ASCII letters in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def hashes(found: list[bytes], shingle: int = 5) -> np.ndarray:
    """The sorted set of the XXH64 of all word shingles; of all words at once if there are fewer than a shingle."""
    if not found:
        return np.empty(0, np.uint64)
    last = max(1, len(found) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[k : k + shingle]), 42) for k in range(last)), np.uint64, last))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of ``hashes``; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the MinHash of a set; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        np.minimum(least, ((found[at : at + _BLOCK, None] ^ _FLIP) * _TIMES).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _marked(numbered: DataFrame, shingle: int) -> DataFrame:
    """Columns ``at``, ``name``, ``same`` (a hash of all words), ``bits`` (SimHash), ``keys`` for ``at``, ``name``, ``text``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, bits, keys = [], [], []
            for text in batch.column(2):
                found = words(text.as_py())
                bits.append(fingerprint(text.as_py(), shingle))
                same.append(xxhash.xxh3_128_digest(b" ".join(found)))
                keys.append(bands(hashes(found, shingle)))
            columns = [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(bits, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "name", "same", "bits", "keys"])

    added = [StructField("same", BinaryType()), StructField("bits", LongType()), StructField("keys", ArrayType(LongType()))]
    return numbered.mapInArrow(apply, StructType([*numbered.select("at", "name").schema.fields, *added]))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Columns ``at``, ``found`` (binary: the ``hashes`` as little-endian 64-bit numbers), ``size`` for ``at``, ``text``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                every = [hashes(words(t.as_py()), shingle) for t in part.column(1)]
                columns = [part.column(0), pa.array([e.astype("<u8").tobytes() for e in every], pa.binary()), pa.array([len(e) for e in every], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "found", "size"])

    return texts.select("at", "text").mapInArrow(apply, "at long, found binary, size long")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``u``, ``v`` of ``pairs`` whose ``sets`` have similarity ``least`` or more."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for u, v, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                if similarity(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= least:
                    hits.append((u.as_py(), v.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["u", "v"])

    first = sets.select(F.col("at").alias("at_u"), F.col("found").alias("set_u"))
    second = sets.select(F.col("at").alias("at_v"), F.col("found").alias("set_v"))
    read = pairs.join(first, F.col("u") == F.col("at_u")).join(second, F.col("v") == F.col("at_v"))
    return read.select("u", "v", "set_u", "set_v").mapInArrow(apply, "u long, v long")


def _numbers(sets: DataFrame) -> DataFrame:
    """A row ``node``, ``size``, ``number`` for each hash of each set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found, size in zip(*(batch.column(k) for k in range(3)), strict=True):
                numbers = pa.array(np.frombuffer(found.as_buffer(), "<i8"))
                same = [pa.array(np.full(len(numbers), x.as_py(), np.int64)) for x in (at, size)]
                yield pa.RecordBatch.from_arrays([*same, numbers], names=["node", "size", "number"])

    return sets.select("at", "found", "size").mapInArrow(apply, "node long, size long, number long")


def possible_pairs(sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Columns ``u``, ``v``: all pairs of ``sets`` (at, found, size, root) of unlike ``root`` that can have similarity ``least``.

    No such pair is missing. In one order of all hashes, rarest first, two similar sets meet before either has more than a
    share 1 - least of its hashes behind it; and where they first meet, the hashes that are left must suffice for the
    similarity. So a passage that many share pairs nobody: it is not among their rarest hashes, and those whose own hashes
    alone keep them apart have too few left.
    """
    numbers = settled(_numbers(sets), "numbers")
    shared = numbers.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = numbers.join(shared, "number").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "number"))).alias("held"))
    # Hashes that no other set has come first and meet nothing: they only move the others back.
    alone = F.col("size") - F.size("held")
    prefix = (F.floor(F.col("size") * F.lit(1 - least) + F.lit(1e-9)) + 1 - alone).cast("int")
    kept = held.where(prefix > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("nth", "entry"))
    left_over = F.col("size") - F.col("alone") - F.col("nth")
    rooted = sets.select(F.col("at").alias("of"), "root")
    entries = kept.select("node", "size", left_over.alias("rest"), F.col("entry.number").alias("number"))
    entries = settled(entries.join(rooted, F.col("node") == F.col("of")).drop("of"), "prefixes")
    several = entries.groupBy("number").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = settled(entries.join(several.select("number"), "number", "left_semi"), "meeting")
    right = left.select(*(F.col(c).alias(f"{c}_v") for c in left.columns))
    enough = F.least("rest", "rest_v") * F.lit(1 + least) + F.lit(1e-6) >= (F.col("size") + F.col("size_v")) * F.lit(least)
    pairs = left.join(right, (F.col("number") == F.col("number_v")) & (F.col("root") < F.col("root_v")) & enough)
    return pairs.select(F.col("node").alias("u"), F.col("node_v").alias("v")).distinct()


def near_pairs(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Columns ``u``, ``v``: the links of SimHash between ``nodes`` (node, bits), ``most`` differing bits at most.

    Nodes with the same fingerprint are paired with the first of them, which stands for them in the links of ``simhash``.
    """
    first = settled(nodes.groupBy("bits").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(first, "bits").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    links = fingerprint_links(first.select("bits"), most)
    named = [first.select(F.col("bits").alias(c), F.col("first").alias(f"first_{c}")) for c in ("u", "v")]
    return equal.union(links.join(named[0], "u").join(named[1], "v").select("first_u", "first_v"))


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near-duplicates stays.

    Documents whose sets of shingles have Jaccard similarity ``least`` or more are linked, and links connect groups.
    Rows with the same words are one node. Nodes that SimHash links, by fingerprints of ``MOST_BITS`` differing bits at most,
    are candidates, and so are nodes that share a band of their MinHash, as pairs near ``least`` differ in more bits; only
    candidates similar on their whole sets are linked. In each band's bucket all members are compared with its most
    typical one first, which shares the most with others over all its bands. Where that leaves a bucket in several
    groups, all its members go through ``possible_pairs``, which leaves out only pairs that cannot be similar or are
    linked already. No bucket is capped. Texts without words are one group.

    Of a group, the row with the smallest doc_id stays, null ids last; of rows with equal ids, any
    one. All columns are carried as they are.
    """
    at = F.monotonically_increasing_id()
    numbered = settled(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("at", at), "numbered")
    narrow = numbered.select("at", F.col("row.doc_id").alias("name"), F.col("row.text").cast("string").alias("text"))
    marked = settled(_marked(narrow, shingle), "marked")
    order = F.struct(F.col("name").isNull().alias("last"), "name", "at")
    nodes = marked.groupBy("same").agg(F.min(order).alias("stays"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    nodes = settled(nodes.select("same", "stays", F.col("stays.at").alias("node"), "bits", "keys"), "nodes")
    fingered = settled(near_pairs(nodes.select("node", "bits")), "near-pairs")

    entries = nodes.select(F.explode("keys").alias("key"), "node")
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Without the hint the planner takes the size before the explode for the size of a side.
    members = settled(entries.hint("merge").join(counts, "key"), "members")
    typical = members.groupBy("node").agg(F.sum("n").alias("met"))
    best = members.select("key", "node").join(typical, "node").groupBy("key").agg(F.min(F.struct(-F.col("met"), "node")).alias("best"))
    members = settled(members.join(best.select("key", F.col("best.node").alias("centre")), "key"), "centred")
    ends = [fingered.select(F.col(c).alias("node")) for c in ("u", "v")]
    asked = settled(members.select("node").union(ends[0]).union(ends[1]).distinct(), "asked")
    sets = settled(_sets(narrow.join(asked, F.col("at") == F.col("node"), "left_semi"), shingle), "sets")

    stars = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    stars = settled(stars.union(fingered).distinct(), "stars")
    links = settled(_similar(stars, sets, least), "star-links")
    roots = settled(connected_components(links), "roots").withColumnRenamed("node", "of")
    grouped = members.where("n > 2").join(roots, F.col("node") == F.col("of"), "left")
    grouped = settled(grouped.select("key", "node", F.coalesce("root", "node").alias("root")), "grouped")
    several = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = settled(grouped.join(several.select("key"), "key", "left_semi").select("node", "root").distinct(), "apart")
    pairs = settled(possible_pairs(sets.join(apart, F.col("at") == F.col("node")).drop("node"), least), "pairs")
    links = links.union(settled(_similar(pairs, sets, least), "pair-links"))

    roots = settled(connected_components(links), "components").withColumnRenamed("node", "of")
    rooted = nodes.join(roots, F.col("node") == F.col("of"), "left").select("stays", F.coalesce("root", "node").alias("root"))
    stay = settled(rooted.groupBy("root").agg(F.min("stays").alias("stays")).select("stays.at"), "staying")
    going = settled(marked.select("at").join(stay, "at", "left_anti"), "going")
    return numbered.join(going, "at", "left_anti").select("row.*")
