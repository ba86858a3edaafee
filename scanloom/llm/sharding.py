"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import ranked, settled

#: Partitions whose counts are drawn together on the driver or in one task.
FAN = 1024
#: Rows ordered together in the last permutation.
BUCKET = 1 << 16


def _rng(seed: int, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed, *place])


def draw(sizes: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Matrix with row sums ``sizes`` and column sums ``wanted``: how many rows each part sends to each shard.

    Rows are drawn one after the other from a multivariate hypergeometric law of what is left, which
    gives the counts of a uniform shuffle of all rows.
    """
    left = np.asarray(wanted, np.int64).copy()
    matrix = np.zeros((len(sizes), len(left)), np.int64)
    for i, size in enumerate(sizes):
        need = int(size)
        rest = int(left.sum())
        for j, have in enumerate(left):
            if not need:
                break
            rest -= int(have)
            got = need if not rest else _hypergeometric(rng, int(have), rest, need)
            matrix[i, j] = got
            need -= got
        left -= matrix[i]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One draw; beyond numpy's limit of 10**9 rows by inversion, over 12 deviations and 200 counts to each side of the mode."""
    if not good or not drawn:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    share = good / (good + bad)
    deviation = (drawn * share * (1 - share) * (good + bad - drawn) / max(1, good + bad - 1)) ** 0.5
    mode, width = (drawn + 1) * (good + 1) // (good + bad + 2), int(12 * deviation) + 200
    low, high = max(0, drawn - bad, mode - width), min(good, drawn, mode + width)
    k = np.arange(low, high, dtype=np.float64)
    # Logarithms of the ratio of each count's probability to the one before.
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards get the rest."""
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def shuffled(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The struct ``row`` of every row with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    1. Rows are settled with their part (the task that wrote them) and number in it, and parts are counted.
    2. The counts each part sends to each shard are drawn: on the driver for groups of ``FAN`` parts, then
       in one task for the parts of each group.
    3. Each part permutes its rows by a seeded random permutation and deals them out by its counts.
    4. Each shard permutes what it got: rows are ordered by a random key, split by its first bits so
       that no task orders a whole shard.

    Sizes differ by at most one, whatever the texts: equal rows and hot sources spread like any
    others. The result depends on the rows' order and the seed alone, and repeats after a lost executor. Empty
    input gives an empty table; any columns, nulls and repeated rows are carried as they are.
    """
    whole = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("row"))
    at = whole.withColumn("at", F.monotonically_increasing_id())
    fixed = settled(at, "rows").withColumn("part", F.shiftright("at", 33).cast("long")).withColumn("nth", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = settled(fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("fan", F.floor(F.col("part") / FAN)), "parts")
    fans = sizes.groupBy("fan").agg(F.sum("n").alias("n")).orderBy("fan").collect()
    total = sum(r["n"] for r in fans)
    top = draw(np.array([r["n"] for r in fans], np.int64), shard_sizes(total, shards), _rng(seed, 1))
    wanted = {r["fan"]: counts.tolist() for r, counts in zip(fans, top, strict=True)}
    lists = rows.sparkSession.createDataFrame([(f, c) for f, c in wanted.items()], "fan long, wanted array<long>")

    def counts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        matrix = draw(part["n"].to_numpy(), np.array(part["wanted"].iloc[0], np.int64), _rng(seed, 2, int(part["fan"].iloc[0])))
        return pd.DataFrame({"part": part["part"].to_numpy(), "n": part["n"].to_numpy(), "counts": list(matrix)})

    matrix = settled(sizes.join(lists, "fan").groupBy("fan").applyInPandas(counts, "part long, n long, counts array<long>"), "matrix")

    def deal(places: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(places):
            return pd.DataFrame({"at": [], "shard": []})
        n, part = int(drawn["n"].iloc[0]), int(drawn["part"].iloc[0])
        stops = np.cumsum(np.array(drawn["counts"].iloc[0], np.int64))
        place = _rng(seed, 3, part).permutation(n)[places["nth"].to_numpy()]
        return pd.DataFrame({"at": places["at"].to_numpy(), "shard": np.searchsorted(stops, place, side="right")})

    narrow = fixed.select("part", "nth", "at")
    dealt = narrow.groupBy("part").cogroup(matrix.groupBy("part")).applyInPandas(deal, "at long, shard int")
    key = F.xxhash64(F.lit(seed), "at")
    buckets = max(1, -(-total // shards // BUCKET))
    keyed = dealt.select("at", "shard", key.alias("key"))
    keyed = keyed.withColumn("bucket", F.floor((key / F.lit(2.0**64) + 0.5) * buckets))
    keyed = settled(keyed, "dealt")
    slots = ranked(keyed, ["shard"], "bucket", ["key", "at"], "slot").select("at", "shard", "slot")
    return fixed.join(slots, "at").select("row", "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
