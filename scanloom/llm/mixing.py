"""Mixing of sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import ranked, same, settled

#: Documents of a source that stay together.
BLOCK = 32
#: Slots that are scheduled together; sources that have ended are left out from the next period on.
PERIOD = 1000
#: Documents ordered together when ranks are given.
BUCKET = 1 << 12
#: Slots that a range of the written order has.
RANGE = 128


def shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Blocks of each source in one period, in proportion to the weights: largest remainders, one at least."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if not weights:
        return {}
    names = sorted(weights, key=lambda s: (s is None, s))
    period = max(period, len(names))
    total = float(sum(weights.values()))
    exact = {s: weights[s] / total * period for s in names}
    blocks = {s: max(1, int(exact[s])) for s in names}
    while (gap := period - sum(blocks.values())) != 0:
        step = 1 if gap > 0 else -1
        open_ = [s for s in names if step > 0 or blocks[s] > 1]
        order = sorted(open_, key=lambda s: (step * (blocks[s] - exact[s]), names.index(s)) if len(names) < 2000 else step * (blocks[s] - exact[s]))
        for s in order[: abs(gap)]:
            blocks[s] += step
    return blocks


def schedule(blocks: Mapping[str | None, int]) -> list[str | None]:
    """The source of each slot of one period, with weight blocks / period: see ``_Run``."""
    names = sorted(blocks, key=lambda s: (s is None, s))
    whole = sum(blocks.values())
    run = _Run([Fraction(blocks[s], whole) for s in names], [blocks[s] for s in names], [0] * len(names))
    return [names[k] for _, k, _ in run.until(0, whole)]


class _Run:
    """Of the released blocks of all sources the one with the earliest deadline, slot by slot.

    With weight w, a source's block i is released at floor(i / w) and due at ceil((i + 1) / w). The weights are
    fractions that sum to one, so that earliest deadline first meets every deadline and every source is less
    than one block away from its share at every slot, however long the run. ``ends`` has the number of blocks
    of each source, ``done`` how many of them are placed.
    """

    def __init__(self, weights: list[Fraction], ends: list[int], done: list[int]) -> None:
        self.up = [w.numerator for w in weights]
        self.down = [w.denominator for w in weights]
        self.ends, self.done = ends, list(done)

    def _window(self, k: int, i: int) -> tuple[int, int]:
        return i * self.down[k] // self.up[k], -(-(i + 1) * self.down[k] // self.up[k])

    def until(self, slot: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """Slot, source and block of the slots from ``slot`` to before ``stop``, a period.

        A source that ends in the period keeps its slots to the period's end, beyond its last block; later periods
        leave it out, which takes load away and lets no deadline slip.
        """
        waiting = []
        for k, i in enumerate(self.done):
            if i < self.ends[k]:
                release, due = self._window(k, i)
                if release < stop:
                    waiting.append((max(slot, release), due, k, i))
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        while slot < stop:
            while waiting and waiting[0][0] <= slot:
                _, due, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, k, i))
            if not ready:
                if not waiting:
                    return
                slot = waiting[0][0]
                continue
            _, k, i = heapq.heappop(ready)
            yield slot, k, i
            self.done[k] = i + 1
            slot += 1
            release, due = self._window(k, i + 1)
            if release < stop:
                heapq.heappush(waiting, (max(slot, release), due, k, i + 1))

    def following(self, slot: int) -> int | None:
        """The first slot from ``slot`` on in which a block is released; None after the last."""
        open_ = [self._window(k, i)[0] for k, i in enumerate(self.done) if i < self.ends[k]]
        return max(slot, min(open_)) if open_ else None


class _Plan:
    """Schedule of the sources of ``keyed`` rows; a number a source is collected for it.

    The driver runs through the schedule once and keeps only how many blocks each source has placed at the start of
    each stretch of some periods; tasks run the stretches again and write the slots of all blocks.
    """

    def __init__(self, keyed: DataFrame, weights: Mapping[str | None, float] | None, block: int, period: int) -> None:
        spark = keyed.sparkSession
        sizes = {r["source"]: r["n"] for r in keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if weights is None:
            targets = {s: n**0.5 for s, n in sizes.items()}
        else:
            least = min(weights.values(), default=1.0)
            targets = {s: weights.get(s, least) for s in sizes}
        if any(not w > 0 for w in targets.values()):
            raise ValueError("weights must be positive")
        names = sorted(targets, key=lambda s: (s is None, s))
        total = sum((Fraction(targets[s]) for s in names), Fraction(0))
        exact = [Fraction(targets[s]) / total for s in names]
        ends = [-(-sizes[s] // block) for s in names]
        period = max(period, len(names))
        self.block = block
        self.buckets = max(1, -(-sum(sizes.values()) // BUCKET))
        # A stretch has so many slots that the numbers kept of it are few beside its blocks.
        stretch = max(1, -(-16 * len(names) // period)) * 16
        run = _Run(exact, ends, [0] * len(names))
        starts: list[tuple[list[int], list[int], list[int]]] = []
        slot, left = run.following(0), 0
        while slot is not None:
            slot -= slot % period
            if not left:
                starts.append(([], [k for k, i in enumerate(run.done) if i < ends[k]], [i for k, i in enumerate(run.done) if i < ends[k]]))
                left = stretch
            starts[-1][0].append(slot)
            for _ in run.until(slot, slot + period):
                pass
            slot, left = run.following(slot + period), left - 1
        table = pa.table([pa.array(c, pa.list_(pa.int64())) for c in zip(*starts, strict=True)] if starts else [pa.array([], pa.list_(pa.int64()))] * 3, ["at", "source", "done"])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, sources, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    done = list(ends)
                    for k, i in zip(sources, before, strict=True):
                        done[k] = i
                    again = _Run(exact, ends, done)
                    rows = [(names[k], i, t) for a in at for t, k, i in again.until(a, a + period) if i < ends[k]]
                    columns = zip(*rows, strict=True) if rows else ([], [], [])
                    kinds = (pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["slot_source", "nth", "slot"])

        # Written first, so that the planner knows its size and broadcasts it only while it is small.
        sent = spark.createDataFrame(table, "at array<long>, source array<long>, done array<long>")
        self.slots = settled(sent.repartition(max(1, min(len(starts), 200))).mapInArrow(apply, "slot_source string, nth long, slot long"), "slots")

    def bucketed(self, keyed: DataFrame) -> DataFrame:
        """Adds ``bucket`` by the first bits of ``key``: buckets follow the order of the keys."""
        number = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
        return keyed.withColumn("bucket", F.floor(number * self.buckets / float(1 << 48)))

    def timed(self, order: DataFrame) -> DataFrame:
        """Adds ``block``, ``slot`` and ``place`` to rows that have ``source`` and their ``rank`` in it."""
        columns = order.columns
        order = order.withColumn("block", F.floor(F.col("rank") / self.block))
        order = order.join(self.slots, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("nth")))
        return order.select(*columns, "block", "slot", (F.col("rank") % self.block).cast("int").alias("place"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(*docs.columns).alias("tie"),
    )


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The struct ``row`` of every row with ``source``, ``block``, ``slot`` and ``place``: sorted by the last two, the mix.

    A source's documents are ordered by md5 of their id and cut into blocks of ``block`` documents; block
    i of a source runs in slot ``slot``. The weights are exact over the whole run: while a source lasts it is less than
    a block away from its weight at every slot, whatever the weight and the number of sources. When a source has
    ended its share of the slots stays empty and the others keep their proportions: no row is dropped or repeated.

    ``weights`` names the target weight of each source; sources without one get the smallest weight named.
    None: the square root of each source's number of documents. A null source is a source of its own.
    Equal ids are ordered by a hash of the whole row; repeated rows stay. Ranks are counted by the first bits of
    the md5, so that a source with a third of all rows is spread. An empty table gives an empty one.
    """
    keyed = _keyed(docs)
    plan = _Plan(keyed, weights, block, period)
    order = ranked(plan.bucketed(keyed), ["source"], "bucket", ["key", "tie"], "rank")
    return plan.timed(order).select("row", "source", "block", "slot", "place")


def mixed_order(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD
) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, split by ranges of slots.

    Slots are found on keys and sources alone. From them comes, for each bucket of a source, a short list of
    cuts: the first key of each range of slots and its rank. With it a whole row knows its range before it
    moves, moves once, and is ranked among the rows of its cut. ``docs`` is read again for that and must
    give the same rows each time. Rows equal in every column stay in one range.
    """
    keyed = _keyed(docs)
    plan = _Plan(keyed, weights, block, period)
    narrow = plan.bucketed(keyed.select("source", "key", "tie"))
    timed = plan.timed(ranked(narrow, ["source"], "bucket", ["key", "tie"], "rank"))
    firsts = timed.groupBy("source", "bucket", "key", "tie").agg(
        F.min("rank").alias("rank"), F.min("slot").alias("slot"), F.min("block").alias("block")
    )
    inside = F.struct("block", F.pmod("slot", F.lit(RANGE)).cast("short").alias("slot"))
    ranges = firsts.groupBy("source", "bucket", F.floor(F.col("slot") / RANGE).alias("range")).agg(
        F.min(F.struct("key", "tie")).alias("first"), F.min("rank").alias("start"), F.sort_array(F.collect_set(inside)).alias("blocks")
    )
    # The blocks of a cut and their slots in its range go along with each row, a few bytes a block.
    nths = F.transform("blocks", lambda b: (b["block"] - F.get("blocks", F.lit(0))["block"]).cast("int"))
    cut = F.struct("first", "range", "start", nths.alias("nths"), F.col("blocks.slot").alias("slots"))
    cuts = ranges.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    # Written first, so that the planner knows its size and joins it where the rows are while it is small.
    cuts = settled(cuts, "cuts")
    whole = plan.bucketed(keyed)
    cut = F.element_at(F.filter("cuts", lambda c: c["first"] <= F.struct("key", "tie")), -1)
    found = whole.join(cuts, same(whole, cuts, ["source", "bucket"])).select(
        "row", whole["source"], whole["bucket"], "key", "tie", cut.alias("cut")
    )
    found = found.select("row", "source", "bucket", "key", "tie", "cut.range", "cut.start", "cut.nths", "cut.slots").repartitionByRange("range")
    within = Window.partitionBy("range", "source", "bucket").orderBy("key", "tie")
    order = found.withColumn("rank", F.row_number().over(within) - 1 + F.col("start"))
    nth = F.floor(F.col("rank") / block) - F.floor(F.col("start") / block)
    # Only equal rows can be of a block that the cut does not list: they stay in the one before.
    slot = F.element_at("slots", F.size(F.filter("nths", lambda n: n <= nth)))
    placed = order.withColumn("slot", F.col("range") * RANGE + slot).withColumn("place", F.col("rank") % block)
    return placed.sortWithinPartitions("slot", "place").select("row.*")
