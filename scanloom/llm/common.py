"""What several corpus operators share: settled tables, exact ranks, bound values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import fresh_path

#: Everything but the six ASCII white-space characters makes a word.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def running(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], measure: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``measure`` over the rows of the group that come before, by ``bucket``, then ``order``.

    No group meets in one task: rows are summed within (group, bucket), and a bucket starts at the
    sum of the group's earlier buckets. Buckets must be chosen so that one fits a task. ``df`` is read
    twice; settle it before if its rows are costly or not repeatable.
    """
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg(F.sum(measure).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).cast("long").alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_before", F.coalesce(F.sum(measure).over(within), F.lit(0)).cast("long"))
    return summed.join(starts, same(summed, starts, keys)).select(
        *(summed[c] for c in df.columns), (F.col("_before") + F.col("_start")).alias(name)
    )


def ranked(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the 0-based rank of each row in its group, see ``running``."""
    return running(df, group, bucket, order, F.lit(1), name)


def placed(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` settled in the order given, with ``name``: the 0-based place of each row. Rows equal in the order go in any.

    One range exchange; equal rows are spread over tasks. A row's place is its place in its task plus the rows of the
    tasks before: prefix sums over a number a task.
    """
    ordered = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie")
    kept = settled(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("_at", 33)
    starts, start = [], 0
    for row in kept.groupBy(task.alias("task")).count().orderBy("task").collect():
        starts.append((row.task, start))
        start += row["count"]
    # A row a task, so that it is small enough to be sent to each.
    bases = df.sparkSession.createDataFrame(starts, "_task long, _base long")
    joined = kept.join(F.broadcast(bases), task == F.col("_task"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*df.columns, (F.col("_base") + within).alias(name))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
