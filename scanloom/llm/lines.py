"""Removal of repeated three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import same

WINDOW = 3
#: A document is known by its id and two hashes of its text: rows equal in both are one document.
_DOC = ("doc", "h1", "h2")


def _hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _with_key(docs: DataFrame) -> DataFrame:
    h1, h2 = _hashes(F.col("text"))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    keyed = docs.select(row).select("row", F.col("row.doc_id").alias("doc"), F.col("row.text").cast("string").alias("text"))
    return keyed.withColumns({"h1": h1, "h2": h2})


def covered_lines(docs: DataFrame) -> DataFrame:
    """Columns ``doc``, ``h1``, ``h2``, ``covered``: for each document with a later occurrence, its covered lines.

    Every run of three consecutive lines is a window, unless all three are blank. Of equal windows the
    first occurrence stays: the one with the smallest (doc_id, text hash, line), null ids last. Hashes
    are counted by partial aggregation, so that a window in a third of all documents sends a row a task.
    """
    keyed = _with_key(docs.select("doc_id", "text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    at = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    windows = (
        keyed.select(*_DOC, lines.alias("lines"))
        .where(F.size("lines") >= WINDOW)
        .select(*_DOC, F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("lines", i + 1, WINDOW), "\n"))).alias("line", "window"))
        .where(F.length(F.trim("window")) > 0)
        .where(~F.col("window").rlike(r"\A\s*\z"))
    )
    k1, k2 = _hashes(F.col("window"))
    # Struct order: known ids before null ones, then id, text, line.
    place = F.struct(F.col("doc").isNull().alias("n"), *_DOC, "line")
    found = windows.select(k1.alias("k1"), k2.alias("k2"), place.alias("place"))
    firsts = found.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = firsts.where("first <> last").select("k1", "k2", "first")
    later = found.join(firsts, ["k1", "k2"]).where("place <> first")
    spread = later.select("place.doc", "place.h1", "place.h2", F.col("place.line").alias("line"))
    starts = spread.groupBy(*_DOC).agg(F.collect_set("line").alias("starts"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + WINDOW - 1)))
    return starts.select(*_DOC, F.array_sort(F.array_distinct(covered)).alias("covered"))


def cleaned(docs: DataFrame) -> DataFrame:
    """Columns ``row`` (all columns of ``docs`` as they are), ``text``, ``n_lines``, ``n_removed``, ``n_spans``: one for each row.

    ``text`` holds the lines no later window covers, joined by a newline; overlapping windows are
    merged, and ``n_spans`` counts the runs of removed lines. Null text stays null with no lines;
    an empty text has one empty line; texts of fewer than three lines are unchanged. Rows with the same
    id and text are one document and get the same result each.
    """
    keyed = _with_key(docs)
    covered = covered_lines(docs)
    joined = keyed.join(covered, same(keyed, covered, _DOC), "left").select(
        "row", "text", F.coalesce("covered", F.array().cast("array<int>")).alias("covered")
    )
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")
    rebuilt = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    # A run of removed lines starts where the line before was not removed.
    runs = F.size("covered") - F.size(F.array_intersect("covered", F.transform("covered", lambda i: i + 1)))
    return (
        joined.withColumn("lines", lines)
        .withColumn("kept", kept)
        .select(
            "row",
            F.when(F.size("covered") == 0, F.col("text")).otherwise(rebuilt).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
            F.size("covered").cast("long").alias("n_removed"),
            runs.cast("long").alias("n_spans"),
        )
    )
