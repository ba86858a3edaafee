"""Quality classifier: rules from tree paths, weighted by a lasso, compiled into column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import statistics as st
from scanloom.llm.common import let, settled, words_of

#: About so many labelled rows train the rules, chosen by a hash of their id; all of them if there are fewer.
TRAIN_ROWS = 60_000
TREES, DEPTH = 12, 3
LASSO = 0.001
SEED = 7


def statistics_of(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, with its words in the column ``words``: doubles, never null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.col("words")
    chars = F.length(text).cast("double")
    n = F.size(words).cast("double")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    lower = F.transform(words, F.lower)
    again = let(words, lambda ws: F.size(F.filter(ws, lambda w, i: F.coalesce(w == F.get(ws, i - 1), F.lit(False)))))
    out = {
        "log_words": F.log1p(n),
        "word_length": share(st.total_length(words).cast("double"), n),
        "short_share": share(F.size(F.filter(words, lambda w: F.length(w) <= 4)).cast("double"), n),
        "long_share": share(F.size(F.filter(words, lambda w: F.length(w) > 12)).cast("double"), n),
        "bare_share": share(F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("double"), n),
        "again_share": share(again.cast("double"), n),
        "distinct_share": share(let(lower, lambda ws: F.size(F.array_distinct(ws))).cast("double"), n),
        "words_per_line": share(n, F.size(lines).cast("double")),
        "repeated_lines": share(st.duplicate_lines(text).cast("double"), F.size(lines).cast("double")),
        "exclaimed_share": share(st.count_left(text, r"[^!?]+").cast("double"), n),
    }
    out |= {f"{name}_share": share(st.count_left(text, pattern).cast("double"), chars) for name, pattern in st.CLASSES.items()}
    return {name: out[name] for name in FEATURES}


#: Names of the statistics, in the order the trees see them.
FEATURES = [
    "log_words",
    "word_length",
    "short_share",
    "long_share",
    "bare_share",
    "again_share",
    "distinct_share",
    "words_per_line",
    "repeated_lines",
    "exclaimed_share",
    *(f"{name}_share" for name in st.CLASSES),
]


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: feature, above (exclusive) or None, at most or None."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for feature, above, most in self.bounds:
            if above is not None:
                met = met & (F.col(feature) > above)
            if most is not None:
                met = met & (F.col(feature) <= most)
        return met


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(node, bounds: dict[str, tuple[float | None, float | None]], found: set[Rule]) -> None:
    """Every path from the root to a node below it is a rule."""
    if bounds:
        found.add(Rule(tuple((f, *bounds[f]) for f in sorted(bounds))))
    if node.getClass().getSimpleName() == "LeafNode":
        return
    feature, at = FEATURES[node.split().featureIndex()], float(node.split().threshold())
    above, most = bounds.get(feature, (None, None))
    _paths(node.leftChild(), {**bounds, feature: (above, at if most is None else min(at, most))}, found)
    _paths(node.rightChild(), {**bounds, feature: (at if above is None else max(at, above), most)}, found)


def fit(rows: DataFrame) -> RuleModel:
    """Fits a model on ``rows``, the statistics with ``label`` (0.0 or 1.0), read several times.

    A random forest grows the trees; its paths become rules, and a logistic regression with an L1
    penalty keeps a few of them. Without rows of both labels the score is the share of label 1, one half
    without any row.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else 0.99 if 1.0 in counts else 0.01
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = rows.select("label", *FEATURES, array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="onethird")
    found: set[Rule] = set()
    for tree in forest.fit(vectors).trees:
        _paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(found, key=lambda r: repr(r.bounds))
    if not rules:
        share = counts[1.0] / sum(counts.values())
        return RuleModel(math.log(share / (1 - share)), ())
    met = settled(rows.select("label", F.array(*(r.column().cast("double") for r in rules)).alias("met")), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60)
    model = lasso.fit(met.select("label", array_to_vector("met").alias("features")))
    weights = model.coefficients.toArray().tolist()
    return RuleModel(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id`` and FEATURES of every row, over the whole text; null texts count as empty."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("words", words_of(F.col("text")))
    return read.select("doc_id", *(c.cast("double").alias(n) for n, c in statistics_of(F.col("text")).items()))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``held_out``, ``score``, ``predicted``: one row for each row of ``docs``.

    Statistics are computed once and settled. Rows with a label of 0 or 1 whose id is not held out train
    the model; labels that are null or other numbers, of unknown or null ids are ignored, and a document with several
    labels trains with each. An empty table gives an empty one; other columns are not read.
    """
    known = settled(text_statistics(docs), "statistics")
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    label = label.where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    share = min(1.0, TRAIN_ROWS / max(1, label.count()))
    chosen = label.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) < share) if share < 1 else label
    model = fit(settled(chosen.join(known, "doc_id").select("label", *FEATURES), "training"))
    out = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
