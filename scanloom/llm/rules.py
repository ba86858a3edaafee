"""Quality rules: base rules and divergence from language references. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import statistics as st
from scanloom.llm.common import let, settled, words_of

MIN_WORDS = 20
REPEATED_PERCENT = 30
#: Common words of a language: its most frequent words of at most so many letters.
COMMON = 32
SHORT = 4
#: Words that all texts of a language must have together to make a reference; below, distances do not judge its texts.
REFERENCE_WORDS = 5000
ALL = ""
#: (words from which they hold, largest class distance, largest word distance): distances are from 0 to 1 and
#: scatter more in short texts. Texts with fewer words than any guard are not judged by distances.
GUARDS = ((300, 0.20, 0.30), (150, 0.22, 0.345), (50, 0.30, 0.42))



def measured(docs: DataFrame, carried: Sequence[str] | None = None) -> DataFrame:
    """``docs`` as the struct ``row`` (of the ``carried`` columns, None: all) beside its counts, read once and settled.

    Besides the base counts: ``classes``, the characters of each class, and ``short``, the histogram of the words of
    one to four letters in lower case. Null text has none of anything.
    """
    own = F.struct(*(docs[c] for c in carried or docs.columns)).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.length("text").cast("long")
    read = docs.select(own, text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"))
    read = read.withColumn("words", words_of(F.col("text")))
    read = read.select(
        "row",
        "text",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        st.total_length(F.col("words")).alias("word_chars"),
        st.count_left(F.col("text"), st.SYMBOLS).alias("n_symbols"),
    )
    short = F.filter(F.transform("words", F.lower), lambda w: (F.length(w) <= SHORT) & w.rlike(r"^\p{L}+$"))
    return settled(
        read.select(
            "row",
            "lang",
            "n_words",
            "word_chars",
            "n_symbols",
            st.duplicate_lines(F.col("text")).alias("n_dup_lines"),
            st.repeated_words(F.col("words")).alias("n_repeat_words"),
            st.class_counts(F.col("text"), length, length - F.col("word_chars"), F.col("n_symbols")).alias("classes"),
            st.histogram(short).alias("short"),
        ),
        "measured",
    )


def references(counts: DataFrame) -> DataFrame:
    """Columns ``ref_lang``, ``ref_classes``, ``common``, ``shares``: the reference of each language of ``measured`` rows.

    Counts are sums over all texts. ``common`` are the language's most frequent words of one to four
    letters, ``shares`` their shares of its words. Every language of ``REFERENCE_WORDS`` words or more has a row, besides
    the row of all documents (language ``""``): no language's row depends on how many others there are.
    """
    names = [f"_{i}" for i in range(len(st.CLASSES) + 2)]
    sums = [F.sum(F.get("classes", F.lit(i))).alias(n) for i, n in enumerate(names)]
    totals = settled(counts.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *sums), "totals")
    pairs = counts.select("lang", F.explode(F.arrays_zip(F.col("short.value").alias("word"), F.col("short.n").alias("n"))).alias("w"))
    words = pairs.groupBy("lang", F.col("w.word").alias("word")).agg(F.sum("w.n").alias("n"))
    words = settled(words, "words")
    own = totals.where((F.col("lang") != ALL) & (F.col("n_words") >= REFERENCE_WORDS))
    every = totals.agg(*(F.sum(n).alias(n) for n in ("n_words", *names))).select(F.lit(ALL).alias("lang"), "n_words", *names)
    chosen = own.union(every.where(F.col("n_words").isNotNull()))
    all_words = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "word", "n")
    listed = words.where(F.col("lang") != ALL).union(all_words).join(chosen.select("lang"), "lang")
    # A language's words are ranked in parts first, so that only its best of each part meet.
    parts = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = listed.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("r", F.row_number().over(parts))
    best = best.where(F.col("r") <= COMMON).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= COMMON)
    top = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    return chosen.join(top, "lang", "left").select(
        F.col("lang").alias("ref_lang"),
        F.array(*(F.col(n).cast("double") for n in names)).alias("ref_classes"),
        F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.transform("top", lambda t: t["n"] / F.col("n_words")), F.array().cast("array<double>")).alias("shares"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two histograms of equal length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judged(docs: DataFrame, carried: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``measured`` with ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    A text is kept if it passes the base rules and, when it is long enough for the guards, stays within both
    distances of its language's reference. A null language is compared with all documents; a language of fewer than
    ``REFERENCE_WORDS`` words has no reference, its texts have null distances and the base rules alone judge them.
    Null and empty texts have no words and fail. References are gathered over all of ``docs``; adaptive execution
    broadcasts them while they are small, and else splits hot languages. An empty table gives an empty one.
    """
    counts = measured(docs, carried)
    refs = settled(references(counts), "references")
    out = counts.join(refs, F.col("lang") == F.col("ref_lang"), "left")

    def uses(common: Column) -> Column:
        at = F.transform(common, lambda w: F.array_position("short.value", w))
        return F.transform(at, lambda i: F.coalesce(F.get("short.n", (i - 1).cast("int")), F.lit(0)).cast("double"))

    def with_rest(parts: Column, whole: Column) -> Column:
        return let(parts, lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), whole - F.aggregate(p, F.lit(0.0), lambda s, x: s + x)))))

    mine = with_rest(uses(F.col("common")), F.col("n_words").cast("double"))
    has = F.col("ref_lang").isNotNull()
    classes = F.transform("classes", lambda x: x.cast("double"))
    out = out.withColumns(
        {
            "class_distance": F.when(has, jensen_shannon(_shares(classes), _shares(F.col("ref_classes")))),
            "word_distance": F.when(has, jensen_shannon(_shares(mine), with_rest(F.col("shares"), F.lit(1.0)))),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    far = F.lit(False)
    for words, most_class, most_word in reversed(GUARDS):
        beyond = (F.col("class_distance") > most_class) | (F.col("word_distance") > most_word)
        far = F.when(F.col("n_words") >= words, beyond).otherwise(far)
    kept = ~failed & ~F.coalesce(far, F.lit(False))
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.withColumn("base_failed", failed).withColumn("kept", kept).select(
        "row", *counted, "class_distance", "word_distance", "base_failed", "kept"
    )
