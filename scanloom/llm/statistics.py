"""Statistics of whole texts as column expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.llm.common import let

SYMBOLS = r"[^#*$%&|<>]+"
NGRAM = 8
#: Character classes, tried in this order; what is in none of them counts as "other".
CLASSES = {
    "lower": r"[^\p{Ll}\p{Lo}]+",
    "upper": r"[^\p{Lu}\p{Lt}]+",
    "digit": r"[^\p{N}]+",
    "mark": r"[^.,;:!?'\"()-]+",
    "symbol": SYMBOLS,
}


def count_left(text: Column, pattern: str) -> Column:
    """Characters that stay when the pattern is removed."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def total_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, n: int = NGRAM) -> Column:
    """Words covered by windows of ``n`` words that occur twice or more in the text, each word once.

    Windows are told apart by a hash of their words' hashes. Only a text with a repeated hash sorts its
    windows; all steps take n log n time in the length of the text.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            def twice(x: Column, j: Column) -> Column:
                return (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])

            return F.sort_array(F.transform(F.filter(p, lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"]))

        def lengths(s: Column) -> Column:
            steps = F.transform(s, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(s, j + 1) - x, F.lit(n))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(placed, starts), lengths)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    return F.when(F.size(words) < n + 1, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), count))


def class_counts(text: Column, length: Column, blanks: Column, symbols: Column) -> Column:
    """Array of long: characters of each of CLASSES, of white space, and of no class; ``symbols`` are counted already."""
    known = [symbols if pattern == SYMBOLS else count_left(text, pattern) for pattern in CLASSES.values()]

    def with_rest(counts: Column) -> Column:
        rest = length - F.aggregate(counts, F.lit(0).cast("long"), lambda n, x: n + x)
        return F.concat(counts, F.array(F.greatest(F.lit(0).cast("long"), rest)))

    return let(F.array(*known, blanks), with_rest)


def histogram(values: Column) -> Column:
    """Struct of ``value``, the distinct elements of an array in order, and ``n``, how often each occurs."""

    def heads(sorted_: Column) -> Column:
        at = F.filter(F.transform(sorted_, lambda x, i: F.when(F.coalesce(x != F.get(sorted_, i - 1), F.lit(True)), i)), lambda i: i.isNotNull())

        def both(h: Column) -> Column:
            n = F.transform(h, lambda i, j: (F.coalesce(F.get(h, j + 1), F.size(sorted_)) - i).cast("long"))
            return F.struct(F.transform(h, lambda i: F.get(sorted_, i)).alias("value"), n.alias("n"))

        return let(at, both)

    return let(F.array_sort(values), heads)
