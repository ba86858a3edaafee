"""Advisories over version ranges: orderings of two families of versions and an index of intervals.

A version becomes a text that sorts as the version does, so ranges are plain comparisons. Per package name the ends of all
ranges cut the versions into numbered segments. A range covers a run of segments, which is the union of few nodes of a
binary tree over them; a segment lies in one node a level. So ranges meet segments by equality of nodes, without
comparing each range with each version, and packages meet what covers their segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEMVER, DEBIAN = "semver", "debian"

#: Parts that a name's packages are split into, as one name may hold a third of them.
SALTS = 16
#: Ends of ranges a name may have: 2 to this power.
LEVELS = 24


def _number(digits: Column) -> Column:
    """Digits of any length, so that texts sort by value."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)


def semver_key(version: Column) -> Column:
    """Sort key of ``1.2.3-rc.1+build``; null for null.

    A leading v and build marks are dropped, missing parts count as zero, parts that are no number as well. A
    pre-release comes before its release; its labels compare one by one, numbers by value and
    before words, and fewer labels come first.
    """
    bare = F.regexp_replace(F.trim(version), r"^[vV]|\+.*$", "")
    halves = F.split(bare, "-", 2)
    parts = F.split(halves[0], r"\.")
    digits = F.transform(parts, lambda part: F.when(part.rlike(r"^\d+$"), F.ltrim(part, F.lit("0"))).otherwise(""))
    used = F.array_max(F.transform(digits, lambda part, i: F.when(part != "", i + 1).otherwise(0)))
    numbers = F.transform(F.slice(digits, F.lit(1), used), lambda part: F.concat(F.lit("N"), _number(part)))
    label = lambda part: F.when(part.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(part))).otherwise(F.concat(F.lit("1"), part))
    labels = F.transform(F.split(F.get(halves, F.lit(1)), r"\."), lambda part: F.concat(label(part), F.lit("!")))
    # Marks sort as needed: "!" ends a list and is below all that may go on, "~" is a release and above all labels.
    rest = F.coalesce(F.concat(F.array_join(labels, ""), F.lit("!")), F.lit("~"))
    return F.concat(F.array_join(numbers, ""), F.lit("!"), rest)


def _alternating(text: Column) -> Column:
    """Runs of other characters and of digits in turn: ``~`` before the end, the end before letters, letters before the rest."""
    pairs = F.filter(F.regexp_extract_all(text, F.lit(r"\D*\d*"), F.lit(0)), lambda pair: pair != "")

    def encoded(pair: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(pair, r"\d+$", ""), r"([^A-Za-z~])", "3$1")
        words = F.translate(F.regexp_replace(words, r"([A-Za-z])", "2$1"), "~", "0")
        return F.concat(words, F.lit("1"), _number(F.regexp_extract(pair, r"\d+$", 0)))

    return F.concat(F.array_join(F.transform(pairs, encoded), ""), F.lit("1"))


def debian_key(version: Column) -> Column:
    """Sort key of ``epoch:upstream-revision``; null for null. A missing epoch or revision is 0."""
    text = F.trim(version)
    epoch = F.regexp_extract(text, r"^(\d+):", 1)
    rest = F.regexp_replace(text, r"^\d+:", "")
    revision = F.when(F.contains(rest, F.lit("-")), F.substring_index(rest, "-", -1)).otherwise("0")
    upstream = F.regexp_replace(rest, r"-[^-]*$", "")
    return F.concat(_number(epoch), _alternating(upstream), _alternating(F.when(revision == "", "0").otherwise(revision)))


def version_key(ecosystem: Column, version: Column) -> Column:
    """Sort key by the ecosystem's rule; any but Debian's goes by semantic versions. Keys compare within an ecosystem."""
    return F.when(ecosystem == DEBIAN, debian_key(version)).otherwise(semver_key(version))


def _at_or_below(points: Column, key: Column) -> Column:
    """How many of the sorted points are at or below the key, by binary search."""

    def halved(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(points, middle) <= key
        open_ = span["low"] < span["high"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(span["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(points) + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(points).alias("high")), halved)["low"]


def _nodes(first: Column, end: Column) -> Column:
    """Nodes of the tree whose union is the segments from ``first`` up to, without, ``end``: at most two a level."""

    def level(state: Column, at: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        node = lambda n: F.struct(at.alias("level"), n.cast("int").alias("node"))
        found = F.array_compact(F.array(F.when(left, node(a)), F.when(right, node(b - 1))))
        return F.struct(
            F.floor((a + left.cast("int")) / 2).cast("int").alias("a"),
            F.floor((b - right.cast("int")) / 2).cast("int").alias("b"),
            F.concat(state["nodes"], found).alias("nodes"),
        )

    none = F.array().cast("array<struct<level:int,node:int>>")
    start = F.struct(first.cast("int").alias("a"), end.cast("int").alias("b"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, level)["nodes"]


def ranged_findings(packages: DataFrame, advisories: DataFrame, salts: int = SALTS) -> DataFrame:
    """Packages (scan_id, scan_root, path, ecosystem, name, version) with each advisory that covers them, in the package dialect.

    ``advisories`` (ecosystem, name, id, severity, title, ranges) hold any number of ``ranges`` (introduced, fixed): from
    ``introduced`` on, or from the first version where it is null, up to the version before ``fixed``, or without end. Ranges
    may overlap, also within an advisory, which is found once then with its nearest fix; an empty range covers nothing.
    Packages without a name or version and advisories without a name match nothing; a null ecosystem is
    one of its own, ordered as semantic versions. Repeated packages are found each, repeated advisories once.

    Work follows the packages, the ranges and the matches. The ends of a name's ranges travel as one row.
    """
    eco = F.coalesce("ecosystem", F.lit("")).alias("__eco")
    spans = advisories.where(F.col("name").isNotNull()).select(
        eco, F.col("name").alias("__name"), F.col("id").alias("__id"), "severity", "title", F.explode("ranges").alias("__r")
    )
    spans = spans.withColumn("__from", F.coalesce(version_key(F.col("__eco"), F.col("__r.introduced")), F.lit("")))
    spans = spans.withColumn("__to", version_key(F.col("__eco"), F.col("__r.fixed")))
    spans = spans.where(F.col("__to").isNull() | (F.col("__from") < F.col("__to")))
    name = ["__eco", "__name"]
    ends = spans.select(*name, F.explode(F.array("__from", "__to")).alias("end")).where(F.col("end").isNotNull()).distinct()
    points = ends.groupBy(*name).agg(F.array_sort(F.collect_list("end")).alias("__points"))

    salt = F.pmod(F.xxhash64("scan_id", "path", "version"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    rows = packages.where(F.col("name").isNotNull() & F.col("version").isNotNull()).select(
        "scan_id", "scan_root", "path", "version", eco, F.col("name").alias("__name"), salt.alias("__salt")
    )
    placed = rows.join(points.select("*", every), [*name, "__salt"])
    placed = placed.withColumn("__at", _at_or_below(F.col("__points"), version_key(F.col("__eco"), F.col("version"))))
    placed = placed.withColumn("__n", F.size("__points")).drop("__points").where(F.col("__at") > 0)

    # Segment i is from the i-th point on, so the open end is one past the last.
    runs = spans.join(points, name).select(
        *spans.columns,
        F.explode(
            _nodes(
                _at_or_below(F.col("__points"), F.col("__from")),
                F.when(F.col("__to").isNull(), F.size("__points") + 1).otherwise(_at_or_below(F.col("__points"), F.col("__to"))),
            )
        ).alias("__node"),
    )
    top = F.ceil(F.log2(F.col("__n") + F.lit(2))).cast("int")
    above = F.transform(
        F.sequence(F.lit(0), top), lambda level: F.struct(level.alias("level"), F.floor(F.col("__at") / F.pow(F.lit(2), level)).cast("int").alias("node"))
    )
    hit = placed.select(*name, "__at", "__n").distinct().withColumn("__node", F.explode(above))
    nearest = F.min(F.struct(F.col("__to").isNull().alias("open"), "__to", F.col("__r.fixed").alias("fixed"), "severity", "title"))
    covering = hit.join(runs, [*name, "__node"]).groupBy(*name, "__at", "__id").agg(nearest.alias("__adv"))

    found = placed.join(covering.select("*", every), [*name, "__at", "__salt"])
    vuln = F.struct(
        F.col("__id").alias("VulnerabilityID"),
        F.col("__name").alias("PkgName"),
        F.col("version").alias("InstalledVersion"),
        F.col("__adv.fixed").alias("FixedVersion"),
        F.col("__adv.severity").alias("Severity"),
        F.col("__adv.title").alias("Title"),
        F.lit("").alias("Description"),
    )
    return found.select(
        "scan_id", "scan_root", F.lit(0).alias("at"), F.lit(0).alias("nth"), F.struct(F.col("path").alias("Target"), vuln.alias("vuln")).alias("f")
    )
