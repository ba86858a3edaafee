"""Orderings of versions, and matches against comparing every range with every package."""

import random

from pyspark.sql import functions as F

from scanloom.operators import advisories as adv

PACKAGES = "scan_id STRING, scan_root STRING, path STRING, ecosystem STRING, name STRING, version STRING"
ADVISORIES = "ecosystem STRING, name STRING, id STRING, severity STRING, title STRING, ranges ARRAY<STRUCT<introduced: STRING, fixed: STRING>>"

SEMVER = [
    "0.9", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-rc", "1.0.0-rc.2", "1.0.0-rc.10",
    "1.0.0-rc1", "1.0", "v1.0.1", "1.2", "1.10", "2", "3", "20240101120000", "99999999999999999999999.1",
]
DEBIAN = [
    "0~", "0", "1.0~~", "1.0~rc1", "1.0", "1.0-1", "1.0-1ubuntu1", "1.0-1ubuntu2", "1.0-1ubuntu10", "1.0-2", "1.0a", "1.0+b", "1.0.0", "1.2", "1.2-3ubuntu1",
    "1.10", "20240101120000", "1:0.1", "1:0.1-1", "10:0",
]


def sorted_by(spark, ecosystem, versions):
    rows = spark.createDataFrame([(v,) for v in versions], "v STRING")
    return [r.v for r in rows.orderBy(adv.version_key(F.lit(ecosystem), F.col("v"))).collect()]


def test_orders(spark):
    for ecosystem, order in ((adv.SEMVER, SEMVER), (adv.DEBIAN, DEBIAN)):
        for seed in range(3):
            mixed = random.Random(seed).sample(order, len(order))
            assert sorted_by(spark, ecosystem, mixed) == order


def test_equal_versions(spark):
    same = [(adv.SEMVER, "1.0", "1.0.0"), (adv.SEMVER, "v1", "1+b"), (adv.SEMVER, "01.2", "1.2"), (adv.SEMVER, "1.x", "1"),
            (adv.DEBIAN, "1.0", "0:1.0-0"), (adv.DEBIAN, "1.0a", "1.0a0"), (adv.DEBIAN, "1.007", "1.7")]
    frame = spark.createDataFrame(same, "e STRING, a STRING, b STRING")
    assert frame.where(adv.version_key(F.col("e"), F.col("a")) == adv.version_key(F.col("e"), F.col("b"))).count() == len(same)
    assert frame.select(adv.version_key(F.col("e"), F.lit(None).cast("string")).alias("k")).where("k IS NOT NULL").isEmpty()


def brute(packages, advisories):
    def place(ecosystem, version):
        order = DEBIAN if ecosystem == adv.DEBIAN else SEMVER
        return order.index(version)

    out = []
    for _, _, path, eco, name, version in packages:
        if name is None or version is None:
            continue
        hits = {}
        for a_eco, a_name, ident, _, _, ranges in advisories:
            if (a_eco, a_name) != (eco, name):
                continue
            at = place(eco, version)
            for low, high in ranges or []:
                if (low is None or place(eco, low) <= at) and (high is None or at < place(eco, high)):
                    hits.setdefault(ident, []).append(high)
        for ident, fixes in hits.items():
            known = [f for f in fixes if f is not None]
            out.append((path, ident, min(known, key=lambda f: place(eco, f)) if known else None))
    return sorted(out, key=str)


def test_ranges_against_brute_force(spark):
    rnd = random.Random(5)
    ranges = lambda order: [
        (rnd.choice([None, *order]), rnd.choice([None, *order])) for _ in range(rnd.randint(0, 4))
    ]
    advisories, packages = [], []
    for n in range(150):
        eco = rnd.choice([adv.SEMVER, adv.DEBIAN, None])
        order = DEBIAN if eco == adv.DEBIAN else SEMVER
        # One name holds most of all.
        advisories.append((eco, rnd.choice(["hot", "hot", "cold", None]), f"A{n}", "HIGH", "t", ranges(order)))
    advisories += advisories[:5]
    for n in range(400):
        eco = rnd.choice([adv.SEMVER, adv.DEBIAN, None])
        order = DEBIAN if eco == adv.DEBIAN else SEMVER
        packages.append(("s", "/r", f"p{n}", eco, rnd.choice(["hot", "hot", "cold", "unknown", None]), rnd.choice([*order, None])))
    packages += packages[:5]
    left = spark.createDataFrame(packages, PACKAGES).withColumn("severity", F.lit("clash"))
    right = spark.createDataFrame(advisories, ADVISORIES).withColumn("version", F.lit("clash"))
    for salts in (1, adv.SALTS):
        rows = adv.ranged_findings(left, right, salts).select("f.Target", "f.vuln.VulnerabilityID", "f.vuln.FixedVersion").collect()
        assert sorted(map(tuple, rows), key=str) == brute(packages, advisories)
    assert adv.ranged_findings(left.limit(0), right).isEmpty() and adv.ranged_findings(left, right.limit(0)).isEmpty()


def test_many_nested_ranges(spark):
    """A range is a few nodes, not a row for each segment below it."""
    n = 500
    nested = [(adv.SEMVER, "lib", f"A{i}", "LOW", "t", [(f"{i}.0", f"{2 * n - i}.0")]) for i in range(n)]
    packages = [("s", "/r", f"p{v}", adv.SEMVER, "lib", f"{v}.5") for v in (0, 10, n - 1, n, 2 * n - 1, 2 * n)]
    found = adv.ranged_findings(spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(nested, ADVISORIES))
    counts = {r["Target"]: r["count"] for r in found.groupBy("f.Target").count().collect()}
    assert counts == {"p0": 1, "p10": 11, f"p{n - 1}": n, f"p{n}": n, f"p{2 * n - 1}": 1}
