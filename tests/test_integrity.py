import pytest
from pyspark.sql import functions as F

from scanloom import catalogue
from scanloom.catalogue import TABLES, Ref
from scanloom.operators import integrity, relations


def test_catalogue_counts():
    refs = [r for t in TABLES.values() for r in t.refs]
    assert len(TABLES) == 19 and len(refs) == 28
    assert sum(r.on_delete == "cascade" for r in refs) == 14
    assert sum(r.on_delete == "set null" for r in refs) == 5
    assert sum(len(t.unique) for t in TABLES.values()) == 13
    assert sum(c.required and c.name != t.key for t in TABLES.values() for c in t.columns) == 104
    for t in TABLES.values():
        names = {c.name for c in t.columns}
        assert {c for key in t.keys for c in key} <= names and {r.column for r in t.refs} <= names
        assert all(r.parent in TABLES for r in t.refs)


def test_null_key_parts_never_collide(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], "a INT, b STRING")
    assert [tuple(r) for r in integrity.duplicates(rows, ("a", "b")).collect()] == [(2, "x", 2)]


def test_delete_follows_every_rule(spark):
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "id INT"),
        "github_app_installations": spark.createDataFrame([(10, 1), (11, 2)], "id INT, user_id INT"),
        "github_repos": spark.createDataFrame([(20, 2, 10), (21, 1, None)], "id INT, user_id INT, installation_id INT"),
        "security_scans": spark.createDataFrame([("s", 20, 1), ("t", 20, None)], "scan_id STRING, repo_id INT, user_id INT"),
        "security_issues": spark.createDataFrame([("s", 1), ("t", 2)], "scan_id STRING, resolved_by INT"),
    }
    effect = integrity.delete(tables, "users", spark.createDataFrame([(1,)], "id INT"))
    kept = {n: sorted(map(tuple, df.collect()), key=str) for n, df in effect.kept.items()}
    assert kept["users"] == [(2,)]
    assert kept["github_app_installations"] == [(11, 2)]  # cascaded
    assert kept["security_scans"] == [("s", 20, None), ("t", 20, None)]  # set null
    assert kept["security_issues"] == [("s", None), ("t", 2)]
    # Both repositories forbid the delete: one by its owner, one by the cascaded installation.
    assert sorted(r["id"] for r in effect.blocking["github_repos"].collect()) == [20, 21]


def test_cascade_by_scan_id(spark):
    tables = {
        "github_repos": spark.createDataFrame([(1,), (2,)], "id INT"),
        "security_scans": spark.createDataFrame([(5, "s", 1), (6, "t", 2)], "id INT, scan_id STRING, repo_id INT"),
        "security_issues": spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "z")], "scan_id STRING, title STRING"),
    }
    effect = integrity.delete(tables, "github_repos", spark.createDataFrame([(1,)], "id INT"))
    assert [tuple(r) for r in effect.kept["security_issues"].collect()] == [("t", "z")]
    assert effect.deleted["security_issues"].count() == 2


def test_defaults_only_for_absent_columns(spark):
    rows = spark.createDataFrame([(1, None)], "repo_id INT, max_high_issues INT")
    full = integrity.apply_defaults(rows, TABLES["quality_gates"], F.to_timestamp_ntz(F.lit("2024-01-01"))).first()
    assert full["max_high_issues"] is None
    assert (full["max_critical_issues"], full["min_clean_percentage"], full["enabled"]) == (0, 80, False)
    assert full["created_at"].year == 2024


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_nested_lists_are_whole_and_bounded(spark, width):
    """One parent holds most children; ids have gaps; some children have no or an unknown parent."""
    child = spark.range(0, 3000, 3).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, 2).when(F.col("id") % 7 == 0, 99).alias("fk")
    )
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    rows = relations.to_many(parent, child, "fk", "kids", [], width=width).collect()
    assert max(len(r["kids"]) for r in rows) <= width
    assert all(k["id"] // width == r["chunk"] for r in rows for k in r["kids"])
    got = sorted((r["id"], k["id"]) for r in rows for k in r["kids"])
    assert got == sorted((r["fk"], r["id"]) for r in child.filter("fk IN (1, 2)").collect())
    assert [len(r["kids"]) for r in rows if r["id"] == 3] == [0]
    assert len({(r["id"], r["chunk"]) for r in rows}) == len(rows)


def test_nested_form_does_not_depend_on_size(spark):
    """A third of 100,000 children on one parent: the same rows for a range of ids as a small parent has."""
    child = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("fk"))
    parent = spark.range(1, 503).select("id")
    rows = relations.to_many(parent, child, "fk", "kids", []).collect()
    assert {r["chunk"] for r in rows if r["id"] == 1} == set(range(100))
    assert all(k["id"] // relations.NEST_WIDTH == r["chunk"] for r in rows for k in r["kids"])
    assert sum(len(r["kids"]) for r in rows) == 100_000


def test_to_one_keeps_dangling_and_null(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id INT, fk INT")
    parent = spark.createDataFrame([(5, "five")], "id INT, name STRING")
    rows = relations.to_one(child, "fk", parent, "p", ["name"]).orderBy("id").collect()
    assert [r["p"] and r["p"]["name"] for r in rows] == ["five", None, None]


def test_hot_orphans(spark):
    child = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("fk"))
    parent = spark.range(100, 10_000).select("id")
    counts = {r["fk"]: r["n_rows"] for r in integrity.orphan_counts(child, Ref("fk", "users"), parent).collect()}
    brute = integrity.orphans(child, Ref("fk", "users"), parent).groupBy("fk").count().collect()
    assert counts == {r["fk"]: r["count"] for r in brute} and counts[7] >= 3000


def test_facts_of_all_tables(spark):
    tables = {
        "users": spark.createDataFrame([(1, None, "x" * 101), (2, "a@b", "n"), (None, "c@d", None)], "id INT, email STRING, name STRING"),
        "scan_jobs": spark.createDataFrame([("queued",), ("lost",), (None,)], "status STRING"),
        "github_tokens": spark.createDataFrame([("odd",)], "unknown STRING"),
    }
    assert sorted(map(tuple, integrity.facts(tables).collect())) == [
        ("scan_jobs", "status", "null", 1), ("scan_jobs", "status", "outside", 1),
        ("users", "email", "null", 1), ("users", "id", "null", 1), ("users", "name", "too_long", 1),
    ]
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert integrity.facts(empty).isEmpty()


def test_keys_of_all_tables(spark):
    tables = {
        "users": spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, None), (None, None)], "id INT, email STRING"),
        "github_repos": spark.createDataFrame(
            [(1, 1, 'x","y', 1), (2, 1, 'x","y', None), (3, 1, "x", None), (4, 1, "x", None)], "id INT, user_id INT, github_id STRING, team_id INT"
        ),
    }
    assert sorted(map(tuple, integrity.colliding_keys(tables).collect())) == [
        ("github_repos", "user_id,github_id", '["1","x"]', 2), ("github_repos", "user_id,github_id", '["1","x\\",\\"y"]', 2),
        ("users", "email", "b", 2), ("users", "id", "1", 2),
    ]


def test_references_of_all_tables(spark):
    tables = {
        "users": spark.createDataFrame([(1,), (None,)], "id INT"),
        "github_repos": spark.createDataFrame([(5, 1, 9), (6, 3, 9), (7, 3, None), (8, None, 9)], "id INT, user_id INT, installation_id INT"),
        "security_scans": spark.createDataFrame([("s", 5), ("t", 99)], "scan_id STRING, repo_id INT"),
        "security_issues": spark.createDataFrame([("s", 1), ("u", 2), ("u", None)], "scan_id STRING, resolved_by INT"),
    }
    # Installations are not given, so references to them are not judged.
    assert sorted(map(tuple, integrity.dangling(tables).collect())) == [
        ("github_repos", "user_id", "users", "3", 2), ("security_issues", "resolved_by", "users", "2", 1),
        ("security_issues", "scan_id", "security_scans", "u", 2), ("security_scans", "repo_id", "github_repos", "99", 1),
    ]


def test_fates_read_each_table_once(spark, tmp_path):
    rows = {
        "users": spark.range(20).select(F.col("id").cast("int")),
        "github_app_installations": spark.range(40).select(F.col("id").cast("int"), (F.col("id") % 20).cast("int").alias("user_id")),
        # A third of the repositories belong to one user, a third to none.
        "github_repos": spark.range(300).select(
            F.col("id").cast("int"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, (F.col("id") % 20).cast("int")).alias("user_id"),
            (F.col("id") % 40).cast("int").alias("installation_id"),
        ),
    }
    tables = {}
    for name, frame in rows.items():
        frame.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    keys = spark.createDataFrame([(1,), (1,), (None,), (7,)], "id INT")
    effect = integrity.delete(tables, "users", keys)
    for name, fates in effect.fates.items():
        plan = fates._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1, name
        assert fates.count() == rows[name].count()
    lost = {1, 7}
    want = []
    for r in rows["github_repos"].collect():
        against = [c for c, bad in (("user_id", r.user_id in lost), ("installation_id", r.installation_id % 20 in lost)) if bad]
        want.append((r.id, integrity.BLOCKING if against else integrity.KEPT, against))
    got = effect.fates["github_repos"].select("id", "fate", "blocked_by").collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(r.id for r in effect.deleted["users"].collect()) == [1, 7] and effect.kept["users"].count() == 18
    assert integrity.delete(tables, "users", keys.limit(0)).deleted["users"].isEmpty()
