import os

import pytest
from pyspark.sql import functions as F

from scanloom.session import local_path
from scanloom.sources import files as fs


def tree(root):
    for rel in (
        "a.txt", ".env", "_u.txt", ".github/w.yml", "src/x.py", "src/node_modules/y.js", ".git/HEAD", "src/deep/.git/z",
        "docs/node_modules", "b/c/d/e/f.txt",
    ):
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(rel)
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link.txt"))
    os.symlink(os.path.join(root, "src"), os.path.join(root, "linked"))


def brute(root, skip):
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip and not os.path.islink(os.path.join(folder, d))]
        out += [os.path.relpath(os.path.join(folder, n), root) for n in names if not os.path.islink(os.path.join(folder, n))]
    return sorted(out)


def test_walk(spark, tmp_path):
    skip = ["node_modules", ".git"]
    roots = [str(tmp_path / n) for n in ("one", "two")]
    for root in roots:
        tree(root)
    frame = spark.createDataFrame([(r,) for r in roots], "root STRING")
    expected = sorted((r, p) for r in roots for p in brute(r, skip))
    # A small budget forces several passes; the listing must not depend on it.
    for budget in (1, 3, 20_000):
        got = sorted(map(tuple, fs.walk_files(frame, skip, budget).select("root", "path", "size").collect()))
        assert got == [(r, p, len(p)) for r, p in expected]
    assert (roots[0], ".env") in expected and (roots[0], "docs/node_modules") in expected
    everything = fs.walk_files(frame).count()
    assert everything == 2 * len(brute(roots[0], []))


def test_texts(spark, tmp_path):
    root = str(tmp_path / "texts")
    long = "ä€😀\n" * 300_000
    rows = [(root, "a/.env", "x"), (root, "_b", ""), (root, "c/d/long", long), (root, "gone", None)]
    files = spark.createDataFrame(rows, "root STRING, path STRING, text STRING")
    assert fs.write_files(files) == 3 and fs.write_files(files) == 3  # again, as a repeated task would
    with open(f"{root}/bad", "wb") as f:
        f.write(b"ok\xff\xe2\x82")
    listed = fs.walk_files(files.select("root").distinct().unionByName(spark.createDataFrame([(None,)], "root STRING")))
    assert sorted(r.path for r in listed.collect()) == ["_b", "a/.env", "bad", "c/d/long"]
    for size in (1, 8 << 20):
        got = {r.path: r.text for r in fs.file_texts(listed.where("path <> '_b'"), size).collect()}
        assert got == {"a/.env": "x", "bad": "ok\ufffd\ufffd", "c/d/long": long}
    odd = spark.createDataFrame([(root, "gone", "mine"), (root, "a", "1"), (None, "p", "2"), (root, None, "3"), (root, "_b", "4"), (root, "_b", "4")],
                                "root STRING, path STRING, content STRING").withColumnRenamed("content", "extra")
    got = fs.file_texts(odd.withColumn("text", F.lit("clash"))).select("extra", "text", "read_error").collect()
    assert sorted(map(tuple, got), key=str) == [
        ("1", None, "unreadable"), ("2", None, "missing"), ("3", None, "missing"), ("4", "", None), ("4", "", None), ("mine", None, "missing")
    ]
    assert fs.file_texts(odd.limit(0)).collect() == []


def test_mounted_paths():
    assert local_path("/a/b") == local_path("file:///a/b") == local_path("file:/a/b") == "/a/b"
    with pytest.raises(ValueError):
        local_path("hdfs://host/a")


def test_outside_matches_walk_rule(spark):
    rows = [("node_modules", True), ("a/node_modules", True), ("node_modules/a", False), ("a/node_modules/b", False), ("x", True)]
    frame = spark.createDataFrame(rows, "path STRING, keep BOOLEAN")
    assert frame.filter(fs.outside(F.col("path"), ["node_modules"]) != F.col("keep")).isEmpty()
    assert frame.filter(fs.outside(F.col("path"), [])).count() == len(rows)


def test_retention_is_strict(spark):
    frame = spark.createDataFrame([("2024-01-01 10:59:59",), ("2024-01-01 11:00:00",)], "t STRING")
    now = F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))
    old = frame.filter(fs.expired(F.to_timestamp_ntz("t"), now)).collect()
    assert [r["t"] for r in old] == ["2024-01-01 10:59:59"]


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fs, "FILES_A_TASK", 10)
    rows = [(str(tmp_path), f"a/{n}.txt", f"text {n}") for n in range(200)]
    names = spark.createDataFrame(rows, "root string, path string, text string").coalesce(1)
    assert fs._spread(names).rdd.getNumPartitions() >= 20
    assert fs.write_files(names) == 200
    assert fs.walk_files(spark.createDataFrame([(str(tmp_path),)], "root string")).count() == 200
