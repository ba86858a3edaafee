"""Token files, importance resampling and centroid clustering against plain Python."""

import functools
import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanloom.llm import centroids, resampling, tokenfiles
from scanloom.llm.common import placed
from scanloom.llm.queries import QUERIES, byte_tokenizer, read
from scanloom.session import fresh_path

# 11 token files


@functools.cache
def tokenizer():
    return Tokenizer.from_file(byte_tokenizer())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


@given(some.text(alphabet=some.sampled_from("ab Z9 \n\t.,'s 　\x1c\x85é\U0001f600 "), max_size=40))
@settings(max_examples=600, deadline=None)
def test_cut_texts_give_the_same_ids(text):
    assert np.frombuffer(tokenfiles.encoded_bytes(text, byte_tokenizer()), "<u2").tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["a<|endoftext|> b", " <|endoftext|>", "it's we'll  x", "\x00 \x00", "a " * 5000, "x" * 20000])
def test_odd_texts_give_the_same_ids(text):
    assert np.frombuffer(tokenfiles.encoded_bytes(text, byte_tokenizer()), "<u2").tolist() == plain_ids(text)


def test_token_files_query(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, folder).collect()}
    start = 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in read(spark, folder, "documents").collect()):
        ids = plain_ids(text)
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_files_round_trip(spark, messy, empty, monkeypatch):
    path = fresh_path(spark, "token-files")
    tokenfiles.write(messy.repartition(5), byte_tokenizer(), path)
    held = tokenfiles.manifest(path)
    assert held["width"] == 2 and held["documents"] == messy.count() and sum(p["nulls"] for p in held["parts"]) == 2
    monkeypatch.setattr(tokenfiles, "READ_BYTES", 64)
    monkeypatch.setattr(tokenfiles, "READ_ROWS", 2)
    rows = sorted(tokenfiles.read(spark, path, "numbers").collect(), key=lambda r: r.start)
    texts = defaultdict(list)
    for r in messy.collect():
        texts[r.doc_id].append(plain_ids(r.text))
    assert [r.doc_id for r in rows] == [1, 2, 2, 3, 4, 5, 6, 7, 8, None, None]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        texts[r.doc_id].remove(r.ids)
        at += r.n_tokens
    # The files themselves, without Spark.
    folder = path.removeprefix("file://").replace("file:", "")
    whole = np.concatenate([np.memmap(f"{folder}/{p['name']}.ids", "<u2", "r") for p in held["parts"]])
    assert whole.tolist() == [i for r in rows for i in r.ids]
    for p in held["parts"]:
        offsets = np.fromfile(f"{folder}/{p['name']}.offsets", "<u8")
        assert len(offsets) == p["documents"] + 1 and offsets[0] == 0 and offsets[-1] == p["tokens"]

    # A second write replaces the first; appended documents go on behind the last.
    tokenfiles.write(messy.where("doc_id = 1"), byte_tokenizer(), path)
    more = tokenfiles.encoded(messy.where("doc_id = 2"), byte_tokenizer())
    more.write.format("token_files").option("width", 2).mode("append").save(path)
    assert [(r.doc_id, r.start > 0) for r in sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r.start)] == [(1, False), (2, True), (2, True)]
    nothing = fresh_path(spark, "token-files")
    tokenfiles.write(empty, byte_tokenizer(), nothing)
    assert tokenfiles.read(spark, nothing).count() == 0


def test_files_of_lost_attempts_do_not_count(spark, messy):
    path = fresh_path(spark, "token-files")
    tokenfiles.write(messy, byte_tokenizer(), path)
    before = sorted(map(str, tokenfiles.read(spark, path).collect()))
    folder = path.removeprefix("file://").replace("file:", "")
    part = json.load(open(f"{folder}/manifest.json"))["parts"][0]["name"]
    for end in ("ids", "offsets", "docs"):
        with open(f"{folder}/part-00000-lost.{end}", "wb") as file:
            file.write(open(f"{folder}/{part}.{end}", "rb").read()[:-3])
    assert sorted(map(str, tokenfiles.read(spark, path).collect())) == before
    assert os.path.exists(f"{folder}/part-00000-lost.ids")


# 12 resampling


def features(text, longest):
    found = [[]]
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in "0123456789" or "a" <= c <= "z" or ord(c) > 127:
            found[-1].append(c)
        elif found[-1]:
            found.append([])
    found = ["".join(w) for w in found if w]
    return found, [" ".join(found[k : k + n]) for n in range(1, longest + 1) for k in range(len(found) - n + 1)]


def plain_resampling(docs, target, longest, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1])
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1])
    s_all, t_all = s.total(), t.total()
    rows = []
    for doc_id, text in docs:
        found, every = features(text, longest)
        each = [zlib.crc32(f.encode()) % buckets for f in every]
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in each]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), len(every), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(spark, folder, longest):
    docs = read(spark, folder, "documents")
    got = resampling.resampled(docs, read(spark, folder, "benchmark"), longest=longest, buckets=997, percent=25)
    want = plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in read(spark, folder, "benchmark").collect()], longest, 997, 25, 20)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_resampling_messy(spark, messy, empty):
    target = messy.select("text")
    rows = resampling.resampled(messy, target, percent=50, least_words=1).collect()
    want = plain_resampling([(r.doc_id, r.text) for r in messy.collect()], [r.text for r in target.collect()], 1, 10_000, 50, 1)
    assert sorted(map(tuple, rows), key=str) == want
    assert resampling.resampled(empty, target).count() == 0
    assert resampling.resampled(messy, target.where("false"), percent=0).where("rank is null").count() == messy.count()


def test_many_rows_of_one_id(spark):
    """A third of all rows share id and text: their ranks are still one each, in several tasks."""
    rows = [(None if k % 3 == 0 else k, "a b c") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resampling.resampled(docs, docs, percent=100, least_words=1)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))
    at = placed(docs, [F.lit(1)], "place").select("place", F.spark_partition_id().alias("task"))
    assert sorted(r.place for r in at.collect()) == list(range(3000))


def test_the_head_changes_no_result():
    rng = random.Random(1)
    words = [f"w{k}".encode() for k in range(30)] + ["é".encode()]
    head = {w: zlib.crc32(w) for w in words[:10]} | {b"w1 w2": zlib.crc32(b"w1 w2")}
    for n in (1, 2, 3, 4):
        for _ in range(200):
            run = b" ".join(rng.choices(words, k=n))
            assert resampling.crc(run, head) == zlib.crc32(run)


def test_frequent_runs(spark):
    docs = spark.createDataFrame([(f"the cat {'x' * 500} the cat {k}",) for k in range(300)], "text string").repartition(3)
    head = resampling.frequent(docs, 2)
    assert {b"the", b"cat", b"the cat"} <= set(head) and all(len(w) <= 129 for w in head)
    assert all(zlib.crc32(w) == state for w, state in head.items())


# 13 centroids


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[far(v)[1]].append(v)
        centres = [[sum(x) // len(of[n]) for x in zip(*of[n])] if of[n] else c for n, c in enumerate(centres)]
    found = [(i, *far(v)) for i, v in kept]
    sums = Counter()
    for _, d, n in found:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, n, d, sums[n], sums.total(), digest[n]) for i, d, n in found)


def test_centroid_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in read(spark, folder, "embeddings").collect()]
    got = Counter(tuple(r) for r in QUERIES["op13_centroid_clustering"](spark, folder).collect())
    assert got == plain_clusters(rows, 64, 8, 10)


def test_centroids_messy(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).round(2).tolist(), k) for k in range(60)] + [(k % 3, [0.5, -0.25, 0.0, -1.0], 0) for k in range(40)]
    odd = [None, [], [0.0] * 3, [0.0] * 5, [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [None] * 4]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(None, [0.1] * 4, 0), (None, None, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").selectExpr("*", "'x' as vector", "'x' as distance")
    for k, rounds in ((5, 3), (1, 0), (200, 2)):
        found = centroids.clustered(frame, 4, k, rounds)
        got = Counter((r.vec_id, r.cluster, r.distance, found.inertias[r.cluster], sum(found.inertias), centroids.digest(found.centroids[r.cluster])) for r in found.rows.collect())
        assert got == plain_clusters([r[:2] for r in rows], 4, k, rounds)
    nothing = centroids.clustered(frame.where("false"), 4)
    assert nothing.rows.count() == 0 and not nothing.centroids


def test_clusters_that_stay_empty_keep_their_centroid(spark):
    rows = [(k, [1.0, 1.0]) for k in range(6)]
    found = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 3, 4)
    assert found.centroids == [[1024, 1024]] * 3 and {r.cluster for r in found.rows.collect()} == {0} and found.inertias == [0, 0, 0]


def test_a_round_moves_only_sums(spark, folder):
    whole = centroids.whole_vectors(read(spark, folder, "embeddings"))
    first = centroids.first_centroids(whole)
    best = whole.select(centroids.nearest(F.col("vector"), first)["cluster"].alias("cluster"), "vector")
    plan = best.groupBy("cluster").agg(*[F.sum(F.col("vector")[i]) for i in range(64)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan
