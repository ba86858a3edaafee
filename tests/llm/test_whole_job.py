"""What the operators once did less than whole: recall of near copies, exact weights, the mixed order, rare languages."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import mixing, packing, rules, sharding, shingles
from scanloom.llm.common import settled
from scanloom.llm.queries import ORACLES, QUERIES, read, word_tokenizer
from tests.compare import compare


def jaccard_stays(texts, least=0.8):
    """Of (id, text), the smallest id of each group linked by brute force."""
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holders[s]}:
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i for i in sets if find(i) == i}


def test_near_copies_at_the_threshold_go(spark):
    """Two to six scattered edits in 200 words: similarities from 0.74 to 0.9, most of them above five bits apart."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for edits in (0, 2, 4, 6):
            copy = list(base)
            for k in range(edits):
                copy[10 + 30 * k] = f"edit{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(copy)))
    # A passage that many share makes no near-duplicates.
    shared = " ".join(f"s{k}" for k in range(60))
    texts += [(10_000 + k, shared + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for k in range(100)]
    stays = {r.doc_id for r in shingles.one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = jaccard_stays(texts)
    assert len(want) < len(texts) - 250
    assert want <= stays and len(stays - want) <= 3


def test_a_shared_passage_makes_no_square(spark):
    """Documents that share a long passage and stay below 0.8: pairs to read grow at most with their number."""
    rng = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(100))
    for n in (100, 400):
        texts = [(k, f"{shared} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(24))) for k in range(n)]
        docs = spark.createDataFrame(texts, "at long, text string")
        sets = shingles._sets(docs, 5).withColumn("root", F.col("at"))
        assert shingles.possible_pairs(sets).count() <= n
        assert shingles.one_of_each(docs.withColumnRenamed("at", "doc_id")).count() == n


def test_possible_pairs_hold_all_similar_ones(spark):
    """Copies of one text with scattered edits: no pair at 0.8 or more is left out, most others are."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(80):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(9)):
            copy[at] = rng.choice([f"edit{rng.randrange(50)}", ""])
        texts.append((k, " ".join(copy)))
    found = [shingles.hashes(shingles.words(t)) for _, t in texts]
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if shingles.similarity(found[a], found[b]) >= 0.8}
    sets = shingles._sets(spark.createDataFrame(texts, "at long, text string"), 5).withColumn("root", F.col("at"))
    got = {tuple(sorted(r)) for r in shingles.possible_pairs(sets).collect()}
    assert want <= got and len(got) < 80 * 79 // 2 - 500 and 100 < len(want)


def test_weights_are_exact_over_many_periods(spark):
    """Deviation from the given weights, tiny ones too, at every slot of a run of several periods."""
    sizes = {"a": 1500, "b": 3000, "c": 900, "tiny": 5}
    weights = {"a": 0.29991, "b": 0.52, "c": 0.17989, "tiny": 0.0002}
    docs = spark.createDataFrame([(f"{s}{k}", s) for s, n in sizes.items() for k in range(n)], "doc_id string, source string")
    rows = mixing.mixed(docs, weights, block=1, period=100).collect()
    assert len(rows) == sum(sizes.values()) and {(r.source, r.block) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}
    total = sum(weights.values())
    at = {r.slot: r.source for r in rows}
    assert len(at) == len(rows)
    done = Counter()
    for t in range(max(at) + 1):
        done[at.get(t)] += 1
        assert all(abs(done[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items() if done[s] < sizes[s])


def test_weights_hold_with_more_than_a_thousand_sources(spark):
    """A source with a third of the weight gets a third of the slots beside 1,200 others."""
    rows = [(f"big{k}", "big") for k in range(600)] + [(f"s{j}.{k}", f"s{j}") for j in range(1200) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id string, source string")
    weights = {"big": 600.0, **{f"s{j}": 1.0 for j in range(1200)}}
    got = mixing.mixed(docs, weights, block=1).collect()
    slots = sorted(r.slot for r in got if r.source == "big")
    assert len(got) == len(rows) and all(abs(k + 1 - (t + 1) / 3) < 1 for k, t in enumerate(slots))
    assert len({r.slot for r in got}) == len(rows)


def test_packing_keeps_the_written_order(spark, folder):
    """A mix in several files, the largest last: ties and sequence numbers follow the order that was written."""
    rows = [(k, "one two three" if k % 4 else " ".join(["word"] * (40 + k % 7))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # Part 0 has one row, part 1 ten, part 2 the others.
    cut = docs.selectExpr("*", "if(doc_id < 1, 0, if(doc_id < 11, 1, 2)) as p").repartitionByRange(3, "p").sortWithinPartitions("doc_id").drop("p")
    got = corpus_pipeline.pack(spark, settled(cut, "test-mix"), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    first = {}
    lengths = defaultdict(list)
    for r in got:
        first[r.sequence_id] = min(r.doc_id, first.get(r.sequence_id, r.doc_id))
        lengths[r.length].append((r.doc_id, r.sequence_id, r.offset))
    assert sorted(first) == list(range(len(first)))
    assert [first[k] for k in sorted(first)] == sorted(first.values())
    places = {(r.sequence_id, r.offset): r.length for r in got}
    assert len(places) == 3000
    # The first of the written order opens the first sequence, and the same rows in another order do not give the same places.
    assert first[0] == 0
    back = settled(cut.orderBy("doc_id", ascending=False).coalesce(1), "test-back")
    other = {r.doc_id: r.sequence_id for r in corpus_pipeline.pack(spark, back, "").collect()}
    assert other != {r.doc_id: r.sequence_id for r in got}
    plain = packing.packed(settled(cut, "test-mix"), word_tokenizer(), keep_ids=False)
    assert plain.columns == [c for c in got[0].__fields__]


def test_every_language_has_its_own_reference(spark):
    """Seventy languages of words of their own: clean texts stay in each, also in the smallest, and none judges itself alone."""
    rng = random.Random(8)
    rows = []
    for lang in range(70):
        letters = "".join(chr(0x61 + (lang * 7 + k) % 26) for k in range(4))
        common = [letters[:n] + letters[k % 4] for k, n in enumerate([1, 2, 3, 2, 1, 3])]
        for _ in range(55 if lang % 2 else 70):
            text = " ".join(rng.choice(common) if rng.random() < 0.6 else letters + str(rng.randrange(10**6)) for _ in range(100))
            rows.append((len(rows), text, f"l{lang}"))
    junk = " ".join(f"%{k}#" for k in range(200))
    rows.append((-1, junk, "rare"))
    rows.append((-2, junk, "l1"))
    got = {r["row"].doc_id: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i, _, _ in rows if i >= 0)
    # A language below the least number of words has no distances; junk among many goes.
    assert got[-1].class_distance is None and got[-1].word_distance is None and not got[-2].kept


def test_sql_judges_many_languages_alike(spark, tmp_path):
    """Seventy languages around the least number of words, one at it and one a word below, null and empty ones: SQL gives the same rows."""
    rng = random.Random(9)
    rows = []
    for lang in range(70):
        letters = "".join(chr(0x61 + (lang * 5 + k) % 26) for k in range(4))
        common = [letters[:n] for n in (1, 2, 3, 4)]
        words = rules.REFERENCE_WORDS + {0: 0, 1: -1}.get(lang, rng.choice([-3000, 400]))
        while words > 0:
            size = min(words, 250)
            text = " ".join(rng.choice(common) if rng.random() < 0.6 else letters + str(rng.randrange(10**6)) for _ in range(size))
            rows.append((len(rows), text, f"l{lang}"))
            words -= size
    junk = " ".join(f"%{k}#" for k in range(200))
    # Junk adds words to its language, so it lies in languages far from the limit.
    rows += [(10_000 + k, junk + f" {k}", lang) for k, lang in enumerate([None, "", "rare", "l5", "l6", "l7", "l8"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' source", "cast(length(text) as long) n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    outcome = compare(spark, con, "op7", QUERIES["op7_quality_rules"], ORACLES["op7_quality_rules"], str(tmp_path))
    assert outcome is None, outcome
    kept = {r.doc_id: r.kept for r in QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect()}
    assert kept[10_002] and not kept[10_000] and len(set(kept.values())) == 2


def test_counts_beyond_the_limit_are_hypergeometric():
    """Small expected counts in more than 10**9 rows: the share of each count, and the extremes."""
    rng = np.random.default_rng(4)
    drawn = Counter(sharding._hypergeometric(rng, 10, 2 * 10**9, 2 * 10**8) for _ in range(8000))
    for k, share in enumerate([0.9**10, 10 * 0.1 * 0.9**9, 45 * 0.01 * 0.9**8]):
        assert abs(drawn[k] / 8000 - share) < 0.02
    assert sharding._hypergeometric(rng, 10, 2 * 10**9, 2 * 10**9 + 10) == 10
    large = [sharding._hypergeometric(rng, 10**9, 10**9, 10**8) for _ in range(200)]
    assert abs(np.mean(large) - 5 * 10**7) < 2000 and 4000 < np.std(large) < 5700


def test_simhash_proposes_pairs(spark):
    from scanloom.llm import shingles

    nodes = spark.createDataFrame([(1, 0), (2, 0b11111), (3, 0b11111), (4, (1 << 40) - 1)], "node long, bits long")
    assert {tuple(sorted(r)) for r in shingles.near_pairs(nodes).collect()} == {(1, 2), (2, 3)}
