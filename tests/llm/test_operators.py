"""Corpus operators against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

import corpus_pipeline
from scanloom.llm import chat, classifier, lines, mixing, packing, rules, sharding, simhash, suffixes, vectors
from scanloom.llm.components import connected_components
from scanloom.llm.queries import ORACLES, QUERIES, read, word_tokenizer
from tests.compare import compare, duck
from tests.llm.test_whole_job import jaccard_stays


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    outcome = compare(spark, duck(folder), name, QUERIES[name], ORACLES[name], folder)
    assert outcome is None or outcome.startswith("ok"), outcome


# 1 packing


def token_ids(text):
    from tokenizers import Tokenizer

    coded = Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False)
    return [*coded.ids, 0]


def check_packing(rows, texts):
    want = Counter()
    for doc_id, text in texts:
        ids = token_ids(text)
        for piece, a in enumerate(range(0, len(ids), 2048)):
            cut = ids[a : a + 2048]
            want[doc_id, piece, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing(spark, folder, messy, empty):
    rows = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    texts = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    used = check_packing(rows, texts)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 11 / 9 + 1
    check_packing(packing.packed(messy, word_tokenizer()).collect(), [(r.doc_id, r.text) for r in messy.collect()])
    assert packing.packed(empty, word_tokenizer()).count() == 0


def test_sequences_hold_the_ids(messy):
    whole = packing.sequences(packing.packed(messy, word_tokenizer())).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(len(token_ids(r.text)) for r in messy.collect())
    assert max(len(r.ids) for r in whole) <= 4 * 2048


@given(some.dictionaries(some.integers(1, 60), some.integers(1, 40), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece(lengths):
    moves = packing.plan(lengths, 60)
    bins = defaultdict(list)
    placed = Counter()
    for length, start, count, first, per_bin, offset in moves:
        assert start == placed[length]
        placed[length] += count
        for k in range(count):
            bins[first + k // per_bin].append((offset + k % per_bin * length, length))
    assert placed == Counter(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
        assert sum(3 * length > 60 for _, length in parts) <= 2


# 2 chat


def test_chat_messy(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "x"), (None, 0, "system", "s"), (2, 600, "ann", ""), (2, 0, "bob", "b")]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, position string")
    got = chat.rotated(rows).collect()
    assert Counter((r.conv_id, r.speaker) for r in got) == Counter({(1, "ann"): 4, (1, "bob"): 4, (1, ""): 4, (2, "ann"): 2, (2, "bob"): 2})
    for view in {(r.conv_id, r.speaker) for r in got}:
        parts = sorted((r for r in got if (r.conv_id, r.speaker) == view), key=lambda r: r.position)
        whole = "".join(r.rendered for r in parts)
        for r in parts:
            assert whole[r.start : r.stop].endswith(chat.CLOSE) and (r.role == "assistant") == r.trained == (r.name is None)
    assert chat.rotated(rows.where("false")).count() == 0


# 3 shards


def test_shards(spark, folder, messy, empty):
    rows = QUERIES["op3_hypergeometric_shards"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in read(spark, folder, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    for got, shards in ((rows, 24), (sharding.shuffled(messy, 4).collect(), 4)):
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == min(shards, len(got))
        for shard, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    carried = [str(r.row) for r in sharding.shuffled(messy, 4).collect()]
    assert sorted(carried) == sorted(str(r) for r in messy.collect())
    assert sharding.shuffled(empty, 4).count() == 0


def test_matrix_sums_and_law():
    sizes, wanted = np.array([5, 0, 7, 20]), sharding.shard_sizes(32, 5)
    total = np.zeros((4, 5))
    for seed in range(400):
        drawn = sharding.draw(sizes, wanted, np.random.default_rng(seed))
        assert (drawn.sum(1) == sizes).all() and (drawn.sum(0) == wanted).all()
        total += drawn
    assert np.abs(total / 400 - np.outer(sizes, wanted) / 32).max() < 0.4


# 4 simhash


def groups(bits, most):
    u = np.array([b & (2**64 - 1) for b in bits], np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= most
    root = list(range(len(u)))
    changed = True
    while changed:
        new = [min(root[j] for j in np.flatnonzero(row)) for row in near]
        changed, root = new != root, new
    return root


def test_simhash(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op4_simhash_near_dedup"](spark, folder).collect()}
    docs = sorted((r.doc_id, r.text) for r in read(spark, folder, "documents").collect())
    bits = [simhash.fingerprint(t, 4) for _, t in docs]
    for (doc_id, _), b, root in zip(docs, bits, groups(bits, 4), strict=True):
        assert got[doc_id].fingerprint == f"{b & (2**64 - 1):016x}" and got[doc_id].component_id == docs[root][0]


def test_simhash_links_at_the_limit(spark):
    rng = random.Random(5)
    bits = []
    for _ in range(60):
        base = rng.getrandbits(64)
        bits.append(base)
        for _ in range(4):
            flipped = base
            for b in rng.sample(range(64), rng.choice([1, 4, 5, 6])):
                flipped ^= 1 << b
            bits.append(flipped)
    bits = sorted({b - 2**64 if b >> 63 else b for b in bits})
    for most in (4, 5):
        links = simhash.fingerprint_links(spark.createDataFrame([(b,) for b in bits], "bits long"), most)
        root = {r.node: r.root for r in connected_components(links).collect()}
        assert [root.get(b, b) for b in bits] == [bits[k] for k in groups(bits, most)]


def test_fingerprint_by_hand():
    import xxhash

    words = b"a b c d e".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1)
    assert simhash.fingerprint("A b\tc\x0bD  e", 4) & (2**64 - 1) == want
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


def test_simhash_messy(messy, empty):
    got = simhash.near_duplicates(messy)
    assert got.count() == messy.count()
    stays = simhash.one_of_each(messy)
    assert stays.columns == messy.columns
    # Empty texts are one group, both copies of 2 another; 5 and 6 are near copies.
    assert sorted(r.doc_id or -1 for r in stays.collect()) == [-1, 1, 2, 3, 5, 8]
    assert simhash.near_duplicates(empty).count() == simhash.one_of_each(empty).count() == 0


# 5 suffixes


def removed_bytes(docs):
    texts = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    for i, b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                mask[k : k + 50] = b"\1" * 50
        yield len(b), bytes(c for c, m in zip(b, mask, strict=True) if not m), len([x for x in bytes(mask).split(b"\0") if x])


def test_suffixes(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    docs = [(i, "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(200))) + passage[rng.randrange(200) :][: rng.randrange(150)] + "é" * rng.randrange(90)) for i in range(60)]
    docs += [(5, passage), (7, "a" * 400), (8, "a" * 49), (9, "a" * 70), (61, None), (62, ""), (None, passage), (None, passage), (63, docs[4][1])]
    want = Counter((i, *w) for (i, _), w in zip(docs, removed_bytes(docs), strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for batch, split in ((2 << 20, 8 << 20), (500, 2000)):
        monkeypatch.setattr(suffixes, "BATCH_BYTES", batch)
        monkeypatch.setattr(suffixes, "SPLIT_BYTES", split)
        got = suffixes.dedup_suffixes(frame).collect()
        assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == want


def test_suffix_query(spark, folder, messy, empty):
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, folder).collect()}
    docs = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    for (i, _), (n, kept, spans) in zip(docs, removed_bytes(docs), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.dedup_suffixes(messy).count() == messy.count()
    assert suffixes.dedup_suffixes(empty).count() == 0


# 6 lines


def deduped_lines(docs):
    """Texts without later windows; docs are (id, text), each once."""
    first = {}
    wins = {}
    for i, t in docs:
        parts = (t or "").split("\n")
        for k in range(len(parts) - 2):
            w = "\n".join(parts[k : k + 3])
            if w.split():
                wins.setdefault(w, []).append((i, k))
                first[w] = min(first.get(w, (i, k)), (i, k))
    gone = defaultdict(set)
    for w, places in wins.items():
        for place in places:
            if place != first[w]:
                gone[place[0]].update(range(place[1], place[1] + 3))
    return {i: t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_lines_messy(messy, empty):
    got = sorted(((r["row"].doc_id or -1, r["text"], r.n_removed, r.n_spans) for r in lines.cleaned(messy).collect() if (r["row"].doc_id or -1) in (-1, 1, 2, 3, 4)), key=str)
    both = ("k", 3, 1)
    assert got == sorted([(-1, None, 0, 0), (-1, "l", 3, 1), (1, "a b c\nd e f\ng h i\nj", 0, 0), (2, *both), (2, *both), (3, None, 0, 0), (4, "", 0, 0)], key=str)
    assert lines.cleaned(empty).count() == 0


# 7 rules


def test_rules_messy(messy, empty):
    rows = rules.judged(messy).collect()
    assert sorted(str(r["row"]) for r in rows) == sorted(str(r) for r in messy.collect())
    by = {r["row"].doc_id: r for r in rows if r["row"].doc_id}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[5].n_words == 60_000 and by[5].n_repeat_words == 60_000 and by[5].base_failed
    assert rules.judged(empty).count() == 0


# 8 classifier


def test_classifier(spark, messy, empty):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_rule_ensemble"](spark, folder).collect()
    label = {r.doc_id: r.quality for r in read(spark, folder, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = [r.score for r in rows if r.held_out and label.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and label.get(r.doc_id) == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    odd = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert {r.score > 0.5 for r in classifier.scored(messy, odd).collect()} == {True}
    assert classifier.scored(empty, odd).count() == 0


# 9 vectors


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(3):
        base = rng.normal(size=(250, 16))
        near = base[rng.integers(0, 40, 150)] + rng.normal(size=(150, 16)) * 0.1
        rows += [(len(rows) + i, v.astype(np.float32).tolist(), label) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:5]]))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 8]
    rows += [(10_000 + i, v, 0) for i, v in enumerate(odd)] + [(20_000, rows[0][1], None), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as at", "'x' as shard")
    for size in (2048, 120):
        monkeypatch.setattr(vectors, "SHARD", size)
        got = vectors.near_vectors(frame).collect()
        assert len(got) == len(rows)
        found, true = vectors.audit(frame, spark.createDataFrame(got), every=1)
        assert 0.9 * true <= found <= true + 20  # the row without an id is a link that the audit has no row for
        by = {r.vec_id: r for r in got}
        assert all(by[10_000 + i].n_links == 0 and by[10_000 + i].kept for i in range(len(odd))) and by[20_000].n_links == 0
        assert by[0].component_id == 0 and by[400].component_id == 0 and not by[400].kept and by[0].n_links >= 3
    assert vectors.near_vectors(frame.where("false")).count() == 0


# 10 mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2, "c": 4.5}, {"a": 1}, {f"s{i}": 1 + i % 7 for i in range(40)}])
def test_schedule_keeps_every_source_within_a_block(weights):
    blocks = mixing.shares(weights)
    slots = mixing.schedule(blocks)
    period = sum(blocks.values())
    assert Counter(slots) == Counter(blocks) and period == mixing.PERIOD
    done = Counter()
    for t, source in enumerate(slots):
        done[source] += 1
        assert all(abs(done[s] - blocks[s] * (t + 1) / period) < 1 for s in blocks)


def test_mixing(spark, folder, messy, empty):
    rows = QUERIES["op10_pfair_mixing"](spark, folder).collect()
    docs = read(spark, folder, "documents")
    import hashlib

    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    blocks = mixing.shares({s: len(v) ** 0.5 for s, v in by.items()})
    places = defaultdict(list)
    for slot, source in enumerate(mixing.schedule(blocks)):
        places[source].append(slot)
    want = set()
    for source, ids in by.items():
        for k, (_, i) in enumerate(sorted(ids)):
            block = k // mixing.BLOCK
            want.add((i, source, block, block // blocks[source] * mixing.PERIOD + places[source][block % blocks[source]], k % mixing.BLOCK))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    ordered = mixing.mixed_order(messy)
    assert sorted(map(str, ordered.collect())) == sorted(map(str, messy.collect()))
    assert mixing.mixed(messy, {"x": 3.0, "y": 1.0}).count() == messy.count() and mixing.mixed_order(empty).count() == 0


def test_written_order_is_the_mix(spark, monkeypatch):
    """Many ranges and buckets: the rows come as a plain sort of all slots gives them, from one move of whole rows."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    docs = docs.selectExpr("doc_id", "text", "lang", "if(doc_id % 3 > 0, source, null) source", "n_chars")
    monkeypatch.setattr(mixing, "RANGE", 2)
    monkeypatch.setattr(mixing, "BUCKET", 100)
    ordered = mixing.mixed_order(docs, block=8)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    want = mixing.mixed(docs, block=8).orderBy("slot", "place").select("row.*")
    assert [r.doc_id for r in ordered.collect()] == [r.doc_id for r in want.collect()]


# The pipeline


def test_pipeline(spark, folder):
    docs = read(spark, folder, "documents")
    kept = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, folder).where("kept").collect()}
    texts = deduped_lines(sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept))
    stays = jaccard_stays(texts.items())
    check_packing(corpus_pipeline.run(spark, folder).collect(), [(i, texts[i]) for i in stays])


def test_pipeline_stages_keep_the_columns(spark, messy, empty):
    for docs in (messy, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


@pytest.mark.parametrize("word", ["plain", "Words", "q" * 60])
def test_plain_words_need_no_pattern(monkeypatch, word):
    """Words of nothing but ASCII letters, most of a text, go to the tokenizer's model at once; the ids are those of the tokenizer."""
    monkeypatch.setattr(packing, "_PLAIN", None)
    assert list(np.frombuffer(packing.WordIds(word_tokenizer())[word.encode()], "<u4")) == token_ids(word)[:-1]


@pytest.mark.parametrize("word", ["plain", "Words", "q" * 60])
def test_plain_stretches_need_no_pattern(monkeypatch, word):
    """The same for a space and the letters behind it in token files."""
    from scanloom.llm import tokenfiles
    from scanloom.llm.queries import byte_tokenizer

    monkeypatch.setattr(tokenfiles, "_PLAIN", None)
    stretches = tokenfiles.ChunkIds(byte_tokenizer())
    assert stretches[word] == stretches.whole(f" {word}")
