"""Registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import centroids, chat, classifier, lines, mixing, packing, resampling, rules, sharding, simhash, suffixes, tokenfiles, vectors
from scanloom.llm.sql import CENTROIDS, CHAT, LINES, RESAMPLING, RULES
from scanloom.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries without an entry are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_chat_rotation": CHAT,
    "op6_line_dedup": LINES,
    "op7_quality_rules": RULES,
    "op12_importance_resampling": RESAMPLING,
    "op13_centroid_clustering": CENTROIDS,
}
SHARD_COUNT = 24


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), word_tokenizer(), keep_ids=False)


@_query
def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(read(spark, sf_dir, "conversations"))


@_query
def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc(F.col("text")).alias("text_crc32"))
    return sharding.shuffled(narrow, SHARD_COUNT).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.size").alias("size"),
        F.col("row.text_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, most=4)
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_suffixes(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    spans = F.size("spans").cast("long")
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.cleaned(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed", "n_spans")


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(read(spark, sf_dir, "documents"), carried=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, "base_failed", "kept")


@_query
def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@_query
def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mix.select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "place")


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfiles.write(read(spark, sf_dir, "documents"), byte_tokenizer(), path)
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(read(spark, sf_dir, "embeddings"))
    known = [F.struct(F.lit(n).cast("long").alias("n"), F.lit(centroids.digest(c)).alias("digest")) for n, c in zip(found.inertias, found.centroids)]
    of = F.array(*known)[F.col("cluster")] if known else F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"))
    return found.rows.select(
        "vec_id",
        "cluster",
        "distance",
        of["n"].alias("cluster_inertia"),
        F.lit(sum(found.inertias)).cast("long").alias("inertia"),
        of["digest"].alias("centroid_sha256"),
    )
