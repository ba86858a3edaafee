"""Documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import lines, mixing, packing, rules, shingles
from scanloom.llm.common import settled
from scanloom.llm.queries import read, word_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    return rules.judged(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of three-line windows; n_chars follows the text."""
    found = lines.cleaned(docs).select("row", "text", "n_removed")
    changed = found.withColumn("row", F.col("row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
        changed = changed.withColumn("row", F.col("row").withField("n_chars", length))
    return changed.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: found by SimHash and MinHash, Jaccard 0.8 or more of five-word shingles."""
    return shingles.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources."""
    return mixing.mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in the sequences, which are numbered by their first piece in the mixed order.

    The order is that of the files the mix was written to; equal lengths keep it.
    """
    return packing.packed_in_order(docs, word_tokenizer(), keep_ids=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the tokenizer nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is settled in the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
