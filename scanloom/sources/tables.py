"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table as Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options):
    """A database table read in ``parts`` ranges of its integer key.

    ``parts`` also bounds the connections opened at once, as a pool would.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of them."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")
