"""Declared relations: to-one joins and nested to-many includes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.credentials import spread_nulls

#: Width of the id range whose children share a list. It fixes the form of the result, whatever the number of children.
NEST_WIDTH = 1000


def to_one(child: DataFrame, column: str, parent: DataFrame, name: str, fields: list[str], key: str = "id") -> DataFrame:
    """Child rows with the referred row as a struct; null when the reference is null or dangling."""
    target = parent.select(
        F.col(key).cast("string").alias("__key"), F.struct(*fields).alias(name)
    )
    salt = F.col("id") if "id" in child.columns else F.xxhash64(*child.columns)
    keyed = child.withColumn("__key", spread_nulls(F.col(column), salt))
    return keyed.join(target, "__key", "left").drop("__key")


def to_many(
    parent: DataFrame,
    child: DataFrame,
    column: str,
    name: str,
    fields: list[str],
    key: str = "id",
    width: int = NEST_WIDTH,
) -> DataFrame:
    """Parents with their children as lists of structs in id order: one row a parent and range of child ids.

    Column ``chunk`` is the child's id divided by ``width``, for all parents alike, so that the form of the
    result does not depend on its size and a list is bounded by the width of its range. A parent
    without children has one row with an empty list and chunk 0.
    """
    linked = child.filter(F.col(column).isNotNull()).withColumnRenamed(column, "__fk")
    members = F.struct("id", *[f for f in fields if f != "id"])
    nested = linked.groupBy("__fk", F.floor(F.col("id") / width).cast("bigint").alias("chunk")).agg(
        F.array_sort(F.collect_list(members)).alias(name)
    )
    # An inner join: adaptive execution can split either side where a parent has very many ranges.
    joined = parent.join(nested, parent[key] == nested["__fk"]).drop("__fk")
    keys = linked.select("__fk").distinct()
    childless = parent.join(keys, parent[key] == keys["__fk"], "left_anti")
    empty = F.array().cast(nested.schema[name].dataType)
    return joined.select(*parent.columns, "chunk", name).unionByName(
        childless.select(*parent.columns, F.lit(0).cast("bigint").alias("chunk"), empty.alias(name))
    )
