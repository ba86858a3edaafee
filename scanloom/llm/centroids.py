"""Centroid clustering of whole-number vectors: distances, assignment and sums are column expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import settled

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3


@dataclass
class Clustered:
    """``rows`` have vec_id, vector, cluster, distance; the other two go by number of cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertias: list[int]


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Columns ``vec_id``, ``vector`` (array of long): floor(``scale`` x) of each component.

    Rows stay if the ``embedding`` has exactly ``dimensions`` components, none of them null, infinite or not a number.
    """
    usable = (F.size("embedding") == dimensions) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest SHA-256 after the seed, in that order; a null id counts as an empty one.

    Rows of one id are ordered by their components. Fewer rows than clusters give fewer centroids.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.vector) for r in whole.select(name.alias("name"), "vector").orderBy("name", "vector").limit(clusters).collect()]


def squared_distance(vector: Column, centroid: list[int]) -> Column:
    """Exact squared Euclidean distance of a vector from a literal centroid."""
    there = F.lit(centroid).cast("array<bigint>")
    return F.aggregate(F.zip_with(vector, there, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda n, d: n + d)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct ``distance``, ``cluster`` of the nearest centroid; of equally near ones the smaller number."""
    each = [F.struct(squared_distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]
    return F.array_min(F.array(*each))


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: each the floored mean of the vectors nearest to it; those without any stay.

    Every task sums the components as columns and hands on a row a cluster; the driver gets a row a cluster.
    """
    of = whole.select(nearest(F.col("vector"), centroids)["cluster"].alias("cluster"), "vector")
    sums = [F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    new = list(centroids)
    for row in of.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row.cluster] = [row[f"s{i}"] // row.n for i in range(len(centroids[0]))]
    return new


def clustered(
    vectors: DataFrame,
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> Clustered:
    """All usable rows of ``vectors`` (vec_id, embedding) with their cluster after ``rounds`` rounds, see ``whole_vectors``.

    Vectors are turned into whole numbers and written once; a round reads them, and only sums leave its tasks.
    Arithmetic is exact in 64 bits; components too large for it (beyond about 180,000 at 64 dimensions) are an
    arithmetic error, not a wrong result. Repeated rows count each. Without usable rows there are no clusters.
    """
    whole = settled(whole_vectors(vectors, dimensions, scale), "whole-vectors")
    centroids = first_centroids(whole, clusters, seed)
    if not centroids:
        empty = whole.select("vec_id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustered(empty, [], [])
    for _ in range(rounds):
        new = moved(whole, centroids)
        if new == centroids:
            break  # All further rounds would give the same.
        centroids = new
    best = whole.select("vec_id", "vector", nearest(F.col("vector"), centroids).alias("best"))
    rows = settled(best.select("vec_id", "vector", "best.cluster", "best.distance"), "clustered")
    inertias = [0] * len(centroids)
    for row in rows.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect():
        inertias[row.cluster] = row.sum
    return Clustered(rows, centroids, inertias)


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
