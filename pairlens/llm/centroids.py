"""Centroid clustering over integer vectors, with all per-vector work in JVM expressions.

A component x becomes ``floor(scale * x)``. The distances of a vector to all centroids, which stand in the expression as one
literal array of arrays, are ``aggregate(zip_with(...))`` in long arithmetic; ``array_min`` over structs of distance and
number picks the nearest, the smaller number on ties. A round is one scan and one combining aggregate of a column sum per
component, so a cluster with any share of the rows costs a task one row; what reaches the driver is k rows of sums.

Kept are vectors of exactly ``width`` components, none null or non-finite, and none of magnitude 2**19 or more, whose squared
distances a long could not hold; all others are left out of the result. Rows may repeat. A null id is kept, but never starts
a centroid. With fewer than ``k`` ids there are as many centroids as ids; without any, or for an empty table, the result is
empty. Only the two columns named are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle

LARGEST = 1 << 19


def whole_numbers(embeddings: DataFrame, width: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` with ``v`` as long array, for the vectors that are kept."""
    rows = embeddings.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    fine = (F.size("x") == width) & F.forall("x", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return rows.where(fine).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids, hashed with the seed, come first; of rows with one id the least by components."""
    hashed = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v")
    return [list(r.v) for r in hashed.orderBy("hash", "v").limit(k).collect()]


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct of ``distance`` (squared) and ``cluster``."""
    table = F.expr("array(" + ", ".join(f"array({', '.join(f'{c}L' for c in one)})" for one in centroids) + ")")
    squared = lambda x, c: (x - c) * (x - c)
    add = lambda total, x: total + x
    return F.array_min(F.transform(table, lambda c, i: F.struct(F.aggregate(F.zip_with(vector, c, squared), F.lit(0).cast("long"), add).alias("distance"), i.alias("cluster"))))


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of each cluster; an empty one stays."""
    width = len(centroids[0])
    found = vectors.select(nearest(F.col("v"), centroids).alias("near"), "v").select("near.cluster", *(F.col("v")[i].alias(f"c{i}") for i in range(width)))
    sums = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(width)))
    out = list(centroids)
    for row in sums.collect():
        out[row.cluster] = [row[f"c{i}"] // row.n for i in range(width)]
    return out


def cluster(
    embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid)`` for each vector that is kept."""
    vectors = settle(whole_numbers(embeddings, width, scale, key, vector), "centroid-vectors")
    centroids = first_centroids(vectors, k, seed) or [[0] * width]
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    assigned = settle(vectors.select("id", nearest(F.col("v"), centroids).alias("near")).select("id", "near.cluster", "near.distance"), "centroid-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.expr("sum(cluster_inertia) over ()"))
    table = F.expr("array(" + ", ".join(f"array({', '.join(f'{c}L' for c in one)})" for one in centroids) + ")")
    # a row per cluster, k at most
    sums = F.broadcast(sums.withColumn("centroid", F.element_at(table, F.col("cluster") + 1)))
    return assigned.join(sums, "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """What the query shows of a centroid, for tests."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
