from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pairlens.llm import centroids
from pairlens.llm.queries import QUERIES


def expected(rows, k, rounds, width, scale, seed=2):
    """The same clustering with plain loops."""
    kept = [(key, [math.floor(x * scale) for x in v]) for key, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < 1 << 19 for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)
    points = [list(v) for _, v in starts[:k]] or [[0] * width]
    matrix = np.array([v for _, v in kept], dtype=np.int64).reshape(-1, width)
    for turn in range(rounds + 1):
        distances = ((matrix[:, None, :] - np.array(points)[None]) ** 2).sum(2)
        near = distances.argmin(1)
        if turn < rounds:
            for c in range(len(points)):
                if (near == c).any():
                    points[c] = (matrix[near == c].sum(0) // (near == c).sum()).tolist()
    best = distances.min(1)
    out = []
    for (key, _), c, d in zip(kept, near.tolist(), best.tolist(), strict=True):
        out.append((key, c, d, int(best[near == c].sum()), int(best.sum()), tuple(points[c])))
    return sorted(out, key=repr)


def found(table, **how):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in centroids.cluster(table, **how).collect()), key=repr)


def test_query_against_loops(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding) if r.embedding else None) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in QUERIES["op12_jvm_centroids"](spark, folder).collect()), key=repr)
    want = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in expected(rows, 40, 5, 64, 256)]
    assert got == sorted(want, key=repr)


ODD = [
    (1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]),
    (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, [1e30, 0.0, 0.0]), (10, [-3.5, 2.0, -0.001]), (None, [4.0, 4.0, 4.0]), (11, [0.0, 0.0, 0.0]), (12, [524287.0, 0.0, -524287.0]),
]


def test_odd_rows_ties_and_extra_columns(spark):
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in ODD], "vec_id long, embedding array<double>, cluster int, distance string")
    for k in (1, 3, 40):
        assert found(table, k=k, rounds=3, width=3, scale=4) == expected(ODD, k, 3, 3, 4)


def test_empty_tables_and_tables_without_ids(spark):
    for rows in ([], [(None, [1.0, 2.0])], [(1, [1.0])]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert found(table, width=2) == expected(rows, 40, 5, 2, 256) if len(rows) and len(rows[0][1]) == 2 else found(table, width=2) == []


def test_negative_means_are_floored_and_empty_clusters_stay(spark):
    rows = [(i, [x]) for i, x in enumerate([-3.0, -3.0, -2.0, 100.0, 100.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(table, k=4, rounds=2, width=1, scale=1) == expected(rows, 4, 2, 1, 1)


def test_one_round_scans_with_a_combining_aggregate(spark):
    table = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    vectors = centroids.whole_numbers(table, 2, 1)
    near = vectors.select(centroids.nearest(vectors.v, [[0, 0], [5, 5]]).alias("n"))
    plan = near.groupBy("n.cluster").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "Python" not in plan


@pytest.mark.parametrize("k", [1, 5])
def test_reruns_agree(spark, k):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = found(table, k=k, width=4)
    assert first == found(table.repartition(7), k=k, width=4) == expected(rows, k, 5, 4, 256)
