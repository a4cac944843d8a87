from __future__ import annotations

import math

import numpy as np
import pytest

from pairlens.llm import vectors
from pairlens.llm.queries import QUERIES


def brute(rows, least):
    """(vec_id, n_links, component_id) by comparing all rows in double precision."""
    good = []
    for _, values, label in rows:
        ok = values is not None and len(values) > 0 and label is not None and all(v is not None and math.isfinite(v) for v in values) and any(values)
        good.append(np.array(values, dtype=np.float64) if ok else None)
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = good[i], good[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return sorted((str(r[0]), links[i], str(low.get(top(i)))) for i, r in enumerate(rows))


def shown(got):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op8_subspace_pigeonhole"](spark, folder).collect()
    assert shown(got) == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize(("least", "dim"), [(0.98, 24), (0.9, 7), (0.999, 3)])
def test_dense_groups_in_small_deals(spark, least, dim, monkeypatch):
    """A large group near the threshold, with chains; cells are dealt into many small blocks."""
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    rng = np.random.default_rng(dim)
    centre, step = rng.standard_normal(dim), math.sqrt(2 - 2 * least)
    rows = []
    for i in range(220):
        base = centre if i % 3 else rng.standard_normal(dim)
        x = base / np.linalg.norm(base) + rng.standard_normal(dim) * step / math.sqrt(2 * dim) * 1.1
        rows.append((i, [float(np.float32(v)) for v in x * rng.uniform(0.1, 9)], i % 2))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert shown(vectors.near_vectors(table, least).collect()) == brute(rows, least)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 5), (2, [2.0, 0.0, 0.0], 5), (3, [1.0, 0.0, 0.0], 5), (3, [1.0, 0.0, 0.0], 5), (4, [1.0, 0.0, 0.0], 6), (5, None, 5), (6, [], 5), (7, [0.0, 0.0, 0.0], 5),
        (8, [1.0, None, 0.0], 5), (9, [nan, 0.0, 0.0], 5), (10, [inf, 0.0, 0.0], 5), (11, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 5), (None, [0.0, 0.0, 1.0], 5),
        (12, [1.0, 0.0], 5), (13, [1e300, 1e298, 0.0], 5), (14, [1.0, -0.0, 0.0], 5), (15, [0.0, 1e-300, 0.0], 5),
    ]
    table = spark.createDataFrame([(*r, 1, b"k") for r in rows], "vec_id long, embedding array<double>, label int, n int, key binary")
    got = vectors.near_vectors(table)
    scaled = [(k, None if v is None else [x / 1e300 if x is not None and math.isfinite(x) and abs(x) > 1e200 else x for x in v], c) for k, v, c in rows]
    scaled = [(k, [1.0 if x == 1e-300 else x for x in v] if v else v, c) for k, v, c in scaled]
    assert shown(got.collect()) == brute(scaled, 0.98)
    assert vectors.near_vectors(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vectors.near_vectors(table, 0.0)
