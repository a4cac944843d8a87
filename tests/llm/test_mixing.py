from __future__ import annotations

import math
import re

import pytest

from pairlens.llm import mixing
from pairlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds a cap is shared again among the others until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(most * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * free / rest > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else weight[s] * free / rest for s in names}
        capped |= over


def expected_multiplier(sizes, target, most=3):
    """By bisection: words grow with the multiplier."""
    mean = sum(sizes) / len(sizes)
    low, high = -1e6, math.log(most) * mean / min(s for s in sizes if s)
    for _ in range(300):
        middle = (low + high) / 2
        words = sum(s * min(most, math.exp(max(-700, min(700, middle * s / mean)))) for s in sizes)
        low, high = (middle, high) if words < target else (low, middle)
    return (low + high) / 2, mean


def check(rows, texts, most=3):
    """rows: (source, size, source_size, target, rate, taken) of the operator."""
    assert sorted(r[1] for r in rows) == sorted(len(WORD.findall(t or "")) for t in texts)
    by = {}
    for source, size, source_size, target, rate, taken in rows:
        by.setdefault(source, []).append((size, source_size, target, rate, taken))
    sizes = {s: sum(r[0] for r in v) for s, v in by.items()}
    wanted = expected_targets(sizes) if sizes else {}
    for source, found in by.items():
        assert {r[1] for r in found} == {sizes[source]}
        assert all(math.isclose(r[2], wanted[source], rel_tol=1e-12) for r in found)
        if not sizes[source]:
            assert all(r[4] == 0 for r in found)
            continue
        full = wanted[source] >= most * sizes[source] * (1 - 1e-12)
        if not full:
            multiplier, mean = expected_multiplier([r[0] for r in found], wanted[source])
        part = 0
        for size, _, _, rate, taken in found:
            assert 0 <= taken <= most * size
            if size:
                want = most if full else min(most, math.exp(multiplier * size / mean))
                assert math.isclose(rate, want, rel_tol=1e-5, abs_tol=1e-9)
                assert math.floor(rate) * size <= taken <= (math.floor(rate) + 1) * size
                part += taken % size != 0
        assert part <= 1  # one document at most is cut
        assert abs(sum(r[4] for r in found) - wanted[source]) <= 0.5 + 1e-6 * wanted[source]


def run(table):
    mixed = mixing.mix(table, keep=("source",))
    return [(r.source, r["size"], r.source_size, r.target, r.rate, r.taken) for r in mixed.collect()]


def test_query_against_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op13_entropy_balancing"](spark, folder).collect()
    assert len(rows) == len(docs)
    check([(docs[r.doc_id].source, r["size"], r.source_size, r.target, r.rate, r.taken) for r in rows], [d.text for d in docs.values()])
    again = QUERIES["op13_entropy_balancing"](spark, folder).collect()
    assert sorted(rows) == sorted(again)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \t\n", "a"), (4, "one two three four", "b"), (None, "no id", "b"), (None, "no id", "b"), (5, "w " * 30_000, "c"),
    (6, "few words here", "c"), (7, "x y", None), (7, "x y", None), (8, "z", ""), (9, "alone", "d"), (10, "q " * 50, "é"), (11, "q " * 7, "\U0001f600"), (12, "q " * 9, "￿"),
]


def test_odd_rows_and_extra_columns(spark):
    table = spark.createDataFrame([(*r, 1, 2, "t", 4) for r in ODD], "doc_id long, text string, source string, size int, taken int, target string, rid int")
    check(run(table), [r[1] for r in ODD])


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "one", "a")], [(1, "a b c", None)]])
def test_tables_with_little_or_nothing(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(run(table), [r[1] for r in rows])
    assert len(run(table)) == len(rows)


def test_repeated_rows_of_a_hot_source(spark, monkeypatch):
    """A third of all rows alike, so that the cut falls among equal places, with the search driven to its last step."""
    monkeypatch.setattr(mixing, "FEW", 1)
    rows = [(7, "same text of six words here", "hot")] * 400 + [(i, "w " * (i % 40 + 1), f"s{i % 3}") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = run(table)
    check(got, [r[1] for r in rows])
    assert sorted(map(repr, got)) == sorted(map(repr, run(table.repartition(3))))


def test_main_path_is_native_and_takes_no_limit(spark):
    import inspect

    source = inspect.getsource(mixing)
    assert not re.search(r"\.limit\(|sample\(|mapInArrow|mapInPandas|pandas|udf|\.rdd", source)
