from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairlens.llm import prefixes
from pairlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(c):
    """Sign of the dividend, as in SQL."""
    return abs(c) % 20 * (1 if c >= 0 else -1)


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [(role, text) for _, role, text in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - remainder(c), [])[:h] + said[h:])
    members = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    children, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, inside in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(inside) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    out = []
    for p, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(whole[c]) == len(p))))
        out.append((min(inside), len(p), min(members[p[:-1]]) if p else None, len(inside), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefixes.trie(table).collect()), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, x string, part int")


def test_query_against_loops(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_count_min_trie"](spark, folder)
    assert got.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def odd_rows():
    said = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 3}") for c in range(45) for t in range(c % 6)]
    said += [(100, None, "user", "first"), (100, 0, None, None), (100, 0, "a", ""), (101, 5, "", "x y"), (101, 5, "", "x y"), (101, 5, "user", "x y")]
    said += [(None, 1, "user", "nobody's"), (-7, 1, "user", "below zero"), (-20, 1, "user", "below zero"), (-20, 2, "user", "more"), (160, 1, "u", "w " * 20_000), (161, 3, "u", "w " * 20_000)]
    return said


def test_odd_rows_and_extra_columns(spark):
    assert found(table_of(spark, odd_rows())) == expected(odd_rows())


def test_a_sketch_that_proves_little_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "MOST_CELLS", 8)
    monkeypatch.setattr(prefixes, "IDS_PER_TEXT", 2)
    assert found(table_of(spark, odd_rows())) == expected(odd_rows())
    monkeypatch.setattr(prefixes, "MOST_CELLS", 256)
    assert found(table_of(spark, odd_rows())) == expected(odd_rows())


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    monkeypatch.setattr(prefixes, "HITS_AT_ONCE", 3)
    assert found(table_of(spark, odd_rows())) == expected(odd_rows())


def test_hot_conversation_and_hot_copies(spark, monkeypatch):
    """A third of the turns in one conversation, a third in copies of another, over more ranges than it has turns."""
    monkeypatch.setattr(prefixes, "IDS_PER_TEXT", 7)
    rows = [(40, t, "user", f"long {t}") for t in range(300)] + [(41, t, "user", f"long {t}") for t in range(200)]
    rows += [(1000 + 20 * c, t, "user", f"copied {t}") for c in range(60) for t in range(5)] + [(c, 0, "user", "same start") for c in range(3000, 3100)]
    random.Random(5).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert found(table_of(spark, rows)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(5, 1, "a", "b")], [(7, 0, "a", "b")], [(c, 0, "a", "b") for c in (3, 5, 7, 9)]])
def test_tables_with_little_or_nothing(spark, rows):
    assert found(table_of(spark, rows)) == expected(rows)


def test_a_cell_below_two_proves_one_member(spark):
    rng = np.random.default_rng(1)
    lanes = rng.integers(-(1 << 62), 1 << 62, (500, 2))
    lanes = np.concatenate([lanes, lanes[:100]])
    table = spark.createDataFrame([tuple(map(int, r)) for r in lanes], "x long, y long")
    for cells in (8, 1024, 8192):
        shared = prefixes.build_sketch(table, cells).shared(lanes[:, 0], lanes[:, 1])
        assert shared[:100].all() and shared[500:].all()
    assert shared[100:500].mean() < 0.05


def test_tails_are_not_shuffled_by_prefix(spark):
    """What is grouped exactly is what the sketch lets through."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(200) for t in range(5)] + [(c, 0, "user", "shared") for c in range(1000, 1004)]
    made, lengths = prefixes.rebuilt(prefixes.turns(table_of(spark, rows)))
    table = prefixes.with_prefixes(made, lengths).cache()
    marked = prefixes.screened(table, prefixes.build_sketch(table, prefixes.sketch_cells(table.count())))
    exact = table.groupBy("x", "y").count().where("count > 1").agg({"count": "sum"}).first()[0]
    assert exact <= marked.where("shared").count() <= exact + 0.1 * table.count()
    table.unpersist()
