from __future__ import annotations

import random
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from pairlens.llm import minhash
from pairlens.llm.components import components
from pairlens.llm.queries import QUERIES
from pairlens.session import shared_dir


def shingles(text, size):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute(texts, size=3, least=Fraction(85, 100)):
    """(n_shingles, component) per row by comparing all rows."""
    sets = [shingles(t, size) for _, t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if both * least.denominator >= least.numerator * (len(a) + len(sets[j]) - both):
                    links.append((j, i))
    top = roots(len(texts), links)
    low = {}
    for (key, _), t in zip(texts, top, strict=True):
        if key is not None:
            low[t] = min(low.get(t, key), key)
    return [(key, len(s), low.get(t)) for (key, _), s, t in zip(texts, sets, top, strict=True)]


def order(row):
    return tuple((v is None, v) for v in row)


def same(rows, texts, size=3, least=Fraction(85, 100)):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=order)
    assert got == sorted(brute(texts, size, least), key=order)


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op7_circulant_minhash"](spark, folder).collect()
    same(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize(("size", "least"), [(3, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_variants_without_their_origin(spark, size, least, monkeypatch):
    """Edited copies near the threshold: components hang on links that no hub sees; small blocks are forced."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append((k, " ".join(words)))
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size, least).collect()
    same(rows, texts, size, least)


def test_odd_rows(spark):
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "Éa b c d"), (9, "éa b c d"),
        (10, "a b c d e"), (10, "a b c d e"), (None, "a b c d e"), (None, "alone among all of these"), (11, "z y x"), (12, "word " * 30_000),
        (13, "word " * 20_000), (14, "a b c d e"), (15, "a b c d e"), (20, "q w e r t"), (20, "other text with the same id"),
    ]
    table = spark.createDataFrame([(k, t, "k", 1) for k, t in texts], "doc_id long, text string, key string, n long")
    rows = minhash.near_duplicates(table).collect()
    same(rows, texts)
    assert minhash.near_duplicates(table.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (300, 0)]
    links += [(rng.randrange(6000, 6200), rng.randrange(6000, 6200)) for _ in range(150)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = roots(6200, links)
    assert set(got) == {x for pair in links for x in pair}
    for a in got:
        for b in (a + 1, 0, 1000, 6050):
            if b in got:
                assert (got[a] == got[b]) == (want[a] == want[b])
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_a_large_component_meets_only_the_others(spark, monkeypatch):
    """One bucket with a component of many blocks and strays, some of which belong to it: no two of its own blocks are paired."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = set(range(200))
    table, rows = [], []
    for k in range(60):
        own = sorted(base - {k} | {1000 + k})
        table.append((bytes([1, k]), own))
        rows.append((7, bytes([1, k]), b"main"))
    for k in range(11):
        own = sorted(base - {100 + k} | {5000 + k}) if k % 2 else sorted(range(9000 + 300 * (k // 4), 9200 + 300 * (k // 4)))
        table.append((bytes([2, k]), own))
        rows.append((7, bytes([2, k]), bytes([2, k])))
    sets = spark.createDataFrame(table, "key binary, shingles array<long>").dropDuplicates(["key"])
    rest = spark.createDataFrame([(b, k, r, b"main", 60, 11) for b, k, r in rows], "bucket long, key binary, root binary, main binary, n_main long, n_other long")
    links = {(bytes(a), bytes(b)) for a, b in minhash._block_links(rest, sets, Fraction(85, 100)).collect()}
    values, root = {k: set(v) for k, v in table}, {k: r for _, k, r in rows}
    keys = sorted(root)
    want = [(a, b) for a in keys for b in keys if a < b and root[a] != root[b] and 100 * len(values[a] & values[b]) >= 85 * len(values[a] | values[b])]
    names = {k: i for i, k in enumerate(keys)}
    joined = [(names[k], names[next(x for x in keys if root[x] == root[k])]) for k in keys]
    assert all(a[:1] + b[:1] != b"\\x01\\x01" for a, b in links)
    assert roots(len(keys), joined + [(names[a], names[b]) for a, b in links]) == roots(len(keys), joined + [(names[a], names[b]) for a, b in want])


def test_sets_are_not_shuffled_to_find_repeated_keys(spark):
    rows = [(b"a", [1, 2]), (b"b", [3]), (b"a", [1, 2]), (b"c", [4])]
    table = spark.createDataFrame(rows, "key binary, shingles array<long>").repartition(3)
    wanted = spark.createDataFrame([(b"a", 1), (b"b", 2)], "key binary, least_id long")
    found = minhash._one_per_key(table, wanted)
    assert sorted((bytes(r.key), r.shingles) for r in found.collect()) == [(b"a", [1, 2]), (b"b", [3])]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_bands_are_deleted_once_read(spark, monkeypatch):
    written = []

    def settled(df, name):
        written.append((name, df.columns))
        return kept(df, name)

    kept = minhash.settle
    monkeypatch.setattr(minhash, "settle", settled)
    texts = [(k, f"one two three four five six seven {'eight' if k % 2 else 'nine'}") for k in range(6)] + [(5, "other words of this row"), (None, None)]
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    same(rows, texts)
    assert ("minhash-marks", ["doc_id", "n_shingles", "key"]) in written
    folder = spark.sparkContext.applicationId
    assert not list(Path(shared_dir(spark), "pairlens", folder).glob("minhash-sketch-*/*.parquet"))


@pytest.mark.parametrize("least", [Fraction(85, 100), Fraction(8, 10), Fraction(3, 10)])
def test_outlines_rule_out_no_link(least):
    rng = np.random.default_rng(11)
    sets = []
    for size in (1, 2, 7, 15, 16, 17, 130, 1000, 20_000):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for share in (0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.3, 0.5):
            fresh = base.copy()
            fresh[: int(share * size)] = rng.integers(0, 1 << 64, int(share * size), dtype=np.uint64)
            sets.append(np.unique(fresh))
    names = [bytes([k]) for k in range(len(sets))]
    outlines = [minhash._outline(s) for s in sets]
    assert all(len(o) <= max(8, len(s)) for o, s in zip(outlines, sets, strict=True))
    live = minhash._live(names, [0] * len(sets), [len(s) for s in sets], outlines, False, least)
    for i, a in enumerate(sets):
        both = [len(np.intersect1d(a, b)) for b in sets]
        linked = [j for j, b in enumerate(sets) if j != i and both[j] * least.denominator >= least.numerator * (len(a) + len(b) - both[j])]
        assert live[i] or not linked
        for j in linked:
            assert list(minhash._live([names[i], names[j]], [0, 1], [len(a), len(sets[j])], [outlines[i], outlines[j]], True, least)) == [True, True]
    assert list(minhash._live([names[i] for i in (64, 71)], [0, 0], [len(sets[i]) for i in (64, 71)], [outlines[i] for i in (64, 71)], False, Fraction(85, 100))) == [False, False]


def test_sets_of_unlike_candidates_are_not_sent(spark, monkeypatch):
    """All texts share buckets, at a likeness of about a half; only two of them are alike."""
    counts = {}

    def settled(df, name):
        table = kept(df, name)
        counts[name] = table.count()
        return table

    kept = minhash.settle
    monkeypatch.setattr(minhash, "settle", settled)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    texts = [(k, " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(60)])) for k in range(40)]
    texts.append((40, texts[3][1] + " end"))
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    same(rows, texts)
    assert counts["minhash-pairs"] >= 30
    assert counts["minhash-likely"] + counts["minhash-live"] <= 4


def test_sets_are_dealt_by_key_once(spark, monkeypatch):
    """Joins with sets bring pairs and blocks to where the sets are, also where nothing is broadcast."""
    plans = {}

    def settled(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    kept = minhash.settle
    monkeypatch.setattr(minhash, "settle", settled)
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(k, f"one two three four five six seven {'eight' if k % 2 else 'nine'} {k // 2}") for k in range(12)]
        rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    same(rows, texts)
    for name in ("minhash-star", "minhash-more"):
        moved = [line for line in plans[name].splitlines() if "Exchange hashpartitioning(key#" in line and "ENSURE_REQUIREMENTS" in line]
        assert len(moved) == 1, plans[name]
