from __future__ import annotations

import math

import numpy as np
import pytest

from pairlens.llm import quality
from pairlens.llm.queries import QUERIES


def test_posteriors_against_plain_sums(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_hierarchical_bayes"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = [(r.rejected, label[r.doc_id]) for r in rows if r.doc_id in label]
    assert np.mean([x for x, y in known if y == 1]) < 0.01 and np.mean([x for x, y in known if y == 0]) > 0.8
    for r in rows:
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-(r.evidence + math.log(r.path_mean / (1 - r.path_mean))))), rel=1e-6)


def test_sparse_sites_shrink_and_large_ones_do_not(spark):
    model = quality.Model([], [], 1.0, 0.5, quality.Settings(least_strength=20.0))
    rows = [("good", "good/a", 3.0)] * 400 + [("bad", "bad/a", -3.0)] * 300 + [("bad", "bad/b", 3.0)] * 100 + [("new", "new/a", -3.0)] + [("mid", "mid/x", 0.0)] * 50
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double")
    got = {r.path: r for r in quality.posteriors(table, model).collect()}
    p = {e: 1 / (1 + math.exp(-e)) for e in (3.0, -3.0, 0.0)}
    mean = sum(p[r[2]] for r in rows) / len(rows)
    # one document hardly moves its host from the global mean; hundreds do
    assert abs(got["new/a"].host_mean - mean) < 0.05
    assert got["good/a"].host_mean > 0.88 and got["bad/a"].path_mean < got["bad/a"].host_mean < got["bad/b"].path_mean
    hosts = {}
    for host, _, e in rows:
        hosts.setdefault(host, []).append(p[e])
    big = [h for h in hosts.values() if len(h) > 1]
    spread = sum(len(h) * (np.mean(h) - mean) ** 2 for h in big)
    total = sum(map(len, big))
    between = (spread - len(big) * mean * (1 - mean)) / (total - sum(len(h) ** 2 for h in big) / total)
    strength = max(20.0, mean * (1 - mean) / between - 1)
    assert got["bad/a"].host_mean == pytest.approx((sum(hosts["bad"]) + strength * mean) / (400 + strength))


def test_sites(spark):
    sources = ["src1", "https://www.A.example/x/y?z", "http://b.example", None, "", "c.example/p/q", "d.example?x=/y"]
    host, path = quality.site_of(quality.F.col("source"))
    got = [tuple(r) for r in spark.createDataFrame([(s,) for s in sources], "source string").select(host, path).collect()]
    assert got == [("src1", "src1/"), ("a.example", "a.example/x"), ("b.example", "b.example/"), ("", "/"), ("", "/"), ("c.example", "c.example/p"), ("d.example", "d.example/")]


def test_odd_rows(spark):
    good = [(i, f"plain words of text number {i} and some more of them.\nA second line {i}.", f"s{i % 3}", 1.0) for i in range(200)]
    bad = [(500 + i, "BUY!!! NOW!!! " * 30, f"s{i % 3}", 1.0) for i in range(100)]
    odd = [(None, "text", None, 1.0), (900, None, "s1", 1.0), (901, "", "s1", 1.0), (902, "BUY!!! NOW!!! " * 20_000, "s1", 1.0), (902, "BUY!!! NOW!!! " * 20_000, "s1", 1.0), (903, "퟿ \t\n \x00 é", "", 1.0)]
    documents = spark.createDataFrame(good + bad + odd, "doc_id long, text string, source string, evidence double")
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (3, None), (77777, 1), (900, 1)], "doc_id long, quality int")
    rows = quality.judge(documents, labels).collect()
    assert len(rows) == len(good) + len(bad) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert not by[5].rejected and by[505].rejected and by[902].rejected
    assert len({r.posterior for r in rows if r.doc_id == 902}) == 1
    unlabelled = quality.judge(documents, labels.limit(0)).collect()
    assert {r.evidence for r in unlabelled} == {0.0} and not any(r.rejected for r in unlabelled)
    assert quality.judge(documents.limit(0), labels).collect() == []
