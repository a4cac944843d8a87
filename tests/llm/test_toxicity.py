from __future__ import annotations

import random
import zlib

import numpy as np

from pairlens.llm import toxicity
from pairlens.llm.queries import QUERIES


def test_held_out_scores(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op1_weak_supervision"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = (np.array([s for s, t in own if t == k]) for k in (1, 0))
    auc = np.mean([(good < s).mean() + (good == s).mean() / 2 for s in bad])
    assert auc > 0.94
    assert (good >= 0.5).mean() < 0.01 and (bad >= 0.5).mean() > 0.8


def test_label_model_finds_accuracies_and_ties():
    rng = np.random.default_rng(4)
    y = rng.random(6000) < 0.2
    right = np.array([0.7, 0.5, 0.4, 0.6, 0.3])
    votes = (rng.random((6000, 5)) < np.where(y[:, None], right, 0.004)).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    model, posterior = toxicity.label_model(votes, 0.15)
    assert sorted(map(len, model.cliques)) == [1, 1, 1, 1, 2]
    assert np.abs(model.rates[1][:5] - right).max() < 0.12
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert abs(model.share - 0.2) < 0.06


def test_odd_rows(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(["Nastyword!", "vileword"])
        texts.append((i, " ".join(words), i))
        labels.append((i, int(i % 5 == 0), "x"))
    odd = [(None, "vileword", 1), (1000, None, 1), (1001, "", 1), (1002, "w1 " * 100_000, 1), (1003, "vileword", 1), (1003, "vileword", 1)]
    labels += [(None, 1, "x"), (7, None, "x"), (10, 1, "x"), (5000, 1, "x"), (1000, 1, "x")]
    documents = spark.createDataFrame(texts + odd, "doc_id long, text string, score long")
    model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    rows = toxicity.score(documents.select("doc_id", "text", "score"), model).collect()
    assert len(rows) == len(texts) + len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert all(s >= 0.5 for s in by[None] + by[1003]) and len(by[1003]) == 2
    assert by[1000] == by[1001] and all(by[k][0] < 0.5 for k in (1000, 1001, 1002, 1, 7))
    nothing = toxicity.fit(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(documents, nothing).collect()} == {0.0}
    assert toxicity.score(documents.limit(0), model).collect() == []
