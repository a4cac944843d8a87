from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlens.llm import bpe
from pairlens.llm.queries import QUERIES, TOKENIZER

ODD = [
    "", "   \n\t  ", "a<|endoftext|> b <|endoftext|>  <|endo", "x" * 9000, "naïve 🙂 'll're don't  z", " a  b   c    d\n\n\n e", " " * 5000 + "x",
    "a" + " " * 200_000, "ab" * 100_000, "é" * 70_000 + "!" * 70_000 + "1" * 70_000 + "  '" + "'s", "\x1c\x85  ​　 x", "\n " * 40_000, "a\r\n b",
]


@pytest.fixture(scope="module")
def table():
    return bpe.MergeTable(TOKENIZER)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(reference, text):
    return reference.encode(text, add_special_tokens=False).ids


def test_odd_texts(table, reference):
    encoder = bpe.Encoder(table)
    for text in ODD:
        assert encoder.encode(text).tolist() == ids_of(reference, text)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_text_in_small_parts(table, reference, data):
    """A tiny buffer opens runs all the time; the parts never change the ids."""
    encoder = bpe.Encoder(table, 8)
    text = "".join(c * n for c, n in data.draw(st.lists(st.tuples(st.sampled_from(" \n'sredtlmv<|endoftext|>ab1é🙂.,-"), st.sampled_from([1, 1, 1, 5, 20])), max_size=30)))
    out, at = [], 0
    while at < len(text):
        step = data.draw(st.integers(1, 9))
        out += encoder.feed(text[at : at + step])
        at += step
    assert np.frombuffer(b"".join(out + encoder.finish()), "<i4").tolist() == ids_of(reference, text)


def test_pending_bytes_stay_under_the_bound(table):
    rng = random.Random(1)
    run = bpe.Transducer(table)
    assert 0 < table.lookahead < 5000
    for alphabet in (b"a", b"ab", b"the", bytes(range(97, 123))):
        for _ in range(40):
            run.feed(bytes(rng.choice(alphabet) for _ in range(400)))
            assert run.pending <= table.lookahead + table.longest
        run.finish()


def test_transducer_is_the_definition(table):
    rng = random.Random(2)
    run = bpe.Transducer(table)
    for _ in range(300):
        data = bytes(rng.choice(b"etaoinshr") for _ in range(rng.randrange(1, 40)))
        assert run.once(data) == table.merged(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_decoding_any_ids(reference, ids):
    decoder = bpe._decoder(TOKENIZER)
    assert "".join(decoder.feed(np.array([i])) for i in ids) + decoder.finish() == reference.decode(ids, skip_special_tokens=False)


def test_query_against_tokenizers(spark, reference):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op10_streaming_transducer"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = ids_of(reference, r.text)
        got = rows.pop(r.doc_id)
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert not rows


def test_tables(spark, reference):
    rows = [(1, None, 3), (None, "a b", 4), (2, "", None), (3, "x" * 300_000, 5), (3, "x" * 300_000, 5)]
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids long"), TOKENIZER)
    assert encoded.columns == ["doc_id", "ids"]
    back = bpe.decode(encoded, TOKENIZER)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(k), t or "") for k, t, _ in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None)], "a long, ids array<int>"), TOKENIZER).collect() == [(1, "")]


def test_caches_are_bounded_in_bytes(monkeypatch):
    from pairlens.llm.common import ByteMemo

    memo = ByteMemo(lambda k: (k, (k, k + 1)), 100_000)
    assert all(memo[i] == (i, (i, i + 1)) for i in range(5000)) and all(memo[i][0] == i for i in range(5000))
    assert len(memo) + len(memo._old) < 100_000 / 120
    table = bpe.MergeTable(TOKENIZER)
    text = " ".join(f"w{i * 7919 % 100_003} {chr(97 + i % 26) * (i % 9)}{i}" for i in range(3000))
    whole = bpe.Encoder(table).encode(text).tolist()
    monkeypatch.setattr(bpe, "CACHES", dict.fromkeys(bpe.CACHES, 4000))
    assert bpe.Encoder(bpe.MergeTable(TOKENIZER)).encode(text).tolist() == whole


def test_there_and_back_in_one_pass(spark):
    texts = [None, "", "plain words", "naïve 🙂 <|endoftext|> x", "a\n\n  b " * 2000]
    table = spark.createDataFrame([(i, t, i, "old") for i, t in enumerate(texts)], "doc_id long, text string, other int, decoded string")
    rows = {r.doc_id: r for r in bpe.encode(table, TOKENIZER, decoded="decoded").collect()}
    apart = {r.doc_id: r for r in bpe.decode(bpe.encode(table.drop("decoded"), TOKENIZER), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        assert rows[i].decoded == apart[i].text == (t or "") and rows[i].other == i
