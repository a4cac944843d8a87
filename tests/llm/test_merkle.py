from __future__ import annotations

import hashlib

from pairlens.llm import merkle
from pairlens.llm.queries import QUERIES


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op3_merkle"](spark, folder).collect()}
    assert len(rows) == len(texts)
    near = []
    for i, (key, text) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        r, cut = rows[key], edited(text, follow)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(cut.encode()).hexdigest())
        assert r.fingerprint == merkle.fingerprint_of(text.encode()) and r.edited_fingerprint == merkle.fingerprint_of(cut.encode())
        assert r.near_edited == merkle.likeness_of(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == merkle.likeness_of(r.fingerprint, merkle.fingerprint_of(follow.encode()))
        assert (r.near_next == 1.0) == (text == follow)
        near.append((r.near_edited, r.near_next, text == follow))
    clear = sum(a > b for a, b, same in near if not same)
    assert clear > 0.98 * len(near)
    assert sum(a for a, _, _ in near) / len(near) > 0.4


def test_equal_roots_mean_equal_texts(spark):
    texts = ["", "a", "a\n", "a\n\n", "\na", "a b", "a\nb", "b\na", "a\nb\n"]
    prints = [merkle.fingerprint_of(t.encode()) for t in texts]
    assert len({p[:64] for p in prints}) == len(texts)
    assert merkle.likeness_of(prints[0], prints[0]) == 1.0 and merkle.likeness_of(prints[0], prints[1]) == 0.0


def test_next_over_odd_ids(spark):
    rows = [(5, "e"), (None, "null id"), (-(10**18), None), (5, "d"), (10**18, "last"), (7, "x" * 100_000), (6, "")]
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, next_text string, part int")
    got = merkle.with_next(table).collect()
    order = sorted(((k is not None, k or 0), t or "") for k, t in rows)
    want = sorted((str(k[1] if k[0] else None), t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == want
    assert merkle.with_next(table.limit(0)).collect() == []
    single = merkle.with_next(table.where("doc_id = 7")).collect()
    assert [(r.text, r.next_text) for r in single] == [("x" * 100_000, "x" * 100_000)]


def test_columns_and_nulls(spark):
    table = spark.createDataFrame([(1, None, 2), (1, "a\nb", 3)], "doc_id long, text string, fingerprint int")
    rows = merkle.fingerprint(table, {"text": "fingerprint"}).collect()
    assert [r.fingerprint for r in rows] == [merkle.fingerprint_of(b""), merkle.fingerprint_of(b"a\nb")]
    empty = merkle.likeness(spark.createDataFrame([(None, "00")], "a string, b string"), {"like": ("a", "b")})
    assert empty.collect() == [(None, "00", None)]


def test_edits_are_located(spark):
    lines = [f"paragraph {i} of the text\n" for i in range(60)]
    changed = [*lines[:20], "new line\n", *lines[20:41], "edited\n", *lines[42:]]
    old = merkle.nodes(spark.createDataFrame([(1, "".join(lines)), (2, "same"), (3, None)], "doc_id long, text string"))
    new = merkle.nodes(spark.createDataFrame([(1, "".join(changed)), (2, "same"), (3, "")], "doc_id long, text string"))
    found = sorted((r.doc_id, r.paragraph, r.start, r.length) for r in merkle.edits(old, new).collect())
    spots = [sum(map(len, changed[:i])) for i in (20, 42)]
    assert found == [(1, 20, spots[0], len("new line\n")), (1, 42, spots[1], len("edited\n"))]
