from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
from test_minhash import brute

from pairlens.llm import language, packing, pii, quality
from pairlens.llm.common import read


def test_stages_against_plain_versions(spark):
    """Every stage on its predecessor's rows: decisions of the operator, applied by plain code, give the same rows."""
    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    columns = docs.columns
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    model = language.fit(docs)
    rejected = {r.doc_id for r in language.identify(docs, model).collect() if r.rejected}
    kept = corpus_pipeline.settle(corpus_pipeline.identify_language(spark, docs, folder), "t-language")
    assert kept.columns == columns
    one = {r.doc_id: tuple(r) for r in kept.collect()}
    assert one == {k: v for k, v in whole.items() if k not in rejected} and len(one) > 0.99 * len(whole)

    judged = quality.judge(kept, read(spark, folder, "labels"))
    low = {r.doc_id for r in judged.collect() if r.rejected}
    kept = corpus_pipeline.settle(corpus_pipeline.filter_quality(spark, kept, folder), "t-quality")
    two = {r.doc_id: tuple(r) for r in kept.collect()}
    assert kept.columns == columns and two == {k: v for k, v in one.items() if k not in low}

    texts = [(k, v[1]) for k, v in two.items()]
    heads = {c for k, _, c in brute(texts, 5, Fraction(8, 10))}
    kept = corpus_pipeline.settle(corpus_pipeline.drop_near_duplicates(spark, kept, folder), "t-near")
    three = {r.doc_id: tuple(r) for r in kept.collect()}
    assert kept.columns == columns and three == {k: v for k, v in two.items() if k in heads} and len(three) < len(two)

    kept = corpus_pipeline.settle(corpus_pipeline.replace_personal_data(spark, kept, folder), "t-personal")
    four = {r.doc_id: tuple(r) for r in kept.collect()}
    replaced = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame([(k, v[1]) for k, v in three.items()], "doc_id long, text string"), corpus_pipeline.SURROGATE_KEY).collect()}
    assert {k: v[1] for k, v in four.items()} == replaced and any(three[k] != four[k] for k in four)

    last = corpus_pipeline.pack_sequences(spark, kept, folder).collect()
    encoding = packing.load_encoding(corpus_pipeline.TOKENIZER)
    ids = {}
    for r in sorted(last, key=lambda r: r.piece):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {k: encoding.encode_to_numpy(v[1], allowed_special="all").astype("<u4").tobytes() + b"\2\0\0\0" for k, v in four.items()}


def test_run_equals_the_stages_one_by_one(spark):
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder)
    docs = read(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, folder), f"t-{name}")
    order = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[c] for c in order) for r in docs.collect())


def odd_documents(spark):
    rng = random.Random(2)
    words = {"en": [f"the{c}ing" for c in "abcdefghij"], "de": [f"sch{c}ung" for c in "abcdefghij"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, f"s{i % 4}", 0) for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "s1", 0), (501, "", None, None, 0), (502, "123 !!", "en", "s1", 0), (None, rows[3][1] + " extra", "de", None, 0), (None, "theaing thebing " * 20, "en", "s", 0)]
    rows += [(0, rows[0][1], "en", "s0", 0), (0, rows[2][1] + " other", "en", "s0", 0), (600, rows[5][1], "de", "s1", 0), (None, "theaing thebing " * 20, "en", "s", 0)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, key int")


def test_odd_rows_in_every_stage(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = rows.count()
            rows = corpus_pipeline.settle(stage(spark, rows, str(tmp_path)), f"odd-{name}")
            assert rows.columns == docs.columns and rows.count() <= before
        packed = corpus_pipeline.pack_sequences(spark, rows, str(tmp_path))
        assert packed.select("doc_id").distinct().count() <= rows.count() and (packed.count() > 0) == (rows.count() > 0)


def test_one_row_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    # groups by plain comparison, with positions as ids
    groups = {}
    for place, _, head in brute([(i, t) for i, (_, t) in enumerate(texts)], 5, Fraction(8, 10)):
        groups.setdefault(head, []).append(place)
    assert len(kept) == len(groups)
    for places in groups.values():
        members = [texts[p] for p in places]
        ids = [k for k, _ in members if k is not None]
        chosen = [r for r in kept if (r.doc_id, r.text) in members]
        assert len(chosen) >= 1 and (not ids or any(r.doc_id == min(ids) for r in chosen))


def test_spent_working_tables_go_and_results_stay(spark, monkeypatch, tmp_path):
    from pairlens import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("pairlens/*/*")}
    assert left == {"packing-counts", "packing-pieces", *(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES[:-1])}
    n = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert first.count() == n > 0
