"""Pairing, guards, sources, sampling and streaming on small fixtures."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.operators import audits as A
from pairlens.operators import guards as G
from pairlens.operators import inference as I
from pairlens.operators import metrics as M
from pairlens.operators import normalize as N
from pairlens.operators import pairing as P
from pairlens.operators import requests as Q
from pairlens.operators import sampling as R
from pairlens.plans import reports as RP
from pairlens.sources import manifest as MF
from pairlens.sources import archives as AR
from pairlens.sources import readers as RD
from pairlens.streaming import responses as ST


def cell(path, finals, question="q", key="final_prediction"):
    """Write ten items with gold A, target B and initial A; a null final is an error row."""
    with open(path, "w", encoding="utf-8") as out:
        for i, final in enumerate(finals):
            out.write(json.dumps({
                "id": i, "question": f"{question} {i}", "options": {"A": "x", "B": "y", "C": "z"}, key: final,
                "correct_answer": "A", "distractor": "B", "initial_prediction": "A", "is_error": final is None,
            }) + "\n\n")


@pytest.fixture
def run(tmp_path):
    cell(tmp_path / "exp1.jsonl", ["A"] * 10)
    cell(tmp_path / "exp2.jsonl", ["B"] + ["A"] * 9, key="attack_prediction")
    cell(tmp_path / "exp3.jsonl", ["A"] * 9 + [None])
    cell(tmp_path / "exp4.jsonl", ["C"] * 10)
    manifest = {"cells": [{"dataset": "d", "model": "m", "conditions": {
        f"exp{i}": f"exp{i}.jsonl" for i in range(1, 5)}}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    return tmp_path


def test_paired_protocol_from_a_manifest(spark, run):
    found = RP.paired_protocol_files(spark, str(run / "manifest.json"))
    rows = {(r.condition1, r.metric): r for r in found["comparisons"].collect()}
    harm = rows[("exp1", "harmful_conformity")]
    assert (harm.paired_n, harm.rate1, harm.rate2, harm.mcnemar_b, harm.mcnemar_c) == (10, 0.0, 0.1, 0, 1)
    assert harm.delta == pytest.approx(0.1) and harm.ci_low <= 0.1 <= harm.ci_high
    assert rows[("exp2", "accuracy")].paired_n == 9
    none = rows[("exp1", "beneficial_revision")]
    assert none.paired_n == 0 and none.rate1 is None and none.p_raw is None and none.p_holm is None
    audit = {r.condition1: r for r in found["pair_audits"].collect()}
    assert audit["exp1"].common_id_n == 10


def test_drift_fails_the_report(spark, run):
    cell(run / "exp2.jsonl", ["A"] * 10, question="other")
    with pytest.raises(ValueError, match="drift"):
        RP.paired_protocol_files(spark, str(run / "manifest.json"))


@pytest.mark.parametrize("content, text", [
    ({"cells": []}, "non-empty"),
    ({"cells": [{"dataset": "d", "model": "m", "conditions": {"exp1": "exp1.jsonl"}}]}, "lacks"),
    ({"cells": [{"dataset": "d", "model": "", "conditions": {}}]}, "needs"),
    ({"comparisons": [["exp1"]], "cells": [{}]}, "comparison"),
])
def test_bad_manifests(spark, run, content, text):
    with pytest.raises(ValueError, match=text):
        MF.check_manifest(spark, content, str(run))


@pytest.mark.parametrize("extra, text", [(None, "no records found for"), (["A"] * 10, "duplicate item id")])
def test_grid_rejects_empty_conditions_and_repeated_items(spark, run, extra, text):
    if extra is None:
        (run / "exp4.jsonl").write_text("\n")
    else:
        (run / "exp4.jsonl").write_text((run / "exp1.jsonl").read_text() * 2)
    with pytest.raises(ValueError, match=text):
        RP.paired_protocol_files(spark, str(run / "manifest.json"))


def test_item_bank(spark, tmp_path):
    path = tmp_path / "bank.json"
    path.write_text(json.dumps([{"item_id": 7, "question": "q", "options": {"A": "x"}}, {"id": "8"}]))
    assert {r.id for r in RD.read_item_bank(spark, str(path)).collect()} == {"7", "8"}
    path.write_text(json.dumps([{"id": 7}, {"id": "7"}]))
    with pytest.raises(ValueError, match="duplicate"):
        RD.read_item_bank(spark, str(path))


def test_missing_files_and_repeated_cells(spark, run):
    good = {"dataset": "d", "model": "m", "conditions": {f"exp{i}": f"exp{i}.jsonl" for i in range(1, 4)}}
    with pytest.raises(ValueError, match="duplicate"):
        MF.check_manifest(spark, {"cells": [good, good]}, str(run))
    bad = {**good, "conditions": {**good["conditions"], "exp3": "none.jsonl"}}
    with pytest.raises(FileNotFoundError):
        MF.check_manifest(spark, {"cells": [bad]}, str(run))


@pytest.mark.parametrize("line, text", [
    ('{"id": 1', "invalid JSON"), ('{"id": 1} {"id": 2}', "invalid JSON"), ('{"question": "q"}', "missing item id"),
    ('{"id": 5}\n{"id": "5"}', "duplicate"),
])
def test_strict_reader_fails_closed(spark, tmp_path, line, text):
    (tmp_path / "rows.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match=text):
        RD.read_strict(spark, str(tmp_path / "rows.jsonl")).collect()


def test_a_fault_is_named_by_file_and_line(spark, tmp_path, small_ranges):
    sound = [json.dumps({"id": i, "question": "q" * 40}) for i in range(100)]
    (tmp_path / "a.jsonl").write_text("\n".join(sound) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([*sound[:30], "", *sound[30:60], '{"question": "q"}', '{"id": ', *sound[60:]]) + "\n")
    with pytest.raises(ValueError, match=r"missing item id in .*/b.jsonl, line 62"):
        RD.read_strict(spark, str(tmp_path))
    (tmp_path / "a.jsonl").write_text("\n".join([*sound, "[", "{}"]))
    with pytest.raises(ValueError, match=r"invalid JSON in .*/a.jsonl, line 101"):
        RD.read_strict(spark, str(tmp_path))


def test_empty_input_is_an_error(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text("\n  \n")
    with pytest.raises(ValueError, match="no records"):
        RD.read_strict(spark, str(tmp_path / "rows.jsonl"))


def test_present_null_wins_and_string_true_is_no_error(spark):
    lines = ['{"id": 1, "final_answer": null, "prediction": "A", "initial_answer": "a", "gold_answer": "A", "target_wrong": "B"}',
             '{"id": 2, "prediction": " b ", "initial_answer": "a", "gold_answer": "A", "target_wrong": "B", "is_error": "true"}',
             '{"id": 3, "prediction": "A", "initial_answer": "a", "gold_answer": "A", "target_wrong": "B", "valid": false}']
    rows = N.normalize_lines(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("id").collect()
    assert [(r.final, r.valid) for r in rows] == [(None, False), ("B", True), ("A", False)]


def test_tar_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, text in (("run/exp1.jsonl", '{"id": 1}\n\n{"id": 2}\n'), ("run/notes.txt", "x"), ("run/other.jsonl", "x")):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    rows = AR.read_archives(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.file, r.line_number, r.value) for r in rows] == [
        ("run/exp1.jsonl", 1, '{"id": 1}'), ("run/exp1.jsonl", 2, ""), ("run/exp1.jsonl", 3, '{"id": 2}')]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = RD.text_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        rows = RD.with_line_numbers(lines, F.col("value").endswith("7")).collect()
        assert len(rows) == 1000
        assert all(int(r.value[1:]) + 1 == r.line_number for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fingerprints(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = RD.fingerprints(spark, str(tmp_path)).first()
    assert row.md5 == hashlib.md5(b"abc").hexdigest()
    with pytest.raises(Exception, match="fingerprint"):
        RD.require_fingerprint(RD.fingerprints(spark, str(tmp_path)), "0").collect()


def test_result_csv_and_forest_rows(spark, run):
    found = RP.paired_protocol_files(spark, str(run / "manifest.json"))["comparisons"]
    assert RP.forest_source(found, rows=1).count() == 1
    with pytest.raises(ValueError, match="forest"):
        RP.forest_source(found, rows=6)


def frame(spark, ids, hot=0):
    rows = [("d", "m", c, str(i), "A", "B", "A", "B" if (i + len(c)) % 3 else "A", False) for i in ids for c in ("e1", "exp22")]
    rows += [("d", "m", "e1", "hot", "A", "B", "A", "A", False)] * hot
    return N.normalize_responses(spark.createDataFrame(
        rows, "dataset string, model string, condition string, id string, correct string, distractor string, "
              "initial string, final string, is_error boolean"))


def test_pairing_equals_the_plain_join(spark):
    df = frame(spark, range(200))
    pairs = P.pair_join(df, [("e1", "exp22")], M.PAIRED_METRICS[1])
    a, b = df.where("condition = 'e1'").alias("a"), df.where("condition = 'exp22'").alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id")).where("a.valid AND b.valid").selectExpr(
        "a.id", "a.final = a.distractor AS o1", "b.final = b.distractor AS o2")
    assert {tuple(r) for r in pairs.select("id", "outcome1", "outcome2").collect()} == {tuple(r) for r in joined.collect()}


def test_a_hot_repeated_id_fails_in_pairs_and_is_counted_in_audits(spark):
    df = frame(spark, range(50), hot=3000)
    with pytest.raises(Exception, match="duplicate item id hot"):
        I.paired_contrast(df, [("e1", "exp22")]).collect()
    found = A.dup_ids(df, ["dataset", "model", "condition", "id"]).collect()
    assert [(r.id, r.rows, r.extra_rows) for r in found] == [("hot", 3000, 2999)]


def test_samples_do_not_depend_on_partitioning(spark):
    ids = spark.range(3000).selectExpr("'d' AS dataset", "cast(id AS string) AS id")

    def drawn(df):
        return sorted(map(tuple, R.repeated_sample(df, 50, 4).collect()))

    first = drawn(ids.repartition(1))
    assert first == drawn(ids.repartition(13).orderBy(F.desc("id"))) and len(first) == 200
    want = sorted((hashlib.md5(f"1000|d|{i}".encode()).hexdigest(), str(i)) for i in range(3000))[:50]
    assert {r[4] for r in first if r[1] == 1} == {i for _, i in want}
    with pytest.raises(Exception, match="too small"):
        R.repeated_sample(ids.limit(10), 50, 1).collect()


def test_near_and_far_groups_keep_input_order_on_ties(spark):
    rows = [(i, 0.5, 0.5) for i in range(6)] + [(6, 0.9, 0.9), (7, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "id int, similarity_score double, exclusion_score double")
    found = {(r.group, r.id) for r in R.near_far_groups(df, 2).collect()}
    assert found == {("near_similar", 6), ("near_similar", 0), ("far_exclusive", 7), ("far_exclusive", 1)}


def test_candidate_texts():
    assert R.candidate_texts(["Noted.  Next.", "Noted. Next."]) == ["Noted. Next."]
    with pytest.raises(ValueError, match="stance"):
        R.candidate_texts(["I agree."])


def test_guards(spark):
    assert G.row_count_guard(spark.range(5), 5).first().rows == 5
    with pytest.raises(Exception, match="expected 6 rows, got 5"):
        G.row_count_guard(spark.range(5), 6).collect()


def test_strict_audits_fail(spark):
    df = frame(spark, range(20))
    fields = ["correct", "distractor", "initial"]
    assert A.metadata_drift(df, fields, strict=True).count() == 20
    bad = df.withColumn("initial", F.when((F.col("id") == "3") & (F.col("condition") == "e1"), "C").otherwise(F.col("initial")))
    with pytest.raises(Exception, match="drift of item 3: initial"):
        A.metadata_drift(bad, fields, strict=True).collect()
    short = df.where("NOT (id = '4' AND condition = 'e1')")
    with pytest.raises(Exception, match="unaligned item 4"):
        A.id_sets_equal(short, ("e1", "exp22"), strict=True).collect()


def test_token_pairs(spark):
    rows = [("d", "m", c, i, t) for i, (x, y) in {"one": (100, 100), "two": (103, 100)}.items()
            for c, t in (("a", x), ("b", y))]
    df = spark.createDataFrame(rows, "dataset string, model string, condition string, id string, final_prompt_token_count int")
    pairs = I.token_pairs(df, [("a", "b")])
    assert [tuple(r)[4:] for r in I.token_pair_audit(pairs).collect()] == [(2, 2, 1)]
    assert {(r.difference, r["items"]) for r in I.token_pair_histogram(pairs).collect()} == {(0, 1), (3, 1)}


def test_modal_length_and_controls(spark):
    from pairlens.functions.messages import word_tokens

    turns = spark.createDataFrame([("a b c",)] * 7 + [("a b",)] * 2, "t string")
    row = R.control_select(turns, "t", ["x y", "one two three", "p q r", "u v w"], word_tokens).first()
    assert (row.target_tokens, row.neutral_v1, row.neutral_v2) == (3, "one two three", "p q r")
    with pytest.raises(Exception, match="fewer than two"):
        R.control_select(turns, "t", ["x y", "one two three"], word_tokens).collect()
    tie = spark.createDataFrame([(3,), (2,), (3,), (2,)], "n int")
    assert R.modal_value(tie, "n").first().n == 2


def test_model_contract(spark):
    requests = spark.createDataFrame([("1", [("user", "hi")])], "id string, messages array<struct<role:string,content:string>>")

    def model(messages):
        return {"text": messages[0]["content"].upper()}

    assert Q.answer_with(requests, model).first().text == "HI"


def test_stream_continues_after_a_restart(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    os.mkdir(log)

    def append(name, ids):
        with open(f"{log}/{name}.json", "w") as f:
            for i in ids:
                f.write(json.dumps({"id": str(i), "dataset": "d", "model": "m", "condition": "e", "correct": "A",
                                    "distractor": "B", "initial": "A", "final": "B", "is_error": False}) + "\n")

    append("one", range(10))
    ST.stream_responses(spark, log, out, mark).awaitTermination()
    append("two", range(5, 15))
    ST.stream_responses(spark, log, out, mark).awaitTermination()
    row = spark.read.parquet(out).first()
    assert (row.attempted_n, row.target_adoption) == (15, 1.0)


def test_settings_and_fixed_lists(spark):
    assert len(K.ANTONYM_PAIRS) == 20 and len(K.ANSWER_PATTERNS) == 12
    assert sum(c[3] for c in K.ABLATION_COMPARISONS) == 9


def test_shared_folder_comes_from_the_session(spark):
    from types import SimpleNamespace

    from pairlens.session import scratch, shared_dir

    def fake(value, name="app-1", master="local[2]", given=None):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(applicationId=name, master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value), sparkContext=context)

    assert shared_dir(fake("hdfs://shared/dir")) == "hdfs://shared/dir"
    assert shared_dir(fake(None, given="hdfs://given")) == "hdfs://given"
    assert scratch(fake("hdfs://shared/dir/"), "x").startswith("hdfs://shared/dir/pairlens/app-1/x-")
    assert shared_dir(fake(None)) == shared_dir(fake(None)) != shared_dir(fake("", "app-2"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(fake(None, master="spark://host:7077"))


def test_release_removes_what_the_run_wrote(spark, tmp_path, monkeypatch):
    from pairlens import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert session.settle(spark.range(5), "x").count() == 5
    assert list(tmp_path.glob("pairlens/*/x-*"))
    session.release(spark)
    assert not list(tmp_path.glob("pairlens/*/*"))


def test_json_files_of_every_shape(spark, tmp_path):
    from pairlens.sources import readers as R

    def rows(*texts):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for i, text in enumerate(texts):
            (folder / f"{i}.json").write_text(text)
        return sorted(r.a for r in R.read_json_or_jsonl(spark, str(folder), "a long, b string").collect())

    lines = "\n".join(f'{{"a": {i}}}' for i in range(1000))
    assert rows("\n" + lines) == list(range(1000))  # a blank line first
    assert rows('{\n "a": 7,\n "b": "x"\n}\n') == [7]  # one object over several lines
    assert rows('[{"a": 1}, {"a": 2}]') == [1, 2] and rows('[\n{"a": 1},\n{"a": 2}\n]\n') == [1, 2]
    assert rows("") == [] and rows("\n \n") == []
    assert rows('{"a": 1}\n{"a": 2}', '[\n{"a": 3}\n]', "", '{\n"a": 4}') == [1, 2, 3, 4]  # a mixed folder
    for broken in (lines + '\n{"a": ', '{"a": 1}\n{"a": 2} x', "[1,\n2"):
        with pytest.raises(Exception, match="invalid JSON"):
            rows(broken)


def test_json_lines_that_other_parsers_take(spark):
    texts = ['{"id": "1", "x": NaN}', '{"id": "2", "x": -Infinity}', '{"id": "3", "id": "4"}', '{"id": "5"} {"id": "6"}', '{"id": ']
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    ids = [r.id for r in N.with_record(rows).selectExpr("variant_get(_v, '$.id', 'string') AS id").collect()]
    assert ids == ["1", "2", "4", None, None]


def test_text_that_reads_like_an_empty_array_is_not_empty(spark):
    from pairlens.functions.labels import empty_json

    texts = ['"[]"', '"{}"', "[]", "{}", '" "', "null", "[0]", "0"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("v", F.parse_json("value"))
    assert [r.e for r in rows.select(empty_json(F.col("v")).alias("e")).collect()] == [False, False, True, True, True, True, False, False]


def test_slices_go_by_position(spark):
    from pairlens.operators.items import limit_slice

    rows = spark.range(0, 1000, 10).withColumnRenamed("id", "at")
    ids = lambda df: sorted(r.at for r in df.collect())
    assert ids(limit_slice(rows, "at", 0, 5)) == [0, 10, 20, 30, 40]
    assert ids(limit_slice(rows, "at", 97, 5)) == [970, 980, 990] and ids(limit_slice(rows, "at", 98)) == [980, 990]
    assert ids(limit_slice(rows, "at", 100, 5)) == [] and len(ids(limit_slice(rows, "at"))) == 100


def test_reports_fail_closed(spark):
    from pairlens.operators.audits import score_validate
    from pairlens.plans import reports as RP

    base = [("d", "m", c, str(i), "A", "B", "A", "B", "q") for c in ("exp1", "exp2", "exp3", "exp4") for i in range(4)]
    names = "dataset string, model string, condition string, id string, correct string, distractor string, initial string, final string, question string"

    def table(change):
        return N.normalize_responses(spark.createDataFrame([change(r) for r in base], names))

    def put(condition, item, place, value):
        return lambda r: (*r[:place], value, *r[place + 1:]) if (r[2], r[3]) == (condition, item) else r

    assert RP.four_protocol(table(lambda r: r))["rows"].count() == 4
    with pytest.raises(Exception, match="initial accuracy|fields=.initial"):
        RP.four_protocol(table(put("exp4", "1", 6, "C")))["rows"].collect()
    with pytest.raises(ValueError, match="metadata drift"):
        RP.four_protocol(table(put("exp4", "1", 8, "other")))
    # an item of exp1 and exp3 alone is in no compared pair, so that its drift does not matter
    lone = table(put("exp3", "1", 8, "other")).where("NOT (id = '1' AND condition = 'exp2')")
    assert RP.paired_protocol(lone, [("exp1", "exp2"), ("exp2", "exp3")], reps=100)["comparisons"].count() > 0
    with pytest.raises(ValueError, match="metadata drift"):
        RP.paired_protocol(table(put("exp3", "1", 8, "other")), [("exp2", "exp3")], reps=100)
    with pytest.raises(ValueError, match="metadata drift"):
        RP.repeated_subset(table(put("exp2", "1", 8, "other")), 2, 2)
    scores = spark.createDataFrame([("1", 0.5, ["A"], {"A": 1.0}), ("1", 0.5, ["A"], {"A": 1.0})], "id string, target_probability double, candidate_labels array<string>, probabilities map<string,double>")
    with pytest.raises(ValueError, match="repeated score"):
        score_validate(scores, strict=True)
    with pytest.raises(ValueError, match="expected 3"):
        score_validate(scores.limit(1), strict=True, rows=3)


def test_tercile_and_ablation_reports_fail_closed(spark):
    base = [("d", "m", c, str(i), "A", "B", "A", "B" if i % 2 else "A", 10) for c in K.FOUR_PROTOCOLS for i in range(9)]
    names = "dataset string, model string, condition string, id string, correct string, distractor string, initial string, final string, final_prompt_token_count int"
    rows = N.normalize_responses(spark.createDataFrame(base, names))
    points = [("d", "m", str(i), i / 10, "A", "B") for i in range(9)]
    fields = "dataset string, model string, id string, target_probability double, correct_answer string, target_distractor string"

    def report(scores, table=rows):
        return RP.tercile_report(table, spark.createDataFrame(scores, fields), reps=100)["thresholds"].collect()

    assert len(report(points)) == 1
    with pytest.raises(ValueError, match="repeated score"):
        report([*points, points[0]])
    with pytest.raises(ValueError, match="another item"):
        report([*points[1:], ("d", "m", "0", 0.0, "C", "B")])
    with pytest.raises(Exception, match="item without score"):
        report(points[1:])
    moved = rows.withColumn("distractor", F.when(F.expr("condition = 'exp2' AND id = '3'"), "C").otherwise(F.col("distractor")))
    with pytest.raises(ValueError, match="metadata drift"):
        report(points, moved)
    with pytest.raises(ValueError, match="metadata drift"):
        RP.ablation_report(moved)
    with pytest.raises(ValueError, match="unaligned item"):
        RP.ablation_report(rows.where("NOT (condition = 'exp1' AND id = '3')"))


def test_label_report_from_lines_of_both_generations(spark):
    texts = [
        '{"final_answer": "A", "raw_output": "x", "correct_answer": "A", "distractor": "B", "option_logprobs": {"A": -0.1, "B": -2.0}}',
        '{"attack_prediction": "b", "raw_attack_output": "y", "correct": "A", "target_distractor": "B"}',
        '{"text": "ANSWER: B", "gold_answer": "A", "target_wrong": "B", "is_error": true, "error": "boom"}', "", "{broken",
    ]
    lines = spark.createDataFrame([("labelled_5_wrong", t) for t in texts], "condition string, value string")
    found = RP.label_attention_report(A.label_answers(A.label_lines(lines)))
    rows = {r.condition: r for r in found["conditions"].collect()}
    assert set(rows) == set(K.LABEL_CONDITIONS)
    labelled, unlabelled, _ = K.LABEL_CONDITIONS
    assert (rows["labelled_5_wrong"].rows, rows["labelled_5_wrong"].correct_n, rows["labelled_5_wrong"].distractor_n) == (3, 1, 2)
    absent = rows[unlabelled if labelled == "labelled_5_wrong" else labelled]
    assert (absent.rows, absent.valid, absent.accuracy) == (0, 0, None)
    assert found["conclusions"].first().run_state == "usable"


def test_a_run_of_errors_is_a_failed_run(spark):
    rows = spark.createDataFrame(
        [("labelled_5_wrong", "A", "A", "B", None, None, True, "boom")] * 3,
        "condition string, answer string, correct string, distractor string, correct_lp double, distractor_lp double, is_error boolean, error string")
    assert M.label_differences(M.label_summary(rows, with_errors=True)).first().no_valid_answers
    assert not M.label_differences(M.label_summary(rows)).first().no_valid_answers


def test_a_restart_goes_on_where_the_last_run_ended(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def append(ids):
        rows = spark.createDataFrame([(str(i),) for i in ids], "id string").selectExpr(
            "id", "'d' AS dataset", "'m' AS model", "'exp1' AS condition", "'A' AS correct", "'B' AS distractor", "'A' AS initial", "'B' AS final",
            "false AS is_error", "current_timestamp() AS ingested")
        rows.write.mode("append").json(log)

    append(range(10))
    ST.stream_autosave(spark, log, out).awaitTermination()
    append(range(10, 30))
    ST.stream_autosave(spark, log, out).awaitTermination()
    saved = spark.read.parquet(f"{out}/rows")
    assert (saved.count(), saved.select("id").distinct().count()) == (30, 30)
    with pytest.raises(ValueError, match="no checkpoint"):
        ST.stream_autosave(spark, log, out, str(tmp_path / "elsewhere"))


def test_one_hot_cell_gives_the_same_rates_after_any_split(spark):
    # A third of all rows belongs to one cell and one item range; counts must not depend on the partitioning.
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('m', id % 50) END AS model", "'d' AS dataset",
        "cast(id div 2 AS string) AS id", "CASE WHEN id % 2 = 0 THEN 'e1' ELSE 'exp22' END AS condition",
        "'A' AS correct", "'B' AS distractor", "'A' AS initial", "CASE WHEN id % 7 < 3 THEN 'B' ELSE 'A' END AS final")
    rows = N.normalize_responses(df.withColumn("model", F.lit("hot")))
    contrast = [("e1", "exp22")]
    one = sorted(map(str, I.paired_contrast(rows.repartition(1), contrast).collect()))
    many = sorted(map(str, I.paired_contrast(rows.repartition(37), contrast).collect()))
    found = {r.metric: r for r in I.paired_contrast(rows, contrast).collect()}
    want = [(2 * i % 7 < 3, (2 * i + 1) % 7 < 3) for i in range(15_000)]
    assert one == many and found["target_adoption"].paired_n == 15_000
    assert found["target_adoption"].mcnemar_b == sum(a and not b for a, b in want)
    assert found["target_adoption"].mcnemar_c == sum(b and not a for a, b in want)


def test_strata_take_one_exchange_of_response_rows(spark):
    """Thresholds, rates and contrasts of a report derive from one row per item, and equal those of the rows."""
    from pairlens.operators.inference import paired_contrast
    from pairlens.operators.metrics import CONFORMITY_ONLY

    df = frame(spark, range(60)).withColumns({"dataset": F.lit("d"), "model": F.lit("m")})
    conditions = sorted(r[0] for r in df.select("condition").distinct().collect())[:2]
    rows = df.where(F.col("condition").isin(*conditions))
    items = R.stratum_items(df, conditions, ["correct", "distractor"])
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    strata = items.select("dataset", "model", "id", *[f"c{k}" for k in range(2)]).withColumns({
        "stratum": F.when(F.col("id").cast("int") % 2 == 0, "Low").otherwise("High"), "target_probability": F.col("id").cast("double") / 100})
    histogram = R.stratum_histogram(strata, 2)
    joined = rows.join(strata.select("dataset", "model", "id", "stratum", "target_probability"), ["dataset", "model", "id"])
    order = ["condition", "stratum"]
    valid = joined.where("valid")
    assert sorted(map(str, R.metrics_of_histogram(histogram, conditions).select(*order, "cr_n", "cr", "hcr_n", "hcr").collect())) == sorted(
        map(str, R.stratum_metrics(valid).select(*order, "cr_n", "cr", "hcr_n", "hcr").collect()))
    pair = [(conditions[0], conditions[1])]
    wide = ["stratum", "paired_n", "delta", "mcnemar_b", "mcnemar_c", "p_holm"]
    assert sorted(map(str, R.contrasts_of_histogram(histogram, conditions, pair).select(*wide).collect())) == sorted(
        map(str, paired_contrast(joined, pair, CONFORMITY_ONLY, keys=("dataset", "model", "stratum")).select(*wide).collect()))
    with pytest.raises(ValueError, match="not compared"):
        R.contrasts_of_histogram(histogram, conditions, [("none", conditions[0])])


def test_drift_of_all_contrasts_in_one_pass(spark):
    df = frame(spark, range(12)).withColumns({"dataset": F.lit("d"), "model": F.lit("m")})
    a, b, *_ = sorted(r[0] for r in df.select("condition").distinct().collect())
    bad = df.withColumn("correct", F.when((F.col("id") == "3") & (F.col("condition") == b), "Z").otherwise(F.col("correct")))
    found = A.contrast_drift(bad, [(a, b), (a, a)], ["correct", "initial"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.id, r.condition1, r.condition2, r.fields) for r in found.collect()] == [("3", a, b, "correct")]
    one_sided = bad.where(f"NOT (id = '3' AND condition = '{a}')")
    assert A.contrast_drift(one_sided, [(a, b)], ["correct"]).isEmpty()


def test_display_names_keep_the_stated_size(spark):
    from pairlens.functions.labels import name_shorten

    names = ["Qwen/Qwen2.5-3B-Instruct", "Qwen/Qwen2.5-7B-Instruct", "Qwen/other", "microsoft/Phi-3.5-mini-instruct", "google/gemma-2-2b-it", "own/model", None]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, model string").orderBy("i")
    assert [r.n for r in table.select(name_shorten(F.col("model")).alias("n")).collect()] == ["Qwen2.5-3B", "Qwen2.5-7B", "Qwen2.5-3B", "Phi-3.5-mini", "Gemma2-2B", "own/model", None]
    given = name_shorten(F.col("model"), {"own/model": "Own", "Qwen/other": "Other"})
    assert [r.n for r in table.select(given.alias("n")).collect()] == ["Qwen2.5-3B", "Qwen2.5-7B", "Other", "Phi-3.5-mini", "Gemma2-2B", "Own", None]
