"""Streams whose totals and keys lie in tables, message audits and digests of files."""

from __future__ import annotations

import datetime
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from pairlens import session as S
from pairlens.functions import messages as M
from pairlens.operators import audits as A
from pairlens.operators import metrics as MT
from pairlens.operators import normalize as N
from pairlens.operators import sampling as R
from pairlens.sources import readers as RD
from pairlens.streaming import responses as ST


def write_log(folder, name, ids, final="B", failed=()):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        for i in ids:
            out.write(json.dumps({
                "id": str(i), "dataset": "d", "model": "m", "condition": f"e{i % 2}", "correct": "A", "distractor": "B",
                "initial": "A", "final": None if i in failed else final, "is_error": i in failed,
                "ingested": f"2024-01-01T00:00:{i % 60:02d}"}) + "\n")


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_counts_add_up_to_the_summary(spark, tmp_path):
    log = str(tmp_path / "log")
    write_log(log, "one", range(20), failed=(3, 4))
    rows = N.normalize_responses(spark.read.schema(ST.RESPONSE_SCHEMA).json(log))
    halves = [MT.condition_counts(rows.where(f"cast(id AS int) % 3 {op} 0")) for op in ("=", "<>")]
    assert rows_of(MT.summary_of_counts(MT.add_counts(*halves))) == rows_of(MT.condition_summary(rows))


def test_autosave_shows_totals_so_far(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for n in range(3):
        write_log(log, f"part{n}", range(10 * n, 10 * n + 10), "AB"[n % 2], failed=(10 * n,))
        ST.stream_autosave(spark, log, out).awaitTermination()
        everything = N.normalize_responses(spark.read.schema(ST.RESPONSE_SCHEMA).json(log))
        assert rows_of(spark.read.parquet(f"{out}/summary")) == rows_of(MT.condition_summary(everything))
    # The last batch once more, as after a failure before its commit.
    last = N.normalize_responses(spark.read.schema(ST.RESPONSE_SCHEMA).json(f"{log}/part2.json"))
    again = ST.fold_counts(last, f"{out}/counts", 2)
    assert rows_of(MT.summary_of_counts(again)) == rows_of(MT.condition_summary(everything))
    assert sorted(os.listdir(f"{out}/counts")) == ["batch=1", "batch=2"]


def test_old_keys_leave_the_key_table_as_it_is(spark, tmp_path):
    log, keys = str(tmp_path / "log"), str(tmp_path / "keys")
    write_log(log, "one", [*range(12), 3, 3])
    batch = spark.read.schema(ST.RESPONSE_SCHEMA).json(log).unionByName(
        spark.createDataFrame([(None,) * 10] * 2, ST.RESPONSE_SCHEMA))  # null keys are one key

    def size():
        return sum(spark.read.parquet(f"{keys}/{n}").count() for n in os.listdir(keys))

    assert ST.new_keys(batch, keys, 0, 4).count() == 13 and size() == 13
    assert ST.new_keys(batch, keys, 0, 4).count() == 13 and size() == 13  # run again
    for number in range(1, 12):
        assert ST.new_keys(batch, keys, number, 4).count() == 0
        assert size() <= 26  # merged and, until the stretch after next, what it was merged from
    assert len(os.listdir(keys)) <= 10


def test_stream_keeps_the_first_row_of_a_key(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_log(log, "one", range(10), "B")
    ST.stream_responses(spark, log, out, merge_every=2).awaitTermination()
    for n in range(4):
        write_log(log, f"later{n}", range(10), "A")
        ST.stream_responses(spark, log, out, merge_every=2).awaitTermination()
    write_log(log, "new", range(10, 14), "A")
    ST.stream_responses(spark, log, out, merge_every=2).awaitTermination()
    found = {r.condition: (r.attempted_n, r.accuracy) for r in spark.read.parquet(out).collect()}
    assert found == {"e0": (7, 2 / 7), "e1": (7, 2 / 7)}


def rows_with(spark, *keys, final="A"):
    """Rows with keys ``(id, dataset)``, ingested one second after another."""
    rows = [(i, d, "m" if d else "d", "e", "A", "B", "A", final, False, datetime.datetime(2024, 1, 1, 0, 0, n)) for n, (i, d) in enumerate(keys)]
    return spark.createDataFrame(rows, ST.RESPONSE_SCHEMA)


def ids_of(df):
    return sorted((r.id, r.dataset or "") for r in df.collect())


def test_keys_seen_are_scanned_and_written_again_once_a_power(spark, tmp_path):
    keys = str(tmp_path / "keys")
    for n in range(22):
        batch = rows_with(spark, *[(str(i), "d") for i in (n, n, max(0, n - 1), n // 2, 0)])
        for _ in range(2 if n % 4 == 0 else 1):  # some batches run again
            assert ids_of(ST.new_keys(batch, keys, n, 2)) == [(str(n), "d")]
    held = {name: sorted(int(r.id) for r in spark.read.parquet(f"{keys}/{name}").collect()) for name in os.listdir(keys) if name.startswith("merged=")}
    # 16 and 20 hold what lies behind 20; 18 is what 20 was made of.
    assert held == {"merged=16": list(range(16)), "merged=18": [16, 17], "merged=20": [16, 17, 18, 19]}
    asked, work = rows_with(spark, ("3", "d"), ("x", "d")), str(tmp_path / "work")
    rows = ST._written(asked.withColumn(ST.HASH, F.xxhash64(*ST.KEYS)), f"{work}/rows")
    kind = rows.select(ST.HASH, *ST.KEYS).schema
    for scanned in (True, False):
        found = ST._with_hash_of(rows, S.qualified(spark, work), [S.qualified(spark, f"{keys}/merged={n}") for n in (16, 20)], kind, scanned)
        assert ids_of(found) == [("3", "d")]
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) != scanned


@pytest.mark.parametrize("limit", [10, 0])
def test_keys_that_share_a_hash_stay_apart(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(ST, "LOOKUP_ROWS", limit)
    keys = str(tmp_path / "keys")
    both = [("1", "d"), ("1", None)]  # null and "d" as model hash like "d" and null would
    swapped = rows_with(spark, *both).withColumns({"dataset": F.expr("if(dataset is null, null, 'd')"), "model": F.expr("if(dataset is null, 'd', null)")})
    assert swapped.select(F.xxhash64(*ST.KEYS)).distinct().count() == 1
    one, two = swapped.where("dataset is null"), swapped.where("dataset is not null")
    assert ids_of(ST.new_keys(swapped.unionByName(swapped), keys, 0)) == [("1", ""), ("1", "d")]
    assert ids_of(ST.new_keys(one, keys, 0)) == [("1", "")]
    assert ids_of(ST.new_keys(two.unionByName(one), keys, 1)) == [("1", "d")]
    assert ST.new_keys(swapped, keys, 2).count() == 0


def test_the_earliest_row_of_a_repeated_key_counts(spark, tmp_path):
    late, early = rows_with(spark, ("0", "d"), ("1", "d"), ("2", "d"), final="B"), rows_with(spark, ("2", "d"), ("3", "d"), final="A")
    found = ST.new_keys(late.unionByName(early), str(tmp_path / "keys"), 0)
    assert sorted((r.id, r.final) for r in found.collect()) == [("0", "B"), ("1", "B"), ("2", "A"), ("3", "A")]
    assert ST.new_keys(late.limit(0), str(tmp_path / "keys"), 1).count() == 0


def test_key_folders_of_earlier_versions_are_read(spark, tmp_path):
    keys = str(tmp_path / "keys")
    for n in (0, 1):
        rows_with(spark, (str(n), "d")).select(*ST.KEYS).write.parquet(f"{keys}/batch={n}")
    for n in range(2, 7):
        assert ids_of(ST.new_keys(rows_with(spark, ("0", "d"), ("1", "d"), (str(n), "d")), keys, n, 2)) == [(str(n), "d")]


def plain_collapse(messages):
    out = []
    for m in messages:
        if out and m["role"] is not None and out[-1][0] == m["role"]:
            out[-1][1].append(m["content"])
        else:
            out.append((m["role"], [m["content"]]))
    return [(role, parts[0] if len(parts) == 1 else "\n\n".join(
        f"[Message {i}]\n{p or ''}" for i, p in enumerate(parts, 1))) for role, parts in out]


def test_runs_of_one_role_become_one_message(spark):
    said = lambda *turns: [{"role": r, "content": c} for r, c in turns]
    cases = [
        [], said(("user", "a")), said(("user", "a"), ("user", None), ("assistant", "b"), ("user", "c"), ("user", "")),
        said((None, "a"), (None, "b")), said(("user", None)), said(*[("user", str(i)) for i in range(12)]), None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m array<struct<role:string,content:string>>")
    for r in df.select("i", M.collapse_roles(F.col("m")).alias("m")).collect():
        assert (None if r.m is None else [(m.role, m.content) for m in r.m]) == (None if cases[r.i] is None else plain_collapse(cases[r.i]))


def test_a_conversation_of_a_hundred_thousand_turns_collapses(spark):
    turns = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: M.message(
        F.when(F.floor(i / 3) % 2 == 0, "user").otherwise("assistant"), i.cast("string")))
    row = spark.range(1).select(M.collapse_roles(turns).alias("m")).select(F.size("m").alias("n"), F.col("m")[1].alias("second")).first()
    assert row.n == 33_334 and row.second.content == "[Message 1]\n3\n\n[Message 2]\n4\n\n[Message 3]\n5"


def test_each_kind_of_deviation_has_its_reason(spark):
    built = [("user", t) for t in "abcd"]
    cases = {
        "same": (built, None), "dropped": (built[:1] + built[2:], (2, "missing")), "short": (built[:3], (4, "missing")),
        "swapped": ([built[0], built[2], built[1], built[3]], (2, "swapped")), "reworded": ([*built[:3], ("user", "x")], (4, "reworded")),
        "role": ([("assistant", "a"), *built[1:]], (1, "role")), "added": ([built[0], ("user", "x"), *built[1:]], (2, "added")),
        "more": ([*built, built[3]], (5, "added")), "none": (None, (0, "no messages")), "empty": ([], (1, "missing")),
    }
    df = spark.createDataFrame([(n, m) for n, (m, _) in cases.items()], "name string, m array<struct<role:string,content:string>>")
    expected = F.array(*[M.message(r, F.lit(c)) for r, c in built])
    found = {r.name: (r.position, r.problem) for r in A.message_audit(df, "m", expected).collect()}
    assert found == {n: d for n, (_, d) in cases.items() if d}


def test_digest_of_files_larger_than_a_chunk(spark, tmp_path):
    data = {"a.bin": bytes(range(256)) * 40_000, "b c.bin": b"x", "d.bin": b"\r\n\0"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = RD.fingerprints(spark, str(tmp_path), "*.bin").collect()
    assert {os.path.basename(r.path): (r.length, r.md5) for r in rows} == {
        n: (len(c), hashlib.md5(c).hexdigest()) for n, c in data.items()}


def test_reference_drift_names_fields_and_takes_nulls_as_equal(spark):
    rows = spark.createDataFrame([("1", "e", "q", None), ("2", "e", "x", "A"), ("3", "e", None, "A"), ("4", "e", "q", "A")], "id string, condition string, question string, correct string")
    bank = spark.createDataFrame([("1", "q", None), ("2", "q", "B"), ("3", "q", "A")], "id string, question string, correct string")
    found = {r.id: r.reason for r in A.reference_drift(rows, bank, ["question", "correct"]).collect()}
    assert found == {"2": "question,correct", "3": "question", "4": "absent"}
