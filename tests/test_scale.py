"""Work is dealt by rows: what one task holds does not grow with the input."""

from pyspark.sql import functions as F

from pairlens import session as S
from pairlens.catalog import views as V
from pairlens.catalog.normalizing import step_table
from pairlens.operators import audits as A
from pairlens.operators.normalize import with_record
from pairlens.operators.steps import flip_steps
from pairlens.sources import archives as AR
from pairlens.sources import readers as R


def tables(spark, folder, orders):
    spark.range(orders).selectExpr("id as o_orderkey", "id % 7 as o_custkey").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(7).selectExpr("id as c_custkey", "'m' as c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_driving_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        folder = tables(spark, tmp_path, 400)
        assert V.view(spark, folder, "responses").rdd.getNumPartitions() == 40
        assert spark.conf.get("spark.sql.shuffle.partitions") == "14"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def restored(spark, *names):
    before = {n: spark.conf.get(n) for n in names}
    return lambda: [spark.conf.set(n, v) for n, v in before.items()]


def test_rows_stay_dealt_after_a_shuffled_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 10)
    back = restored(spark, "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        folder = tables(spark, tmp_path, 400)
        for name, each in (("responses", 4), ("lines", 4), ("ablation", 7)):
            rows = V.view(spark, folder, name).where("k >= 0")
            held = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert sum(r["count"] for r in held) == 400 * each
            assert max(r["count"] for r in held) <= 3 * 10 * each
    finally:
        back()


def test_merged_shuffles_are_bounded(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    back = restored(spark, name)
    try:
        for given, kept in (("64MB", V.MERGED_BYTES), ("1m", 1 << 20), (str(2 << 20), 2 << 20)):
            spark.conf.set(name, given)
            V.at_most_bytes(spark, name, V.MERGED_BYTES)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) == kept
    finally:
        back()


def test_unique_keys_are_grouped_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 10)
    lines = spark.range(400).selectExpr("'a' as file", "concat('{\"id\": ', id div 2, '}') as value").coalesce(1)
    facts = A.integrity_facts(lines)
    profile = A.profile_of_facts(facts)
    assert "RepartitionByExpression" in profile._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.total_lines, r.unique_item_ids, r.item_id_duplicates) for r in profile.collect()] == [(400, 200, 200)]
    found = S.settle(spark.range(400).toDF("id"), "ids")
    assert S.dealt(found, found, "id").rdd.getNumPartitions() == 40
    assert R.require_unique(found, ["id"]).count() == 400


def test_labels_of_lines_need_no_lower(spark, tmp_path):
    folder = tables(spark, tmp_path, 40)
    lines = V.view(spark, folder, "lines")
    assert "lower(" not in lines._jdf.queryExecution().analyzed().toString()
    said = lines.where("k % 4 = 0").select("value").collect()
    assert any('"final_prediction": " a "' in r.value for r in said)


def test_flips_need_no_interpreted_lambda(spark, tmp_path):
    steps = "array(named_struct('p', 'A'), named_struct('p', null), named_struct('p', null), named_struct('p', 'B'))"
    rows = spark.sql(f"select 1 id, {steps} steps union all select 2, null union all select 3, slice({steps}, 1, 0)")
    flips = flip_steps(rows, value="p")
    assert "lambda" not in flips._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in flips.orderBy("step").collect()] == [
        (1, 1, "A", None, None), (1, 2, None, "A", True), (1, 3, None, None, False), (1, 4, "B", None, True)]
    plan = step_table(spark, tables(spark, tmp_path, 8))._jdf.queryExecution().analyzed().toString()
    assert "_said5" in plan


def test_records_are_parsed_once_without_lambda(spark):
    rows = spark.createDataFrame([('{"a": NaN}',), ('{"a": 1, "a": 2}',), ("{} {}",), ("",), (None,), ("null",), ("[1, 2]",), ("1, 2",)], "value string")
    found = with_record(rows)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan and plan.count("from_json") == 1
    assert [r.v for r in found.select(F.to_json("_v").alias("v")).collect()] == ['{"a":"NaN"}', '{"a":2}', None, None, None, "null", "[1,2]", None]


def test_archives_order_compressed_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(AR, "RUN", 3)
    rows = [(f"exp{k}.jsonl", n, None if n == 5 else f"{k} {n}") for k in range(3) for n in range(40)] + [("exp0.jsonl", 7, "0 7")] * 9
    AR.write_archives(spark.createDataFrame(rows, "file string, line_number long, value string").repartition(5), str(tmp_path / "out"), 2)
    got = sorted((r.file, r.line_number, r.value) for r in AR.archive_lines(spark, str(tmp_path / "out")).collect())
    want = [(f, i, v) for name in sorted({r[0] for r in rows}) for i, (f, v) in enumerate(((f, v or "") for f, _, v in sorted((r for r in rows if r[0] == name), key=lambda r: r[1])), 1)]
    assert got == want
