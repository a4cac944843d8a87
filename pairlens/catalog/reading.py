"""Sources and sinks: what is written from the derived tables is read back and must be the same."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.catalog.inference import PAIRED_CONTRAST, inference_rounded
from pairlens.catalog.common import responses
from pairlens.catalog.normalizing import _NORMALIZED
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.operators import inference as I
from pairlens.operators.normalize import with_record
from pairlens.session import data_files, scratch
from pairlens.sources import archives as AR
from pairlens.sources import manifest as MF
from pairlens.sources import readers as R
from pairlens.sources import sinks as S


def json_arrays(df: DataFrame, path: str) -> None:
    """Write the rows as JSON array files, one array per task."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for batch in batches:
            if len(batch):
                heads = [",\n"] * len(batch)
                heads[0] = ",\n" if opened else "[\n"
                opened = True
                yield pd.DataFrame({"value": [h + v for h, v in zip(heads, batch["value"], strict=True)]})
        yield pd.DataFrame({"value": ["]" if opened else "[]"]})

    rows.mapInPandas(bracket, "value string").write.text(path)


GOOD_LINES = "good AS (SELECT * FROM lines WHERE json_valid(value))"
_VALID_ROWS = """coalesce(NOT is_error AND NOT marked AND list_contains(labels, initial) AND list_contains(labels, final)
    AND list_contains(labels, correct) AND list_contains(labels, distractor) AND correct <> distractor, false)"""


@query("src_jsonl_strict", f"""WITH {_NORMALIZED}
SELECT file, count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (WHERE {_VALID_ROWS}) AS valid
FROM lettered GROUP BY file""", ("lines",))
def _(spark, folder):
    # Blank lines stay in; broken ones would fail the strict reader and are left to the permissive one.
    path = scratch(spark, "strict")
    lines = with_record(view(spark, folder, "lines")).where("_v IS NOT NULL OR trim(value) = ''")
    lines.select("file", "value").write.partitionBy("file").text(path)
    rows = R.read_strict(spark, path).withColumn("file", F.regexp_extract("path", "file=([^/]+)", 1))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_if("valid").alias("valid")
    )


@query("src_jsonl_permissive", f"""WITH {GOOD_LINES}
SELECT json_extract_string(value, '$.initial_prediction') AS initial_prediction, count(*) AS rows,
  count(json_extract_string(value, '$.item_id')) AS item_ids FROM good GROUP BY ALL""", ("lines",))
def _(spark, folder):
    path = scratch(spark, "permissive")
    view(spark, folder, "lines").where("trim(value) <> ''").select("value").write.text(path)
    rows = R.read_permissive(spark, path, "id string, item_id string, initial_prediction string")
    return rows.groupBy("initial_prediction").agg(
        F.count(F.lit(1)).alias("rows"), F.count("item_id").alias("item_ids")
    )


@query("src_jsonl_optional", "SELECT condition, count(*) AS rows FROM responses GROUP BY condition", ("responses",))
def _(spark, folder):
    path = scratch(spark, "optional")
    S.write_jsonl(view(spark, folder, "responses").select("id", "condition"), path)
    schema = "id string, condition string"
    rows = R.read_optional(spark, path, schema).unionByName(R.read_optional(spark, path + "-missing", schema))
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("rows"))


@query("src_json_or_jsonl", """
SELECT source, 2 * count(*) AS rows, 2 * sum(length(text))::BIGINT AS characters FROM documents GROUP BY source""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    arrays, lines = scratch(spark, "arrays"), scratch(spark, "lines")
    json_arrays(docs, arrays)
    S.write_jsonl(docs, lines)
    schema = "doc_id bigint, text string, source string"
    rows = R.read_json_or_jsonl(spark, arrays, schema).unionByName(R.read_json_or_jsonl(spark, lines, schema))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("text")).alias("characters")
    )


@query("src_json_array_map", """
SELECT id, question, correct AS correct_answer, distractor, 'one ' || id AS option_a FROM responses WHERE n = 1""",
       ("responses",))
def _(spark, folder):
    path = scratch(spark, "bank")
    items = view(spark, folder, "responses").where("n = 1").select(
        "id", "question", F.col("correct").alias("correct_answer"), "distractor",
        F.create_map(F.lit("A"), F.concat(F.lit("one "), "id"), F.lit("B"), F.lit("two")).alias("options"),
    )
    json_arrays(items, path)
    return R.read_item_bank(spark, path).select(
        "id", "question", "correct_answer", "distractor", F.col("options")["A"].alias("option_a")
    )


def archived_lines(spark, folder) -> str:
    """The response lines as members of tar archives, beside members that hold none and one that is cut off."""
    path = scratch(spark, "archive")
    lines = view(spark, folder, "lines").select(F.concat(F.lit("run/"), "file").alias("file"), "line_number", "value")
    other = lines.where("file LIKE '%exp1%'").select(F.regexp_replace("file", "exp1", "notes").alias("file"), "line_number", "value")
    cut = table(spark, folder, "nation").select(F.lit("zz/exp_cut.jsonl").alias("file"), F.col("n_nationkey").alias("line_number"), F.col("n_name").alias("value"))
    AR.write_archives(lines.unionByName(other).unionByName(cut), path, 12, F.col("file") == "zz/exp_cut.jsonl")
    return path


@query("src_archive_jsonl", """
SELECT file, count(*) AS rows, sum(length(value))::BIGINT AS characters, count(DISTINCT line_number) AS numbers,
  max(line_number)::BIGINT AS last_number, 0 AS faults
FROM (SELECT 'run/' || file AS file, value, row_number() OVER (PARTITION BY file ORDER BY line_number) AS line_number FROM lines)
GROUP BY file
UNION ALL SELECT 'zz/exp_cut.jsonl', count(*), sum(length(n_name))::BIGINT, count(*), max(n_nationkey)::BIGINT + 1, 1 FROM nation""", ("lines",))
def _(spark, folder):
    rows = AR.archive_lines(spark, archived_lines(spark, folder))
    return rows.groupBy("file").agg(
        F.count("value").alias("rows"), F.sum(F.char_length("value")).alias("characters"), F.count_distinct("line_number").alias("numbers"),
        F.max("line_number").alias("last_number"), F.count("fault").cast("int").alias("faults")
    )


def _main_rows(spark, folder) -> DataFrame:
    return view(spark, folder, "responses").select(
        "id", "dataset", "model", "condition", F.col("initial").alias("initial_prediction"),
        F.col("final").alias("attack_prediction"), F.col("correct").alias("correct_answer"), "distractor", "is_error",
        "question",
    )


# The manifest's cells are the customer segments of both datasets; each condition is a folder of JSONL files.
@query("src_manifest_grid", """
SELECT dataset, model, condition, count(*) AS rows, count(*) FILTER (WHERE final IS NOT NULL AND NOT is_error) AS valid
FROM responses GROUP BY ALL""", ("responses",))
def _(spark, folder):
    base = scratch(spark, "grid")
    rows = _main_rows(spark, folder)
    text = rows.select("dataset", "model", "condition", F.to_json(
        F.struct(*[c for c in rows.columns if c not in ("dataset", "model", "condition")]),
        {"ignoreNullFields": "false"}).alias("value"))
    # Few files per folder: a task holds rows of one or a few folders, and large folders are split over tasks.
    text.hint("rebalance", "dataset", "model", "condition").write.partitionBy("dataset", "model", "condition").text(base)
    # The segments are the table's fixed category list.
    segments = [r[0] for r in table(spark, folder, "customer").select("c_mktsegment").distinct().collect()]
    cells = [
        {"dataset": d, "model": m,
         "conditions": {c: f"dataset={d}/model={m}/condition={c}" for c in K.FOUR_PROTOCOLS}}
        for d in ("CSQA", "MMLU") for m in sorted(segments)
    ]
    content = {"comparisons": [["exp1", "exp2"], ["exp2", "exp3"], ["exp3", "exp4"]], "cells": cells}
    name = f"{base}/_manifest"
    for cell in cells:
        cell["conditions"] = {c: f"{base}/{p}" for c, p in cell["conditions"].items()}
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(name)
    grid = MF.read_grid(spark, MF.load_manifest(spark, data_files(spark, name)[0]))
    return grid.groupBy("dataset", "model", "condition").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid")
    )


@query("src_condition_args", """
SELECT condition, count(*) AS rows, count(*) FILTER (WHERE final IS NOT NULL AND NOT is_error) AS valid
FROM responses GROUP BY ALL""", ("responses",))
def _(spark, folder):
    run = scratch(spark, "run")
    rows = _main_rows(spark, folder).drop("dataset", "model")
    for name in ("exp1", "exp2", "exp4"):
        S.write_jsonl(rows.where(F.col("condition") == name), f"{run}/{name}.jsonl")
    S.write_jsonl(rows.where(F.col("condition") == "exp3"), f"{run}-extra")
    files = MF.condition_args(spark, run, K.FOUR_PROTOCOLS, [f"exp3={run}-extra"])
    read = MF.read_conditions(spark, files, "all", "all")
    return read.groupBy("condition").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"))


@query("src_result_csv", PAIRED_CONTRAST, ("responses",))
def _(spark, folder):
    path = scratch(spark, "comparisons")
    result = inference_rounded(I.paired_contrast(responses(spark, folder)))
    result.write.option("header", "true").csv(path)
    return R.read_result_csv(spark, path, result.schema)


@query("src_run_dirs", """
SELECT DISTINCT 'run_name=' || c_mktsegment || CASE WHEN c_nationkey % 5 = 4 THEN '' ELSE '_n' || (c_nationkey * 100) END
  AS run_name, CASE WHEN c_nationkey % 5 <> 4 THEN c_nationkey * 100 END AS n_samples FROM customer""")
def _(spark, folder):
    path = scratch(spark, "runs")
    nation = F.col("c_nationkey")
    size = F.when(nation % 5 == 4, "").otherwise(F.concat(F.lit("_n"), (nation * 100).cast("string")))
    rows = table(spark, folder, "customer").withColumn("run_name", F.concat("c_mktsegment", size))
    rows.select("run_name", "c_custkey").repartition("run_name").write.partitionBy("run_name").json(path)
    return R.find_runs(spark, path, "^run_name=")


_READ_BACK = "SELECT id, condition, initial, final, question FROM responses"


def _round_trip(spark, folder):
    return view(spark, folder, "responses").select("id", "condition", "initial", "final", "question")


@query("snk_jsonl", _READ_BACK, ("responses",))
def _(spark, folder):
    path, rows = scratch(spark, "jsonl"), _round_trip(spark, folder)
    S.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("snk_json", """
SELECT region.r_name AS name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(spark, folder):
    rows = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("nations"))
    path = scratch(spark, "json")
    S.write_json(rows.repartition(F.col("name")), path)
    # Pretty objects span lines: records end with a closing brace.
    return spark.read.option("lineSep", "}\n").text(path).select(
        F.from_json(F.concat("value", F.lit("}")), rows.schema).alias("r")
    ).select("r.*")


@query("snk_csv_union", """
SELECT id, condition, coalesce(final, '') AS final, '' AS final_prompt_token_count FROM responses
UNION ALL SELECT id, condition, coalesce(final, ''), coalesce(CAST(final_prompt_token_count AS VARCHAR), '')
FROM ablation""", ("responses", "ablation"))
def _(spark, folder):
    path = scratch(spark, "csv")
    S.write_csv_union(
        path, view(spark, folder, "responses").select("id", "condition", "final"),
        view(spark, folder, "ablation").select("id", "condition", "final_prompt_token_count", "final"),
    )
    back = spark.read.option("header", "true").csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("snk_projected_csv", "SELECT id, condition, initial FROM responses", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses").select(
        "id", "condition", "initial", F.col("question").alias("raw_initial_output"),
        F.array("final").alias("attack_step_outputs"),
    )
    path = scratch(spark, "projected")
    S.write_projected_csv(rows, path)
    return spark.read.option("header", "true").csv(path)


@query("snk_partitioned_conditions", """
SELECT condition, id, initial, final, question FROM responses""", ("responses",))
def _(spark, folder):
    path, rows = scratch(spark, "conditions"), _round_trip(spark, folder)
    S.write_conditions(rows.where("condition <> 'exp4'"), path)
    S.write_conditions(rows.where("condition = 'exp4'"), path, resume=True)
    return spark.read.schema(rows.schema).parquet(path)


@query("src_fingerprint", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", R.text_fingerprint(F.col("text")).alias("sha256"), F.md5("text").alias("md5")
    )


# A file per thousand documents, whose bytes SQL builds as well.
@query("src_file_fingerprint", """
SELECT doc_id // 1000 AS block, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length,
  md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS md5
FROM documents GROUP BY 1""")
def _(spark, folder):
    path = scratch(spark, "blocks")
    rows = table(spark, folder, "documents").select(
        F.expr("doc_id div 1000").alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "value").write.partitionBy("block").text(path)
    found = R.fingerprints(spark, path, "part-*")
    return found.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("bigint").alias("block"), "length", "md5")
