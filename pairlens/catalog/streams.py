"""Streaming jobs over logs written from the derived responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog.common import rounded
from pairlens.catalog.rates import CONDITION_SUMMARY
from pairlens.catalog.registry import query
from pairlens.catalog.views import view
from pairlens.session import scratch
from pairlens.sources.sinks import write_jsonl
from pairlens.streaming import responses as S


def _log(spark, folder, repeats: bool) -> str:
    """JSONL log in one folder; with ``repeats`` every third item is logged again later."""
    path = scratch(spark, "log")
    rows = view(spark, folder, "responses").select(
        "id", "dataset", "model", "condition", "correct", "distractor", "initial", "final", "is_error", "k",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k")).alias("ingested"),
    )
    write_jsonl(rows.drop("k"), path)
    if repeats:
        write_jsonl(rows.where("k % 3 = 0").drop("k"), path, mode="append")
    return path


@query("stream_responses", CONDITION_SUMMARY, ("responses",))
def _(spark, folder):
    out = scratch(spark, "running-summary")
    S.stream_responses(spark, _log(spark, folder, True), out, files_per_batch=10).awaitTermination()
    return rounded(spark.read.parquet(out))


@query("stream_autosave", """
SELECT 'rows' AS kind, condition, count(*) AS rows FROM responses WHERE NOT is_error GROUP BY ALL
UNION ALL SELECT 'errors', condition, count(*) FROM responses WHERE is_error GROUP BY ALL
UNION ALL SELECT 'summary', condition, count(*) FROM responses GROUP BY ALL""", ("responses",))
def _(spark, folder):
    out = scratch(spark, "autosave")
    S.stream_autosave(spark, _log(spark, folder, False), out, files_per_batch=4).awaitTermination()
    parts = [
        spark.read.parquet(f"{out}/{kind}").groupBy("condition").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(kind).alias("kind"), "condition", "rows") for kind in ("rows", "errors")
    ]
    summary = spark.read.parquet(f"{out}/summary").groupBy("condition").agg(F.sum("attempted_n").alias("rows"))
    return parts[0].unionByName(parts[1]).unionByName(summary.select(F.lit("summary").alias("kind"), "condition", "rows"))


@query("stream_autosave_summary", CONDITION_SUMMARY, ("responses",))
def _(spark, folder):
    out = scratch(spark, "autosave")
    S.stream_autosave(spark, _log(spark, folder, False), out, files_per_batch=4).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/summary"))
