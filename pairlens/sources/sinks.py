"""JSON, CSV and per-condition outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.pairing import union_runs


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are written, other scripts stay readable."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pretty-printed JSON objects."""
    options = {"ignoreNullFields": "false", "pretty": "true"}
    df.select(F.to_json(F.struct("*"), options).alias("value")).write.mode(mode).text(path)


def write_csv_union(path: str, *runs: DataFrame, mode: str = "errorifexists") -> None:
    """CSV over the union of columns in first-seen order; missing values are empty."""
    union = union_runs(*runs)
    union.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in union.columns]).write.mode(
        mode
    ).option("header", "true").option("emptyValue", "").csv(path)


def projected(df: DataFrame) -> DataFrame:
    """Without raw texts and step outputs."""
    return df.drop(*[c for c in df.columns if c.startswith("raw_") or c in ("attack_step_outputs", "steps")])


def write_projected_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv_union(path, projected(df), mode=mode)


def write_conditions(
    df: DataFrame, path: str, keys: Sequence[str] = ("condition",), resume: bool = False,
) -> None:
    """One folder per condition. Without ``resume`` an existing output is an error; with it rows are appended."""
    df.write.partitionBy(*keys).mode("append" if resume else "errorifexists").parquet(path)
