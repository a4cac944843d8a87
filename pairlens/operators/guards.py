"""Fail-closed checks that live inside the plan, so that a lazy result cannot be read without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(value: Column, holds: Column, text: str | Column, kind: str = "string") -> Column:
    """``value`` where the condition holds, else the query fails with ``text``."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(holds, value).otherwise(F.raise_error(text).cast(kind))


def require_rows(df: DataFrame, key: str, holds: Column, text: str | Column) -> DataFrame:
    """Guard every row through one of its key columns."""
    kind = df.schema[key].dataType.simpleString()
    return df.withColumn(key, require(F.col(key), holds, text, kind))


def row_count_guard(df: DataFrame, expected: int, what: str = "table") -> DataFrame:
    """One row with the row count; fails unless it is the expected one."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    text = F.concat(F.lit(f"{what}: expected {expected} rows, got "), F.col("rows").cast("string"))
    return counted.select(require(F.col("rows"), F.col("rows") == expected, text, "bigint").alias("rows"))
