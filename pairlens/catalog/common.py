"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.catalog.views import view
from pairlens.operators.normalize import normalize_ablation, normalize_responses

# Validity of a derived response row, for the SQL side.
VALID = "(final IS NOT NULL AND initial IS NOT NULL AND correct <> distractor AND NOT is_error)"
NORMAL = f"normal AS (SELECT *, {VALID} AS valid FROM responses)"
# The ablation dialect, for the SQL side.
ABLATED = """ablated AS (
  SELECT *, coalesce(final_valid, final IN ('A','B','C','D','E'), false) AS valid,
    final IS NOT DISTINCT FROM correct AS is_correct, final IS NOT DISTINCT FROM distractor AS chose_distractor,
    CASE WHEN initial IS NOT NULL THEN final IS DISTINCT FROM initial END AS changed,
    CASE WHEN initial IS NOT NULL THEN initial = correct END AS initial_correct
  FROM ablation)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that both engines print the same digits."""
    return df.select(*[
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def responses(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_responses(view(spark, folder, "responses"))


def ablation(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_ablation(view(spark, folder, "ablation"))
