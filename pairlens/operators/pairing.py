"""Bring the conditions of one item together: pairs, k-way valid sets, frames and set sizes.

Rows of one item are reduced to one value per condition with ``max(CASE ...)``. That aggregate combines before
the shuffle and holds a fixed number of integers per item, so neither repeated rows nor one very frequent item can
overload a task, and every contrast of a table needs the same single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.guards import require
from pairlens.operators.metrics import PAIRED_METRICS, Metric
from pairlens.session import settle

CELL = ("dataset", "model")


def outcome_code(metrics: Sequence[Metric], valid: str = "valid") -> Column:
    """Integer with two bits per metric: bit 2i says eligible and valid, bit 2i+1 says the outcome holds."""
    cases = [
        f"CASE WHEN coalesce(({valid}) AND ({m.eligible}), false) THEN "
        f"CASE WHEN coalesce({m.outcome}, false) THEN {3 << 2 * i} ELSE {1 << 2 * i} END ELSE 0 END"
        for i, m in enumerate(metrics)
    ]
    return F.expr(" + ".join(cases))


def wide_codes(
    df: DataFrame, conditions: Sequence[str], code: Column, keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition", check_duplicates: bool = True,
) -> DataFrame:
    """One row per item with the code of each condition (``c0``, ``c1``, ...); null where the item is absent.

    A repeated item within a condition fails the query: a pair would otherwise be ambiguous.
    """
    coded = df.where(F.col(condition).isin(*conditions)).select(
        *keys, item, F.col(condition).alias("_cond"), code.alias("_code")
    )
    aggs = [F.max(F.when(F.col("_cond") == c, F.col("_code"))).alias(f"c{i}") for i, c in enumerate(conditions)]
    if not check_duplicates:
        return coded.groupBy(*keys, item).agg(*aggs)
    counts = [F.count_if(F.col("_cond") == c).alias(f"_n{i}") for i, c in enumerate(conditions)]
    wide = coded.groupBy(*keys, item).agg(*aggs, *counts)
    once = F.greatest(*[F.col(f"_n{i}") for i in range(len(conditions))], F.lit(0)) <= 1
    text = F.concat(F.lit("duplicate item id "), F.col(item).cast("string"))
    return wide.select(
        *keys, item, *[require(F.col(f"c{i}"), once, text, "int").alias(f"c{i}") for i in range(len(conditions))]
    )


def contrast_conditions(contrasts: Sequence[tuple]) -> list[str]:
    """Distinct conditions of a contrast list, in order; the last two entries of a contrast are conditions."""
    return list(dict.fromkeys(c for pair in contrasts for c in pair))


def pair_codes(
    df: DataFrame, contrasts: Sequence[tuple[str, str]], metrics: Sequence[Metric] = PAIRED_METRICS,
    keys: Sequence[str] = CELL, item: str = "id", condition: str = "condition",
) -> DataFrame:
    """One row per item and contrast: ``contrast`` ordinal, both conditions and both outcome codes."""
    conditions = contrast_conditions(contrasts)
    wide = wide_codes(df, conditions, outcome_code(metrics), keys, item, condition)
    at = {c: f"c{i}" for i, c in enumerate(conditions)}
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("contrast"), F.lit(a).alias("condition1"), F.lit(b).alias("condition2"),
            F.col(at[a]).alias("code1"), F.col(at[b]).alias("code2"),
        )
        for i, (a, b) in enumerate(contrasts)
    ])
    return wide.select(*keys, item, F.inline(pairs))


def pair_join(
    df: DataFrame, contrasts: Sequence[tuple[str, str]], metric: Metric = PAIRED_METRICS[0],
    keys: Sequence[str] = CELL, item: str = "id", condition: str = "condition",
) -> DataFrame:
    """Items valid and eligible on both sides of each contrast, with the two outcomes."""
    pairs = pair_codes(df, contrasts, (metric,), keys, item, condition)
    both = F.col("code1").bitwiseAND(F.col("code2")).bitwiseAND(F.lit(1)) == 1
    return pairs.where(both).select(
        *keys, item, "condition1", "condition2",
        (F.col("code1") == 3).alias("outcome1"), (F.col("code2") == 3).alias("outcome2"),
    )


def common_valid_items(
    df: DataFrame, conditions: Sequence[str], keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition",
) -> DataFrame:
    """Items that are valid in every condition."""
    wide = wide_codes(df, conditions, F.col("valid").cast("int"), keys, item, condition)
    all_valid = F.lit(True)
    for i in range(len(conditions)):
        all_valid = all_valid & (F.coalesce(F.col(f"c{i}"), F.lit(0)) == 1)
    return wide.where(all_valid).select(*keys, item)


def common_valid_codes(
    df: DataFrame, conditions: Sequence[str], metrics: Sequence[Metric], keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition",
) -> DataFrame:
    """Histogram of outcome codes per condition over items valid in every condition: one shuffle of integers.

    The first metric must hold for every valid row, so that its eligible bit stands for validity.
    """
    wide = wide_codes(df, conditions, outcome_code(metrics), keys, item, condition)
    every = " AND ".join(f"c{i} & 1 = 1" for i in range(len(conditions)))
    cases = ", ".join(f"named_struct('{condition}', '{c}', 'code', c{i})" for i, c in enumerate(conditions))
    rows = wide.where(every).selectExpr(*keys, f"inline(array({cases}))")
    return rows.groupBy(*keys, condition, "code").agg(F.count(F.lit(1)).alias("rows"))


def frame_intersection(
    df: DataFrame, group: str = "dataset", arms: Sequence[str] = ("model", "condition"), item: str = "id",
) -> DataFrame:
    """Items attempted under every arm (model and condition) of their group.

    Arms are numbered in their group, which is a small table; an item's arms are then bits of one or more integers, gathered
    by a single combining aggregate.
    """
    spot = Window.partitionBy(group).orderBy(*arms)
    listed = df.select(group, *arms).distinct().withColumn("_arm", F.row_number().over(spot) - 1)
    numbered = settle(listed.withColumn("_wanted", F.max("_arm").over(Window.partitionBy(group)) + 1), "arms")
    words = (numbered.agg(F.coalesce(F.max("_wanted"), F.lit(1))).first()[0] + 61) // 62
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (group, *arms)])
    rows = df.select(group, item, *arms).alias("l").join(numbered.alias("r"), same).select(f"l.{group}", item, "_arm", "_wanted")
    bits = [F.bit_or(F.when(F.expr(f"_arm div 62 = {w}"), F.expr("shiftleft(1L, _arm % 62)")).otherwise(F.lit(0).cast("bigint"))).alias(f"_b{w}") for w in range(words)]
    per_item = rows.groupBy(group, item).agg(F.max("_wanted").alias("_wanted"), *bits)
    held = reduce(Column.__add__, [F.bit_count(f"_b{w}") for w in range(words)])
    return per_item.where(held == F.col("_wanted")).select(group, item)


def set_sizes(
    df: DataFrame, contrasts: Sequence[tuple[str, str]], keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition",
) -> DataFrame:
    """Per contrast: items of each side, common, only left, only right."""
    conditions = contrast_conditions(contrasts)
    wide = wide_codes(df, conditions, F.lit(1), keys, item, condition)
    at = {c: F.col(f"c{i}").isNotNull() for i, c in enumerate(conditions)}
    pairs = F.array(*[
        F.struct(F.lit(a).alias("condition1"), F.lit(b).alias("condition2"), at[a].alias("l"), at[b].alias("r"))
        for a, b in contrasts
    ])
    left, right = F.col("l"), F.col("r")
    return wide.select(*keys, F.inline(pairs)).groupBy(*keys, "condition1", "condition2").agg(
        F.count_if(left).alias("condition1_n"),
        F.count_if(right).alias("condition2_n"),
        F.count_if(left & right).alias("common_id_n"),
        F.count_if(left & ~right).alias("condition1_only_n"),
        F.count_if(right & ~left).alias("condition2_only_n"),
    )


def allowed_semi(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in an allowed set."""
    return df.join(allowed, list(keys), "left_semi")


def contrast_grid(
    df: DataFrame, contrasts: Sequence[tuple], keys: Sequence[str] = CELL, condition: str = "condition",
) -> DataFrame:
    """Named contrasts (label, first, second, adjust) whose two conditions occur in the cell."""
    present = df.groupBy(*keys).agg(
        *[F.max(F.col(condition) == c).alias(f"_p{i}") for i, c in enumerate(_pool(contrasts))]
    )
    at = {c: F.col(f"_p{i}") for i, c in enumerate(_pool(contrasts))}
    listed = F.array(*[
        F.struct(
            F.lit(label).alias("comparison"), F.lit(a).alias("condition1"), F.lit(b).alias("condition2"),
            F.lit(adjust).alias("adjust"), (at[a] & at[b]).alias("_present"),
        )
        for label, a, b, adjust in contrasts
    ])
    return present.select(*keys, F.inline(listed)).where("_present").drop("_present")


def _pool(contrasts: Sequence[tuple]) -> list[str]:
    return list(dict.fromkeys(c for _, a, b, _ in contrasts for c in (a, b)))


def score_join(items: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of the items; an item without a score fails the query."""
    marked = items.join(scores.withColumn("_scored", F.lit(True)), list(keys), "left")
    key = keys[-1]
    kind = marked.schema[key].dataType.simpleString()
    text = F.concat(F.lit("item without score: "), F.col(key).cast("string"))
    return marked.withColumn(key, require(F.col(key), F.col("_scored").isNotNull(), text, kind)).drop("_scored")


def union_runs(*runs: DataFrame) -> DataFrame:
    """Rows of several runs; columns missing in one of them become null."""
    first, *rest = runs
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
