"""Paired contrasts with bootstrap intervals, exact McNemar tests and Holm adjustment.

All work over items ends in a histogram of code pairs per cell and contrast: a handful of integers whatever the
number of items. Metrics, tests and intervals run on that histogram only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens import constants as K
from pairlens.functions.statistics import LN10, mcnemar_log_p, resampled_mean_bounds
from pairlens.operators.metrics import ABLATION_METRICS, CONFORMITY_ONLY, PAIRED_METRICS, Metric
from pairlens.operators.pairing import CELL, contrast_conditions, outcome_code, pair_codes, wide_codes
from pairlens.session import settle

CONTRAST = ("contrast", "condition1", "condition2")


def contrast_counts(pairs: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per key and metric: paired n, successes on each side and discordant counts b and c.

    ``pairs`` holds ``code1`` and ``code2``; a null code stands for an item missing on that side. A row stands for as many
    items as the column ``weight`` says, else for one.
    """
    histogram = pairs.groupBy(*keys, "code1", "code2").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    # Per metric the two bits of both codes: 1 eligible, 3 eligible with outcome.
    cases = ", ".join(
        f"named_struct('metric_order', {i}, 'metric', '{m.name}', '_1', shiftright(code1, {2 * i}) & 3, "
        f"'_2', shiftright(code2, {2 * i}) & 3)"
        for i, m in enumerate(metrics)
    )
    exploded = histogram.selectExpr(*keys, "_n", f"inline(array({cases}))")

    def total(where: str) -> str:
        return f"cast(coalesce(sum(CASE WHEN {where} THEN _n END), 0) AS bigint)"

    return exploded.groupBy(*keys, "metric_order", "metric").agg(*[
        F.expr(total(where)).alias(name) for name, where in (
            ("paired_n", "_1 > 0 AND _2 > 0"), ("_hits1", "_1 = 3 AND _2 > 0"), ("_hits2", "_1 > 0 AND _2 = 3"),
            ("_b", "_1 = 3 AND _2 = 1"), ("_c", "_1 = 1 AND _2 = 3"),
        )
    ])


def rates_and_test(counts: DataFrame, second_minus_first: bool = True) -> DataFrame:
    """Rates, delta, discordant counts and the exact p-value; all null without a pair."""
    gap = "_c - _b" if second_minus_first else "_b - _c"
    definition = "condition2_minus_condition1" if second_minus_first else "condition1_minus_condition2"
    kept = [c for c in counts.columns if not c.startswith("_")]
    some = counts.withColumn("_log_p", F.when(F.col("paired_n") > 0, mcnemar_log_p("_b", "_c")))
    return some.selectExpr(
        *kept, f"'{definition}' AS delta_definition",
        "try_divide(cast(_hits1 AS double), paired_n) AS rate1", "try_divide(cast(_hits2 AS double), paired_n) AS rate2",
        f"try_divide(cast({gap} AS double), paired_n) AS delta",
        "CASE WHEN paired_n > 0 THEN _b END AS mcnemar_b", "CASE WHEN paired_n > 0 THEN _c END AS mcnemar_c",
        "exp(_log_p) AS p_raw", f"_log_p / {LN10} AS log10_p",
    )


def holm_adjust(
    df: DataFrame, family: Sequence[str] = ("metric",), p: str = "p_raw", order: Sequence[str] = (),
    member: Column | None = None, out: str = "p_holm",
) -> DataFrame:
    """Step-down adjusted p-values within each family; null p-values and non-members stay out.

    Runs on result rows: a family has one row per cell and contrast.
    """
    inside = F.col(p).isNotNull() if member is None else F.col(p).isNotNull() & member
    ranked = df.withColumn("_in", inside)
    group = Window.partitionBy(*family, "_in")
    ordered = group.orderBy(p, *order)
    factor = F.count(F.lit(1)).over(group) - F.row_number().over(ordered) + 1
    stepped = ranked.withColumn("_adj", F.least(F.lit(1.0), factor * F.col(p)))
    running = F.max("_adj").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(out, F.when(F.col("_in"), running)).drop("_in", "_adj")


def _seed(base: int, parts: Sequence[str]) -> int:
    digest = hashlib.sha256("\x1f".join(parts).encode()).digest()
    return base + int.from_bytes(digest[:4], "big")


def _with_bounds(df: DataFrame, counts: Sequence[str], bounds: Callable[[dict, list[int]], tuple | None]) -> DataFrame:
    """``ci_low`` and ``ci_high`` of each result row, from a function of the row and its counts."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                bounds(row, [0 if pd.isna(row[c]) else int(row[c]) for c in counts]) or (None, None)
                for row in batch.to_dict("records")
            ]
            for i, name in enumerate(("ci_low", "ci_high")):
                batch[name] = pd.Series([b[i] for b in found], index=batch.index, dtype="float64")
            yield batch

    return df.mapInPandas(run, schema)


def exact_ci(df: DataFrame, values: Sequence[int], counts: Sequence[str]) -> DataFrame:
    """Percentile bootstrap interval of the mean paired difference without draws, added as ``ci_low`` and ``ci_high``.

    It is what percentiles of ever more resamples tend to, and the same in every run. Null where all counts are 0.
    """
    return _with_bounds(df, counts, lambda _, held: resampled_mean_bounds(values, held))


def bootstrap_ci(
    df: DataFrame, values: Sequence[int], counts: Sequence[str], seed_keys: Sequence[str] = (),
    reps: int = K.BOOTSTRAP_REPS, seed: int = K.BOOTSTRAP_SEED, rule: str = "linear",
) -> DataFrame:
    """Percentile interval of the mean paired difference from drawn resamples, added as ``ci_low`` and ``ci_high``.

    Each item adds one of a few values, so a resample of n items is one multinomial draw over the value counts:
    the cost per result row is ``reps`` draws, independent of n. ``rule`` is ``linear`` or ``order`` (raw order
    statistics). Without ``seed_keys`` every row uses the same seed.
    """
    if reps < 100:
        raise ValueError("at least 100 bootstrap repetitions are needed")
    weights = np.asarray(values, dtype="float64")

    def drawn(row: dict, held: list[int]) -> tuple | None:
        n = sum(held)
        if n == 0:
            return None
        rng = np.random.default_rng(_seed(seed, [str(row[k]) for k in seed_keys]) if seed_keys else seed)
        means = np.sort(rng.multinomial(n, np.array(held) / n, size=reps) @ weights / n)
        if rule == "order":
            return float(means[int(0.025 * reps)]), float(means[min(reps - 1, int(0.975 * reps))])
        low, high = np.quantile(means, [0.025, 0.975])
        return float(low), float(high)

    return _with_bounds(df, counts, drawn)


def add_paired_ci(
    results: DataFrame, seed_keys: Sequence[str] = (), second_minus_first: bool = True,
    reps: int | None = None, seed: int = K.BOOTSTRAP_SEED, rule: str = "linear",
) -> DataFrame:
    """Interval of a contrast row from its b, c and n: exact, or from ``reps`` drawn resamples where these are asked for."""
    sign = 1 if second_minus_first else -1
    rest = results.withColumn("_same", F.col("paired_n") - F.col("mcnemar_b") - F.col("mcnemar_c"))
    values, counts = (-sign, sign, 0), ("mcnemar_b", "mcnemar_c", "_same")
    if reps is None:
        return exact_ci(rest, values, counts).drop("_same")
    return bootstrap_ci(rest, values, counts, seed_keys, reps, seed, rule).drop("_same")


def paired_contrast(
    df: DataFrame, contrasts: Sequence[tuple[str, str]] = K.DEFAULT_CONTRASTS,
    metrics: Sequence[Metric] = PAIRED_METRICS, keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition", second_minus_first: bool = True,
) -> DataFrame:
    """One row per cell, contrast and metric with Holm adjustment within each metric."""
    pairs = pair_codes(df, contrasts, metrics, keys, item, condition)
    counts = contrast_counts(pairs, metrics, [*keys, *CONTRAST])
    tested = rates_and_test(counts, second_minus_first)
    return holm_adjust(tested, ("metric",), order=[*keys, "contrast"])


def ablation_contrast(
    df: DataFrame, comparisons: Sequence[tuple] = K.ABLATION_COMPARISONS,
    metrics: Sequence[Metric] = ABLATION_METRICS, keys: Sequence[str] = CELL,
) -> DataFrame:
    """Named comparisons (first minus second), adjusted over the flagged ones per cell and metric.

    A comparison without a pair gives no row.
    """
    contrasts = [(a, b) for _, a, b, _ in comparisons]
    pairs = pair_codes(df, contrasts, metrics, keys)
    counts = contrast_counts(pairs, metrics, [*keys, *CONTRAST]).where("paired_n > 0")
    label = F.element_at(F.array(*[F.lit(c[0]) for c in comparisons]), F.col("contrast") + 1)
    adjust = F.element_at(F.array(*[F.lit(c[3]) for c in comparisons]), F.col("contrast") + 1)
    tested = rates_and_test(counts, second_minus_first=False).withColumns({"comparison": label, "adjust": adjust})
    return holm_adjust(tested, [*keys, "metric"], order=["contrast"], member=F.col("adjust"))


def paired_bootstrap_draws(
    pairs: DataFrame, reps: int, keys: Sequence[str], item: str = "id", seed: str = "0"
) -> DataFrame:
    """Resampled mean differences from hash draws, the same in every SQL engine.

    Each paired row is one draw per repetition: an index below n from the md5 of (seed, repetition, item), where
    indexes below b count -1 and the next c count +1. The draws stay spread over the pair rows.
    """
    sizes = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outcome1") & ~F.col("outcome2")).alias("b"),
        F.count_if(~F.col("outcome1") & F.col("outcome2")).alias("c"),
    )
    drawn = pairs.select(*keys, item).join(settle(sizes, "sizes"), list(keys)).withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))
    )
    text = F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col(item))
    index = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("n")
    value = F.when(index < F.col("b"), -1).when(index < F.col("b") + F.col("c"), 1).otherwise(0)
    return drawn.withColumn("_v", value).groupBy(*keys, "rep").agg(
        F.max("n").alias("n"), (F.sum("_v").cast("double") / F.max("n")).alias("difference")
    )


def model_contrast(
    df: DataFrame, small: str, big: str, condition_order: Sequence[str],
    metrics: Sequence[Metric] = CONFORMITY_ONLY, keys: Sequence[str] = ("dataset",),
) -> DataFrame:
    """Larger against smaller model at each condition, on items eligible in all model-condition cells."""
    wide = _all_cells(df, small, big, condition_order, metrics[0], keys)
    k = len(condition_order)
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("contrast"), F.lit(c).alias("condition"),
            F.col(f"c{i}").alias("code1"), F.col(f"c{k + i}").alias("code2"),
        )
        for i, c in enumerate(condition_order)
    ])
    exploded = wide.select(*keys, F.inline(pairs))
    counts = contrast_counts(exploded, metrics, [*keys, "contrast", "condition"])
    return holm_adjust(rates_and_test(counts), [*keys, "metric"], order=["contrast"])


def _all_cells(
    df: DataFrame, small: str, big: str, condition_order: Sequence[str], metric: Metric, keys: Sequence[str]
) -> DataFrame:
    """Wide codes over model x condition, limited to items eligible everywhere."""
    arm = F.concat_ws("\x1f", F.col("model"), F.col("condition"))
    arms = [f"{m}\x1f{c}" for m in (small, big) for c in condition_order]
    wide = wide_codes(df.withColumn("_arm", arm), arms, outcome_code((metric,)), keys, "id", "_arm")
    eligible = F.lit(True)
    for i in range(len(arms)):
        eligible = eligible & (F.coalesce(F.col(f"c{i}"), F.lit(0)) > 0)
    return wide.where(eligible)


def interaction_contrast(
    df: DataFrame, small: str, big: str, condition_order: Sequence[str], steps: Sequence[tuple[int, int]],
    metric: Metric = CONFORMITY_ONLY[0], keys: Sequence[str] = ("dataset",),
) -> DataFrame:
    """Difference in differences between two conditions and two models, with the histogram of item values.

    Per item the value is [big(k2) - big(k1)] - [small(k2) - small(k1)], an integer from -2 to 2; the counts
    ``v_m2 .. v_p2`` feed ``interaction_ci``.
    """
    wide = _all_cells(df, small, big, condition_order, metric, keys)
    k = len(condition_order)

    def hit(i: int) -> Column:
        return (F.col(f"c{i}") == 3).cast("int")

    values = F.array(*[
        F.struct(
            F.lit(i).alias("contrast"), F.lit(condition_order[a]).alias("condition1"),
            F.lit(condition_order[b]).alias("condition2"),
            ((hit(k + b) - hit(k + a)) - (hit(b) - hit(a))).alias("_v"),
        )
        for i, (a, b) in enumerate(steps)
    ])
    names = {-2: "v_m2", -1: "v_m1", 0: "v_0", 1: "v_p1", 2: "v_p2"}
    return wide.select(*keys, F.inline(values)).groupBy(*keys, *CONTRAST).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_v").alias("interaction"),
        *[F.count_if(F.col("_v") == v).alias(name) for v, name in names.items()],
    )


def interaction_ci(points: DataFrame, reps: int | None = None, **options) -> DataFrame:
    """Interval of the interaction from its value counts: exact, or from ``reps`` drawn resamples."""
    counts = ("v_m2", "v_m1", "v_0", "v_p1", "v_p2")
    if reps is None:
        return exact_ci(points, (-2, -1, 0, 1, 2), counts)
    return bootstrap_ci(points, (-2, -1, 0, 1, 2), counts, reps=reps, **options)


def token_pairs(
    df: DataFrame, contrasts: Sequence[tuple[str, str]], keys: Sequence[str] = CELL,
    tokens: str = "final_prompt_token_count",
) -> DataFrame:
    """One row per item present on both sides of a contrast, with both prompt token counts."""
    conditions = contrast_conditions(contrasts)
    known = wide_codes(df, conditions, F.coalesce(F.col(tokens).cast("int"), F.lit(-1)), keys)
    at = {c: F.col(f"c{i}") for i, c in enumerate(conditions)}
    listed = F.array(*[
        F.struct(
            F.lit(a).alias("condition1"), F.lit(b).alias("condition2"),
            at[a].alias("tokens1"), at[b].alias("tokens2"),
        )
        for a, b in contrasts
    ])
    pairs = known.select(*keys, "id", F.inline(listed)).where("tokens1 IS NOT NULL AND tokens2 IS NOT NULL")
    covered = (F.col("tokens1") >= 0) & (F.col("tokens2") >= 0)
    return pairs.withColumns(
        {"covered": covered, "difference": F.when(covered, F.col("tokens1") - F.col("tokens2"))}
    )


def token_pair_audit(pairs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Common, covered and exactly matching items per contrast."""
    return pairs.groupBy(*keys, "condition1", "condition2").agg(
        F.count(F.lit(1)).alias("common_n"),
        F.count_if("covered").alias("covered_n"),
        F.count_if(F.col("difference") == 0).alias("exact_match_n"),
    )


def token_pair_histogram(pairs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return (
        pairs.where("covered").groupBy(*keys, "condition1", "condition2", "difference")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def exact_token_contrast(
    df: DataFrame, comparisons: Sequence[tuple[str, str, str]] = K.EXACT_TOKEN_COMPARISONS,
    metrics: Sequence[Metric] = ABLATION_METRICS, keys: Sequence[str] = CELL,
    tokens: str = "final_prompt_token_count",
) -> DataFrame:
    """Ablation contrast on items whose two prompts have the same token count; not adjusted.

    The token count rides above the outcome bits of the item code, so the restriction costs no join.
    """
    contrasts = [(a, b) for _, a, b in comparisons]
    width = 2 * len(metrics)
    shifted = F.coalesce(F.col(tokens).cast("int") + 1, F.lit(0)) * F.lit(1 << width) + outcome_code(metrics)
    conditions = contrast_conditions(contrasts)
    wide = wide_codes(df, conditions, shifted, keys)
    at = {c: F.col(f"c{i}") for i, c in enumerate(conditions)}
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("contrast"), F.lit(a).alias("condition1"), F.lit(b).alias("condition2"),
            at[a].alias("code1"), at[b].alias("code2"),
        )
        for i, (a, b) in enumerate(contrasts)
    ])
    mask = F.lit((1 << width) - 1)
    count1, count2 = F.shiftright("code1", width), F.shiftright("code2", width)
    same = wide.select(*keys, "id", F.inline(pairs)).where((count1 > 0) & (count1 == count2)).withColumns(
        {"code1": F.col("code1").bitwiseAND(mask), "code2": F.col("code2").bitwiseAND(mask)}
    )
    counts = contrast_counts(same, metrics, [*keys, *CONTRAST]).where("paired_n > 0")
    label = F.element_at(F.array(*[F.lit(c[0]) for c in comparisons]), F.col("contrast") + 1)
    return rates_and_test(counts, second_minus_first=False).withColumns({
        "comparison": label, "adjust": F.lit(False),
        "analysis_subset": F.lit("exact_final_prompt_token_match"), "p_holm": F.lit(None).cast("double"),
    })
