"""User-facing reports: each returns named DataFrames, evaluated when read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions import similarity as S
from pairlens.functions.labels import dataset_shorten, name_shorten
from pairlens.functions.parsing import with_answers
from pairlens.functions.statistics import two_proportion_z, two_sided_p
from pairlens.operators import audits as A
from pairlens.operators import inference as I
from pairlens.operators import metrics as M
from pairlens.operators import pairing as P
from pairlens.operators import sampling as R
from pairlens.operators import steps as ST
from pairlens.operators.guards import require
from pairlens.session import settle
from pairlens.sources.manifest import load_manifest, read_grid

SEED_KEYS = ("dataset", "model", "condition1", "condition2", "metric")


def paired_protocol(
    df: DataFrame, contrasts: Sequence[tuple[str, str]] = K.DEFAULT_CONTRASTS, reps: int | None = None,
    seed: int = K.BOOTSTRAP_SEED, strict: bool = True,
) -> dict[str, DataFrame]:
    """Summaries, pair audit, contrasts with interval, exact test and Holm adjustment.

    In strict form metadata drift fails the contrasts before any result is returned.
    """
    if strict:
        _require_no_drift(df, contrasts)
    contrast = I.paired_contrast(df, contrasts)
    return {
        "condition_summaries": M.condition_summary(df),
        "pair_audits": P.set_sizes(df, contrasts),
        "comparisons": I.add_paired_ci(contrast, SEED_KEYS, reps=reps, seed=seed),
    }


def _require_no_drift(df: DataFrame, contrasts: Sequence[tuple[str, str]]) -> None:
    """Items of both conditions of a contrast must agree in their audit fields; other conditions do not matter to it."""
    drift = A.contrast_drift(df, contrasts, _audit_fields(df)).first()
    if drift:
        raise ValueError(f"metadata drift between {drift.condition1} and {drift.condition2}: {drift}")


def _audit_fields(df: DataFrame) -> list[str]:
    return [f for f in K.AUDIT_FIELDS if f in df.columns]


def paired_protocol_files(spark: SparkSession, manifest_path: str, **options) -> dict[str, DataFrame]:
    """The same from a manifest. Lines are parsed once; every later step reads the columns."""
    manifest = load_manifest(spark, manifest_path)
    return paired_protocol(read_grid(spark, manifest), manifest.contrasts, **options)


def repeated_subset(
    df: DataFrame, size: int = K.SAMPLE_SIZE, repetitions: int = K.SAMPLE_REPETITIONS,
    seed_start: int = K.SAMPLE_SEED_START, contrasts: Sequence[tuple[str, str]] = K.DEFAULT_CONTRASTS,
    arms: Sequence[str] = ("model", "condition"),
) -> dict[str, DataFrame]:
    """Samples shared by all models and conditions, per-repetition rates and deltas, and their spread.

    Metadata drift between the conditions of a contrast fails the report.
    """
    _require_no_drift(df, contrasts)
    frame = P.frame_intersection(df, arms=arms)
    samples = settle(R.repeated_sample(frame, size, repetitions, seed_start), "samples")
    conditions = R.repeated_conditions(df, samples)
    deltas = R.repeated_deltas(df, samples, contrasts)
    return {
        "samples": samples,
        "condition_repetitions": conditions,
        "delta_repetitions": deltas,
        "condition_aggregate": R.repeated_aggregate(
            conditions, "value", "denominator_n", ("dataset", "model", "condition", "metric"), "mean_denominator_n"
        ),
        "delta_aggregate": R.repeated_aggregate(
            deltas, "delta", "paired_n", ("dataset", "model", "condition1", "condition2", "metric"), "mean_paired_n"
        ),
    }


def four_protocol(df: DataFrame, conditions: Sequence[str] = K.FOUR_PROTOCOLS) -> dict[str, DataFrame]:
    """Rates on items valid in every protocol; reading them fails where the initial accuracy differs across protocols.

    Where rows hold ``steps``, a last step that disagrees with the final answer fails the report, and so does metadata
    drift among the protocols.
    """
    rows = df.where(F.col("condition").isin(*conditions))
    if "steps" in df.columns:
        wrong = A.final_step_audit(rows.where("steps IS NOT NULL")).first()
        if wrong:
            raise ValueError(f"final step: {wrong.problem}")
    drift = A.metadata_drift(rows, _audit_fields(df), valid_only="valid" in df.columns).first()
    if drift:
        raise ValueError(f"metadata drift: {drift}")
    summary = M.common_valid_summary(P.common_valid_codes(df, conditions, M.COMMON_METRICS))
    agree = summary.groupBy("dataset", "model").agg(
        F.count_distinct("initial_accuracy").alias("initial_accuracies"), F.max("N").alias("common_valid_n")
    )
    text = F.concat(F.lit("initial accuracy differs in "), F.col("dataset"), F.lit(" / "), F.col("model"))
    checked = summary.join(agree.drop("common_valid_n"), ["dataset", "model"])
    rows = checked.withColumn("N", require(F.col("N"), F.col("initial_accuracies") <= 1, text, "bigint"))
    return {"rows": rows.select(*summary.columns), "cells": agree}


def tercile_report(
    df: DataFrame, scores: DataFrame, conditions: Sequence[str] = K.FOUR_PROTOCOLS,
    contrasts: Sequence[tuple[str, str]] = K.DEFAULT_CONTRASTS, reps: int | None = None,
) -> dict[str, DataFrame]:
    """Terciles of the target probability on common-valid items, rates and contrasts per stratum.

    Fails on a repeated score, on a score that breaks a rule (where its labels and probabilities are given), on one that
    names another gold or target than the response (where it names them), and on metadata drift between the conditions.
    """
    keys = [*P.CELL, "id"]
    repeated = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").first()
    if repeated:
        raise ValueError(f"repeated score: {repeated.asDict()}")
    if {"candidate_labels", "probabilities"} <= set(scores.columns):
        broken = A.score_validate(scores).first()
        if broken:
            raise ValueError(f"score {broken.problem}: {broken.id}")
    items = settle(R.stratum_items(df, conditions, _audit_fields(df)), "stratum-items")
    drift = items.where("fields <> ''").first()
    if drift:
        raise ValueError(f"metadata drift: {drift}")
    common = items.where(" AND ".join(f"c{k} & 1 = 1" for k in range(len(conditions))))
    if {"correct_answer", "target_distractor"} <= set(scores.columns):
        other = A.score_metadata_match(common.select(*keys, "correct", "distractor"), scores, keys).where("problem <> 'missing score'").first()
        if other:
            raise ValueError(f"score of another item: {other}")
    codes = [f"c{k}" for k in range(len(conditions))]
    scored = settle(P.score_join(common.select(*keys, *codes), scores.select(*keys, "target_probability"), keys), "scored")
    bounds = settle(R.tercile_thresholds(scored), "thresholds")
    histogram = settle(R.stratum_histogram(R.assign_stratum(scored, bounds), len(conditions)), "strata")
    sizes = histogram.groupBy(*P.CELL).agg(
        *[F.coalesce(F.sum(F.when(F.col("stratum") == s, F.col("items"))), F.lit(0)).alias(f"{s.lower()}_n") for s in ("Low", "Medium", "High")]
    )
    contrast = R.contrasts_of_histogram(histogram, list(conditions), contrasts)
    return {
        "thresholds": bounds.join(sizes, list(P.CELL)),
        "condition_metrics": R.metrics_of_histogram(histogram, list(conditions)),
        "contrasts": I.add_paired_ci(
            contrast, ("dataset", "model", "stratum", "condition1", "condition2"), reps=reps
        ),
    }


def ablation_report(df: DataFrame, reps: int | None = None) -> dict[str, DataFrame]:
    """Summaries, comparisons A-K and exact-token ones, token audit and step trajectories.

    Fails where the conditions of a cell hold different items, or an item's audit fields differ between conditions.
    """
    conditions = [r[0] for r in df.select("condition").distinct().collect()]  # a short list of names
    lone = A.id_sets_equal(df, conditions).first()
    if lone:
        raise ValueError(f"unaligned item: {lone}")
    drift = A.metadata_drift(df, _audit_fields(df)).first()
    if drift:
        raise ValueError(f"metadata drift: {drift}")
    main = I.ablation_contrast(df)
    exact = I.exact_token_contrast(df)
    comparisons = P.union_runs(main.withColumn("analysis_subset", F.lit("all_common_valid")), exact)
    token_contrasts = [(a, b) for _, a, b in K.EXACT_TOKEN_COMPARISONS]
    pairs = I.token_pairs(df, token_contrasts)
    return {
        "summaries": M.ablation_summary(df, ("dataset", "model", "condition")),
        "comparisons": I.add_paired_ci(comparisons, (), second_minus_first=False, reps=reps, rule="order"),
        "token_pair_audits": I.token_pair_audit(pairs),
        "token_pair_histogram": I.token_pair_histogram(pairs),
        "token_counts": token_audit_stats(df),
        **({"trajectories": ST.step_trajectory(df)} if "steps" in df.columns else {}),
    }


def token_audit_stats(
    df: DataFrame, keys: Sequence[str] = ("condition",), tokens: str = "final_prompt_token_count"
) -> DataFrame:
    """Rows with a count, minimum, exact median and maximum of the prompt tokens."""
    known = df.where(F.col(tokens).isNotNull())
    ends = known.groupBy(*keys).agg(F.min(tokens).alias("min"), F.max(tokens).alias("max"))
    return R.exact_percentiles(known, keys, tokens, {"median": 0.5}).join(ends, list(keys))


def label_attention_report(answers: DataFrame) -> dict[str, DataFrame]:
    """Quality, rates, differences, z-tests and the rule-based conclusions (margin of two points).

    ``answers`` come from ``label_answers``, over typed rows or over ``label_lines``. Conditions of the design without a
    row have counts of 0 and no rates.
    """
    summary = _with_absent(M.label_summary(answers, with_errors=True))
    return {
        "quality": A.quality_summary(answers),
        "conditions": summary.drop("error_n"),
        "differences": M.label_differences(summary),
        "tests": label_tests(summary),
        "conclusions": label_conclusions(summary),
    }


def _with_absent(summary: DataFrame) -> DataFrame:
    listed = summary.sparkSession.createDataFrame([(c,) for c in K.LABEL_CONDITIONS], "condition string")
    absent = listed.join(summary.select("condition"), "condition", "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in summary.schema.fields}
    zero = [F.lit(0 if k == "bigint" else None).cast(k).alias(c) for c, k in kinds.items() if c != "condition"]
    return summary.unionByName(absent.select("condition", *zero))


def label_tests(summary: DataFrame, with_p: bool = True) -> DataFrame:
    """z-tests of the distractor rate: labelled against unlabelled and against mixed."""
    labelled, unlabelled, mixed = K.LABEL_CONDITIONS

    def of(value: str, condition: str):
        return F.coalesce(F.max(F.when(F.col("condition") == condition, F.col(value))), F.lit(0))

    row = summary.agg(*[
        of(v, c).alias(f"{v}_{i}") for i, c in enumerate((labelled, unlabelled, mixed)) for v in ("distractor_n", "rows")
    ])
    tests = row.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("test"),
            two_proportion_z(
                F.col("distractor_n_0"), F.col("rows_0"), F.col(f"distractor_n_{i}"), F.col(f"rows_{i}")
            ).alias("z"),
        )
        for name, i in (("labelled_vs_unlabelled", 1), ("labelled_vs_mixed", 2))
    ])))
    return tests.withColumn("p", two_sided_p("z")) if with_p else tests


def label_conclusions(summary: DataFrame, margin: float = 0.02) -> DataFrame:
    """Conclusion codes of the label comparison, the conflict condition and the log-prob margin."""
    diffs = M.label_differences(summary)
    labelled, _, mixed = K.LABEL_CONDITIONS
    rates = summary.agg(
        F.max(F.when(F.col("condition") == labelled, F.col("distractor_rate"))).alias("_l"),
        F.max(F.when(F.col("condition") == mixed, F.col("distractor_rate"))).alias("_m"),
    )
    # One-row tables: both sides are a single aggregate.
    both = diffs.withColumn("_k", F.lit(0)).join(rates.withColumn("_k", F.lit(0)), "_k")
    d, gap = F.col("distractor_rate_diff"), F.col("_m") - F.col("_l")
    margin_gap = F.col("margin_mixed_minus_labelled")
    return both.select(
        F.when(d.isNull(), "none").when(F.abs(d) < margin, "content").when(d > 0, "label amplifies")
        .otherwise("no amplification").alias("label_effect"),
        F.when(gap.isNull(), "none").when(gap < -margin, "conflict lowers").when(F.abs(gap) < margin, "little use")
        .otherwise("conflict raises").alias("conflict_effect"),
        F.when(F.col("logprob_sparse") | margin_gap.isNull(), "sparse").when(margin_gap < 0, "margin falls")
        .otherwise("margin does not fall").alias("logprob_effect"),
        F.when(F.col("no_valid_answers"), "failed run").otherwise("usable").alias("run_state"),
    )


def answer_extraction(
    df: DataFrame, text: str, keys: Sequence[str], options: str | None = None, strict: bool = False
) -> dict[str, DataFrame]:
    """Parsed answers and the parse profile per key and method."""
    parsed = with_answers(df, text, options, strict)
    profile = parsed.groupBy(*keys, F.coalesce("parse_method", F.lit("none")).alias("parse_method")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("answer").isNotNull()).alias("parsed"),
        F.count("confidence").alias("with_confidence"),
    )
    return {"answers": parsed, "profile": profile}


def semantic_profile(pairs: DataFrame, backend: str = "lexical") -> DataFrame:
    """Similarity profile of text pairs (correct_text, target_text).

    ``lexical`` is the larger of token Jaccard and matching-block ratio, computed once per distinct pair;
    ``jaccard`` stays on built-in functions; ``embedding`` uses the arrays correct_vec and target_vec.
    """
    a, b = S.token_set(F.col("correct_text")), S.token_set(F.col("target_text"))
    if backend == "embedding":
        scaled = (S.cosine(F.col("correct_vec"), F.col("target_vec")) + 1.0) / 2.0
        return pairs.withColumns(S.scores(scaled, S.antonym_signal(a, b)))
    if backend == "jaccard":
        return pairs.withColumns(S.scores(S.jaccard(a, b), S.antonym_signal(a, b)))
    if backend != "lexical":
        raise ValueError(f"unknown similarity backend: {backend}")
    distinct = pairs.select("correct_text", "target_text").distinct()
    ratio = S.sequence_ratio(F.col("correct_text"), F.col("target_text"))
    scored = distinct.withColumn("_r", ratio).withColumns(
        S.scores(F.greatest(S.jaccard(a, b), F.col("_r")), S.antonym_signal(a, b))
    ).drop("_r")
    return pairs.join(scored, ["correct_text", "target_text"])


def semantic_profile_job(
    pairs: DataFrame, outcomes: DataFrame, size: int = 50, backend: str = "lexical", ordinal: str = "id"
) -> dict[str, DataFrame]:
    """Profiles, near and far groups, and the rates of both groups per input mode."""
    profiles = settle(semantic_profile(pairs, backend), "profiles")
    groups = R.near_far_groups(profiles, size, ordinal)
    rated = outcomes.join(groups.select("id", "group", "exclusion_score"), "id")
    summary = M.semantic_summary(rated)
    return {"profiles": profiles, "groups": groups, "summary": summary, "gaps": M.semantic_gaps(summary)}


def evaluate_run(df: DataFrame) -> dict[str, DataFrame]:
    """Clean, attack and defense metrics with the mode differences."""
    attack, defense = M.attack_metrics(df, ["input_mode"]), M.defense_metrics(df, ["input_mode"])
    return {
        "clean": M.clean_metrics(df),
        "attack": attack,
        "defense": defense,
        "attack_deltas": M.mode_deltas(
            attack,
            ("conformity_rate", "wrong_conformity_rate", "attack_accuracy", "beneficial_revision_rate"),
        ),
        "defense_deltas": M.mode_deltas(defense, ("defense_accuracy", "defense_recovery_rate")),
    }


def integrity_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Profile, modes, bad and ineffective lines of a set of files, from lines parsed once."""
    kept = [c for c in lines.columns if c != "value"]
    facts = A.integrity_facts(lines)
    return {
        "profile": A.profile_of_facts(facts),
        "modes": A.modes_of_facts(facts),
        "bad_lines": A.bad_of_facts(facts, kept),
        "ineffective": A.ineffective_of_facts(facts, kept),
    }


def forest_source(
    comparisons: DataFrame, first: str = "exp2", second: str = "exp3", rows: int | None = None,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Conformity rows of one contrast with display names (``names``: model to name) and percentage points."""
    kept = comparisons.where(
        (F.lower("condition1") == first) & (F.lower("condition2") == second) & (F.col("metric") == "conformity_rate")
    ).withColumns({
        "label": F.concat(name_shorten(F.col("model"), names), F.lit(" / "), dataset_shorten(F.col("dataset"))),
        "delta_pp": F.col("delta") * 100,
    })
    if "ci_low" in comparisons.columns:
        kept = kept.withColumns({"low_pp": F.col("ci_low") * 100, "high_pp": F.col("ci_high") * 100})
    if rows is not None and kept.count() != rows:
        raise ValueError(f"expected {rows} forest rows")
    return kept
