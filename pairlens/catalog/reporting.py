"""Whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog import inference as CI
from pairlens.catalog import rates as CR
from pairlens.catalog import sampling as CS
from pairlens.catalog.common import NORMAL, ablation, responses, rounded
from pairlens.catalog.normalizing import INTEGRITY_MODES, INTEGRITY_PROFILE, QUALITY, _FACTS, _blank_sql
from pairlens.catalog.reading import archived_lines
from pairlens.catalog.registry import query
from pairlens.catalog.texts import FORMS, RAW_TEXTS, raw_texts
from pairlens.catalog.views import view
from pairlens.operators import normalize as N
from pairlens.plans import reports as R
from pairlens.sources import archives as AR


@query("paired_protocol", f"""WITH {CI.PAIRED}, {CI.tested(CI._KEYS)}, {CI.holm('metric', 'dataset, model, contrast')},
{CI.interval('tested', 'paired_n', CI.BC)}
SELECT {CI._KEYS}, paired_n, rate1, rate2, delta, delta_definition, mcnemar_b, mcnemar_c, {CI.OUTPUT}, ci_low, ci_high
FROM adjusted {CI.WITH_CI}""", ("responses",))
def _(spark, folder):
    return CI.inference_rounded(R.paired_protocol(responses(spark, folder))["comparisons"])


@query("repeated_subset", f"""WITH {NORMAL}, {CI.SCORED}, {CS.SAMPLED}, {CS._REP_CONDITIONS}
SELECT dataset, model, condition, metric, count(*) AS repetitions, round(avg(value) + {CI.NUDGE}, 6) AS mean,
  round(coalesce(stddev_samp(value), 0) + {CI.NUDGE}, 6) AS sd, round(quantile_cont(value, 0.025) + {CI.NUDGE}, 6) AS empirical_low,
  round(quantile_cont(value, 0.975) + {CI.NUDGE}, 6) AS empirical_high, round(avg(denominator_n) + {CI.NUDGE}, 6) AS mean_denominator_n
FROM conditions GROUP BY ALL""", ("responses",))
def _(spark, folder):
    # The derived cells differ in their items, so the frame is taken per condition only: one model per item.
    rows = responses(spark, folder)
    found = R.repeated_subset(rows, CS.SIZE, CS.REPS, arms=("condition",))
    # means of thirty values often end on a rounding tie: both sides add NUDGE first
    table = found["condition_aggregate"]
    return rounded(table.withColumns({c: F.col(c) + CI.NUDGE for c, t in table.dtypes if t == "double"}))


@query("four_protocol", CR.COMMON_SUMMARY, ("responses",))
def _(spark, folder):
    return rounded(R.four_protocol(responses(spark, folder))["rows"])


@query("tercile_report", CS.TERCILES, ("responses", "score_rows"))
def _(spark, folder):
    found = R.tercile_report(responses(spark, folder), view(spark, folder, "score_rows"))["thresholds"]
    return rounded(found, 9)


@query("tercile_report_metrics", CS.STRATUM_METRICS, ("responses", "score_rows"))
def _(spark, folder):
    return rounded(R.tercile_report(responses(spark, folder), view(spark, folder, "score_rows"))["condition_metrics"], 9)


_REPORT_KEYS = "dataset, model, comparison, condition1, condition2, metric"
_COLUMNS = f"{_REPORT_KEYS}, analysis_subset, paired_n, rate1, rate2, delta, p_raw, p_holm, ci_low, ci_high"


@query("ablation_report", f"""WITH main AS ({CI.ABLATION_CONTRAST}),
exact AS (WITH {CI.ablation_paired(CI._ABLATION_SCORED, CI._EXACT, 'AND a.final_prompt_token_count = b.final_prompt_token_count')},
  {CI.tested(CI._AKEYS, 'paired', *CI._FIRST)} SELECT *, round(exp(log_p) + {CI.NUDGE}, 9) AS p_raw FROM tested),
both_sets AS (
  SELECT {_REPORT_KEYS}, 'all_common_valid' AS analysis_subset, paired_n, rate1, rate2, delta, p_raw, p_holm, mcnemar_b, mcnemar_c FROM main
  UNION ALL SELECT {_REPORT_KEYS}, 'exact_final_prompt_token_match', paired_n, rate1, rate2, delta, p_raw, NULL, mcnemar_b, mcnemar_c FROM exact),
{CI.interval('both_sets', 'paired_n', CI.CB)}
SELECT {_COLUMNS} FROM both_sets {CI.WITH_CI}""", ("ablation",))
def _(spark, folder):
    found = R.ablation_report(ablation(spark, folder))["comparisons"]
    return CI.inference_rounded(found.select(*_COLUMNS.split(", ")))


@query("ablation_report_summaries", CR.ABLATION_SUMMARY, ("ablation",))
def _(spark, folder):
    return rounded(R.ablation_report(ablation(spark, folder))["summaries"])


@query("label_attention_report", f"""WITH d AS ({CR.LABEL_DIFFERENCES}),
s AS ({CR.LABEL_SUMMARY}),
g AS (SELECT max(distractor_n::DOUBLE / rows) FILTER (WHERE condition = 'mixed_label_conflict')
  - max(distractor_n::DOUBLE / rows) FILTER (WHERE condition = 'labelled_5_wrong') AS gap FROM s)
SELECT CASE WHEN abs(distractor_rate_diff) < 0.02 THEN 'content' WHEN distractor_rate_diff > 0 THEN 'label amplifies'
    ELSE 'no amplification' END AS label_effect,
  CASE WHEN gap < -0.02 THEN 'conflict lowers' WHEN abs(gap) < 0.02 THEN 'little use' ELSE 'conflict raises' END
    AS conflict_effect,
  CASE WHEN logprob_sparse THEN 'sparse' WHEN margin_mixed_minus_labelled < 0 THEN 'margin falls'
    ELSE 'margin does not fall' END AS logprob_effect,
  CASE WHEN no_valid_answers THEN 'failed run' ELSE 'usable' END AS run_state
FROM d, g""", ("label_rows",))
def _(spark, folder):
    return R.label_attention_report(CR.label_answers(spark, folder))["conclusions"]


@query("label_attention_quality", QUALITY, ("label_rows",))
def _(spark, folder):
    return rounded(R.label_attention_report(CR.label_answers(spark, folder))["quality"])


@query("answer_extraction", f"""WITH {RAW_TEXTS}
SELECT model, condition, method AS parse_method, count(*) AS rows, count(*) AS parsed,
  count(*) FILTER (WHERE k % {len(FORMS)} = 0) AS with_confidence
FROM raw_texts GROUP BY ALL""", ("responses",))
def _(spark, folder):
    rows = raw_texts(spark, folder)
    return R.answer_extraction(rows, "text", ("model", "condition"), "options")["profile"]


@query("semantic_profile_job", f"""WITH {CS.NEAR_FAR},
joined AS (SELECT m.*, grp, exclusion_score FROM mechanisms m JOIN chosen c ON c.id = m.id)
SELECT input_mode, grp AS "group", count(*) AS total,
  round(avg((final IS NOT DISTINCT FROM distractor)::DOUBLE), 6) AS conformity_rate,
  round(avg((initial = correct AND final IS NOT DISTINCT FROM distractor)::DOUBLE), 6) AS wrong_conformity_rate,
  round(avg((final IS DISTINCT FROM initial)::DOUBLE), 6) AS change_rate,
  round(avg((initial = correct)::DOUBLE), 6) AS clean_accuracy,
  round(avg((final IS NOT DISTINCT FROM correct)::DOUBLE), 6) AS attack_accuracy,
  round(avg(exclusion_score), 6) AS avg_exclusion_score
FROM joined GROUP BY ALL""", ("textpairs", "mechanisms"))
def _(spark, folder):
    outcomes = N.derive_flags(view(spark, folder, "mechanisms"))
    found = R.semantic_profile_job(view(spark, folder, "textpairs"), outcomes, 50, "jaccard", ordinal="k")
    return rounded(found["summary"])


@query("evaluate_run", CR.MODE_DELTAS, ("attacks",))
def _(spark, folder):
    return rounded(R.evaluate_run(view(spark, folder, "attacks"))["attack_deltas"])


@query("evaluate_run_defense", f"""WITH by_mode AS ({CR.DEFENSE_METRICS.replace('round(', '(').replace(', 6)', ')')})
SELECT {", ".join(f"round(s.{r} - o.{r}, 6) AS {r}_delta_sequential_minus_single"
                  for r in ("defense_accuracy", "defense_recovery_rate"))}
FROM by_mode s, by_mode o WHERE s.input_mode = 'sequential_input' AND o.input_mode = 'single_input'""", ("attacks",))
def _(spark, folder):
    return rounded(R.evaluate_run(view(spark, folder, "attacks"))["defense_deltas"])


@query("integrity_report", f"""WITH {_FACTS}
SELECT file, line_number, 'bad' AS kind FROM facts WHERE NOT ok AND NOT blank
UNION ALL SELECT file, line_number, 'ineffective' FROM facts
WHERE ok AND (err OR {_blank_sql('fin_alias')})""", ("lines",))
def _(spark, folder):
    lines = view(spark, folder, "lines").select("file", "line_number", "value")
    found = R.integrity_report(lines)
    bad = found["bad_lines"].select("file", "line_number", F.lit("bad").alias("kind"))
    return bad.unionByName(found["ineffective"].select("file", "line_number", F.lit("ineffective").alias("kind")))


def _archive_report(spark, folder) -> dict:
    """The report over archives; members are told apart without their folder."""
    rows = AR.archive_lines(spark, archived_lines(spark, folder)).where("file LIKE 'run/%'")
    return R.integrity_report(rows.select(F.regexp_replace("file", "^run/", "").alias("file"), "line_number", "value"))


@query("integrity_report_profile", INTEGRITY_PROFILE, ("lines",))
def _(spark, folder):
    return _archive_report(spark, folder)["profile"]


@query("integrity_report_modes", INTEGRITY_MODES, ("lines",))
def _(spark, folder):
    return _archive_report(spark, folder)["modes"]


@query("forest_source", f"""WITH main AS ({CI.PAIRED_CONTRAST})
SELECT model || ' / ' || dataset AS label, paired_n, round(delta * 100, 4) AS delta_pp, round(p_holm, 6) AS p_holm
FROM main WHERE condition1 = 'exp2' AND condition2 = 'exp3' AND metric = 'conformity_rate'""", ("responses",))
def _(spark, folder):
    comparisons = CI.inference_rounded(CI.I.paired_contrast(responses(spark, folder)))
    found = R.forest_source(comparisons)
    return found.select(
        "label", "paired_n", F.round("delta_pp", 4).alias("delta_pp"), F.round("p_holm", 6).alias("p_holm")
    )


