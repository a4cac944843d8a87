"""Sampling, strata, percentiles and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.catalog import inference as CI
from pairlens.catalog.common import NORMAL, responses, rounded
from pairlens.catalog.inference import SCORED
from pairlens.catalog.rates import PROFILED, label_answers, text_profiles
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.functions import messages as M
from pairlens.operators import pairing as P
from pairlens.operators import sampling as R
from pairlens.plans import reports as RP
from pairlens.session import settle

SIZE, REPS = K.SAMPLE_SIZE, K.SAMPLE_REPETITIONS

SAMPLED = f"""samples AS (
  SELECT dataset, rep, seed, frame_n, id FROM (
    SELECT dataset, rep, 1000 + rep - 1 AS seed, id, count(*) OVER (PARTITION BY dataset, rep) AS frame_n,
      row_number() OVER (PARTITION BY dataset, rep ORDER BY md5((1000 + rep - 1) || '|' || dataset || '|' || id), id) AS r
    FROM (SELECT DISTINCT dataset, id FROM responses) f CROSS JOIN range(1, {REPS + 1}) q(rep))
  WHERE r <= {SIZE})"""


def sample(spark, folder, rows):
    frame = P.frame_intersection(rows, arms=("condition",))
    return settle(R.repeated_sample(frame, SIZE, REPS), "samples")


@query("repeated_sample", f"""WITH {SAMPLED}
SELECT dataset, rep::INT AS rep, seed::INT AS seed, frame_n, id FROM samples""", ("responses",))
def _(spark, folder):
    return sample(spark, folder, view(spark, folder, "responses"))


_REP_CONDITIONS = f"""conditions AS (
  SELECT s.dataset, s.model, s.condition, m.rep, s.metric, count(*) AS denominator_n, avg(s.outcome::DOUBLE) AS value
  FROM scored s JOIN samples m ON m.dataset = s.dataset AND m.id = s.id WHERE s.eligible GROUP BY ALL)"""
_REP_DELTAS = """deltas AS (
  SELECT a.dataset, a.model, v.condition1, v.condition2, m.rep, a.metric, count(*) AS paired_n,
    avg(a.outcome::DOUBLE) AS rate1, avg(b.outcome::DOUBLE) AS rate2,
    (sum(b.outcome::INT) - sum(a.outcome::INT))::DOUBLE / count(*) AS delta
  FROM (VALUES ('exp1', 'exp2'), ('exp2', 'exp3')) v(condition1, condition2)
  JOIN scored a ON a.condition = v.condition1
  JOIN scored b ON b.condition = v.condition2 AND b.id = a.id AND b.dataset = a.dataset AND b.metric = a.metric
  JOIN samples m ON m.dataset = a.dataset AND m.id = a.id
  WHERE a.eligible AND b.eligible GROUP BY ALL)"""


@query("repeated_metrics", f"""WITH {NORMAL}, {SCORED}, {SAMPLED}, {_REP_DELTAS}
SELECT dataset, model, condition1, condition2, rep::INT AS rep, metric, paired_n, round(rate1, 6) AS rate1,
  round(rate2, 6) AS rate2, round(delta, 6) AS delta FROM deltas""", ("responses",))
def _(spark, folder):
    rows = responses(spark, folder)
    found = R.repeated_deltas(rows, sample(spark, folder, rows))
    return rounded(found.drop("contrast", "metric_order"))


@query("repeated_conditions", f"""WITH {NORMAL}, {SCORED}, {SAMPLED}, {_REP_CONDITIONS}
SELECT dataset, model, condition, rep::INT AS rep, metric, denominator_n, round(value, 6) AS value FROM conditions""",
       ("responses",))
def _(spark, folder):
    rows = responses(spark, folder)
    return rounded(R.repeated_conditions(rows, sample(spark, folder, rows)))


@query("repeated_aggregate", f"""WITH {NORMAL}, {SCORED}, {SAMPLED}, {_REP_DELTAS}
SELECT dataset, model, condition1, condition2, metric, count(*) AS repetitions, round(avg(delta), 6) AS mean,
  round(coalesce(stddev_samp(delta), 0), 6) AS sd, round(quantile_cont(delta, 0.025), 6) AS empirical_low,
  round(quantile_cont(delta, 0.975), 6) AS empirical_high, round(avg(paired_n), 6) AS mean_paired_n
FROM deltas GROUP BY ALL""", ("responses",))
def _(spark, folder):
    rows = responses(spark, folder)
    deltas = R.repeated_deltas(rows, sample(spark, folder, rows))
    keys = ("dataset", "model", "condition1", "condition2", "metric")
    return rounded(R.repeated_aggregate(deltas, "delta", "paired_n", keys, "mean_paired_n"))


@query("percentile_linear", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.025), 6) AS low,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.975), 6) AS high
FROM lineitem GROUP BY l_returnflag""")
def _(spark, folder):
    probs = {"low": 0.025, "median": 0.5, "high": 0.975}
    return rounded(R.exact_percentiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", probs))


# --- strata -------------------------------------------------------------------------------------------------

STRATA = f"""{NORMAL},
common_items AS (SELECT dataset, model, id FROM normal GROUP BY ALL HAVING count(*) FILTER (WHERE valid) = 4),
scored_items AS (SELECT dataset, model, id, target_probability FROM score_rows JOIN common_items USING (dataset, model, id)),
bounds AS (SELECT dataset, model, count(*) AS n, quantile_cont(target_probability, 1e0 / 3) AS q33,
  quantile_cont(target_probability, 2e0 / 3) AS q67 FROM scored_items GROUP BY ALL),
strata AS (SELECT s.*, CASE WHEN target_probability <= q33 THEN 'Low' WHEN target_probability <= q67 THEN 'Medium'
  ELSE 'High' END AS stratum FROM scored_items s JOIN bounds USING (dataset, model))"""


def strata(spark, folder):
    rows = responses(spark, folder)
    keys = ["dataset", "model", "id"]
    scores = view(spark, folder, "score_rows").select(*keys, "target_probability")
    scored = settle(P.score_join(P.common_valid_items(rows, K.FOUR_PROTOCOLS), scores, keys), "scored")
    bounds = R.tercile_thresholds(scored)
    assigned = R.assign_stratum(scored, bounds)
    return rows, bounds, assigned


TERCILES = f"""WITH {STRATA}
SELECT dataset, model, max(n) AS n, round(max(q33), 9) AS q33, round(max(q67), 9) AS q67,
  count(*) FILTER (WHERE stratum = 'Low') AS low_n, count(*) FILTER (WHERE stratum = 'Medium') AS medium_n,
  count(*) FILTER (WHERE stratum = 'High') AS high_n FROM strata JOIN bounds USING (dataset, model) GROUP BY ALL"""


@query("terciles", TERCILES, ("responses", "score_rows"))
def _(spark, folder):
    _, bounds, assigned = strata(spark, folder)
    return rounded(bounds.join(R.stratum_sizes(assigned), ["dataset", "model"]), 9)


STRATUM_METRICS = f"""WITH {STRATA}
SELECT dataset, model, condition, stratum, count(*) AS stratum_n,
  round(min(target_probability), 9) AS target_probability_min, round(max(target_probability), 9) AS target_probability_max,
  count(*) FILTER (WHERE initial <> distractor) AS cr_n,
  round(avg((final = distractor)::DOUBLE) FILTER (WHERE initial <> distractor), 9) AS cr,
  count(*) FILTER (WHERE initial = correct) AS hcr_n,
  round(avg((final = distractor)::DOUBLE) FILTER (WHERE initial = correct), 9) AS hcr
FROM normal JOIN strata USING (dataset, model, id) GROUP BY ALL"""


@query("stratum_metrics", STRATUM_METRICS, ("responses", "score_rows"))
def _(spark, folder):
    rows, _, assigned = strata(spark, folder)
    return rounded(R.stratum_metrics(rows.join(assigned, ["dataset", "model", "id"])), 9)


@query("stratum_contrasts", f"""WITH {STRATA},
rows AS (SELECT * FROM normal JOIN strata USING (dataset, model, id)),
counted AS (
  SELECT a.dataset, a.model, a.stratum, condition1, condition2, count(*) AS paired_n,
    count(*) FILTER (WHERE a.final = a.distractor AND b.final <> b.distractor) AS mcnemar_b,
    count(*) FILTER (WHERE a.final <> a.distractor AND b.final = b.distractor) AS mcnemar_c
  FROM (VALUES ('exp1', 'exp2'), ('exp2', 'exp3')) v(condition1, condition2)
  JOIN rows a ON a.condition = condition1 JOIN rows b ON b.condition = condition2 AND b.id = a.id
  WHERE a.initial <> a.distractor GROUP BY ALL),
{CI.interval('counted', 'paired_n', CI.BC)}
SELECT dataset, model, stratum, condition1, condition2, paired_n AS cr_n,
  round((mcnemar_c - mcnemar_b)::DOUBLE / paired_n, 6) AS delta_cr, ci_low, ci_high
FROM counted {CI.WITH_CI}""", ("responses", "score_rows"))
def _(spark, folder):
    scores = view(spark, folder, "score_rows")
    found = RP.tercile_report(responses(spark, folder), scores)["contrasts"]
    return rounded(found.select(
        "dataset", "model", "stratum", "condition1", "condition2", F.col("paired_n").alias("cr_n"),
        F.col("delta").alias("delta_cr"), "ci_low", "ci_high",
    ))


# --- selections ---------------------------------------------------------------------------------------------

NEAR_FAR = f"""{PROFILED},
near AS (SELECT *, 'near_similar' AS grp FROM profiled ORDER BY similarity_score DESC, k LIMIT 50),
far AS (SELECT *, 'far_exclusive' AS grp FROM profiled WHERE k NOT IN (SELECT k FROM near)
  ORDER BY exclusion_score DESC, similarity_score, k LIMIT 50),
chosen AS (SELECT * FROM near UNION ALL SELECT * FROM far)"""


@query("near_far_groups", f"""WITH {NEAR_FAR}
SELECT id, grp AS "group", similarity_score, exclusion_score FROM chosen""", ("textpairs",))
def _(spark, folder):
    groups = R.near_far_groups(settle(text_profiles(spark, folder), "profiles"), 50, "k")
    return groups.select("id", "group", "similarity_score", "exclusion_score")


_WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


@query("modal_value", f"""WITH counted AS (
  SELECT role, {_WORDS.format('text')} AS words, count(*) AS c FROM conversations GROUP BY ALL)
SELECT role, words::INT AS words, c AS frequency, (SELECT count(*) FROM conversations v WHERE v.role = counted.role)
  AS observed_n
FROM counted QUALIFY row_number() OVER (PARTITION BY role ORDER BY c DESC, words) = 1""")
def _(spark, folder):
    rows = table(spark, folder, "conversations").select("role", M.word_tokens(F.col("text")).alias("words"))
    return R.modal_value(rows, "words", ["role"])


_TURNS = """turns AS (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Noted. Continuing to the following part.' WHEN 1 THEN 'ANSWER: B'
    ELSE 'one two three four five six seven eight' END AS text FROM orders)"""


def _turns(spark, folder):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "Noted. Continuing to the following part.").when(k == 1, "ANSWER: B").otherwise(
        "one two three four five six seven eight")
    return table(spark, folder, "orders").select(text.alias("text"))


_ACKS = R.acknowledgement_candidates()


def _candidates_sql(texts) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts)) + ") v(ordinal, text)"


_MODE = f"""lens AS (SELECT {_WORDS.format('text')} AS n, count(*) AS c FROM turns GROUP BY ALL),
mode AS (SELECT n, (SELECT sum(c) FROM lens) AS observed_n FROM lens ORDER BY c DESC, n LIMIT 1)"""


@query("control_select", f"""WITH {_TURNS}, {_MODE},
matches AS (SELECT c.*, n, observed_n FROM {_candidates_sql(_ACKS).replace('v(', 'c(')} JOIN mode
  ON {_WORDS.format('c.text')} = n)
SELECT max(n)::INT AS target_tokens, max(observed_n)::BIGINT AS observed_n, count(*)::INT AS matching_candidate_n,
  (list(text ORDER BY ordinal))[1] AS neutral_v1, (list(text ORDER BY ordinal))[2] AS neutral_v2 FROM matches""")
def _(spark, folder):
    return R.control_select(_turns(spark, folder), "text", _ACKS, M.word_tokens)


@query("closest_candidate", f"""WITH {_TURNS}, {_MODE}
SELECT n::INT AS target_tokens, c.text, ({_WORDS.format('c.text')} - n)::INT AS gap
FROM {_candidates_sql(K.ACK_LENGTH_CANDIDATES).replace('v(', 'c(')} CROSS JOIN mode
ORDER BY abs({_WORDS.format('c.text')} - n), ordinal LIMIT 1""")
def _(spark, folder):
    return R.closest_candidate(_turns(spark, folder), "text", K.ACK_LENGTH_CANDIDATES, M.word_tokens)


# Label candidates against "Model": total characters of the guidance lines, so only five-letter labels match.
def _label_difference(label):
    opinions = M.source_lines(F.col("distractor"), F.lit("neutral_source_label"), label)
    model = M.source_lines(F.col("distractor"), F.lit("model_source_label"))
    return F.char_length(F.array_join(opinions, "\n")) - F.char_length(F.array_join(model, "\n"))


_LABEL_TEXTS = (*K.LABEL_CANDIDATES, "Guide")


@query("label_audit", f"""
SELECT ordinal, text AS label, count(*) AS item_n, count(*) FILTER (WHERE length(text) = 5) AS exact_match_n,
  CAST(5 * (length(text) - 5) AS VARCHAR) AS difference_values
FROM {_candidates_sql(_LABEL_TEXTS)} CROSS JOIN orders GROUP BY ordinal, text""")
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("distractor")
    return R.label_audit(items, _LABEL_TEXTS, _label_difference)


@query("label_select", f"""SELECT text AS label FROM {_candidates_sql(_LABEL_TEXTS)}
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey IS NOT NULL AND length(text) <> length('Model'))
ORDER BY ordinal LIMIT 1""")
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("distractor")
    return R.label_select(R.label_audit(items, _LABEL_TEXTS, _label_difference))


@query("sample_rows", """
SELECT condition, item_id, answer, raw_output FROM (
  SELECT *, coalesce(final_answer, nullif(upper(regexp_extract(raw_output, '(?i)\\bANSWER\\s*:\\s*([A-E])\\b', 1)), ''),
      nullif(regexp_extract(upper(raw_output), '\\b([A-E])\\b', 1), '')) AS answer,
    row_number() OVER (PARTITION BY condition ORDER BY k) AS r FROM label_rows) WHERE r <= 5""", ("label_rows",))
def _(spark, folder):
    rows = R.sample_rows(label_answers(spark, folder), ["condition"], "k")
    return rows.select("condition", "item_id", "answer", "raw_output")


_ORDER = ("HOUSEHOLD", "MACHINERY", "BUILDING")


@query("report_order", """
SELECT c_mktsegment AS segment, count(*) AS rows, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2
  WHEN 'BUILDING' THEN 3 END AS report_rank FROM customer GROUP BY ALL""")
def _(spark, folder):
    rows = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return R.report_order(rows, "segment", _ORDER)


