"""Pairing and paired inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.catalog.common import ABLATED, NORMAL, ablation, responses, rounded
from pairlens.catalog.rates import LABEL_ANSWERED, label_answers
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.functions.statistics import exact_mcnemar
from pairlens.operators import inference as I
from pairlens.operators import metrics as M
from pairlens.operators import pairing as P
from pairlens.plans.reports import label_tests

# --- SQL building blocks: paired outcomes, exact test by log-gamma sums, Holm by windows --------------------

_METRICS_SQL = "\nUNION ALL\n".join(
    f"SELECT *, {i} AS metric_order, '{name}' AS metric, {eligible} AS eligible, {outcome} AS outcome FROM normal WHERE valid"
    for i, (name, outcome, eligible) in enumerate([
        ("accuracy", "final = correct", "true"),
        ("target_adoption", "final = distractor", "true"),
        ("change_rate", "final <> initial", "true"),
        ("conformity_rate", "final = distractor", "initial <> distractor"),
        ("harmful_conformity", "final = distractor", "initial = correct"),
        ("beneficial_revision", "final = correct", "initial <> correct"),
    ])
)
SCORED = f"scored AS ({_METRICS_SQL})"
CONTRASTS = "contrasts AS (SELECT * FROM (VALUES (0, 'exp1', 'exp2'), (1, 'exp2', 'exp3')) v(contrast, condition1, condition2))"


def log_p(b: str, c: str) -> str:
    """Natural log of the exact two-sided p-value as a log-gamma sum."""
    n, m = f"({b} + {c})", f"least({b}, {c})"
    terms = (
        f"list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda q: "
        f"exp(lgamma({n} + 1.0) - lgamma(q + 1.0) - lgamma({n} - q + 1.0) - {n} * ln(2.0) - peak))"
    )
    peak = f"(lgamma({n} + 1.0) - lgamma({m} + 1.0) - lgamma({n} - {m} + 1.0) - {n} * ln(2.0))"
    return f"CASE WHEN {n} = 0 THEN 0e0 ELSE least(0e0, ln(2.0) + {peak} + ln(list_sum({terms.replace('peak', peak)}))) END"


TESTED_COLUMNS = f"""round(CASE WHEN paired_n > 0 THEN h1::DOUBLE / paired_n END, 6) AS rate1,
  round(CASE WHEN paired_n > 0 THEN h2::DOUBLE / paired_n END, 6) AS rate2,
  CASE WHEN paired_n > 0 THEN b END AS mcnemar_b, CASE WHEN paired_n > 0 THEN c END AS mcnemar_c,
  CASE WHEN paired_n > 0 THEN {log_p('b', 'c')} END AS log_p"""


def tested(keys: str, source: str = "paired", sign: str = "c - b", definition: str = "condition2_minus_condition1") -> str:
    """CTEs from paired outcome rows (o1, o2) to rates and p-values."""
    return f"""counted AS (
  SELECT {keys}, count(*) AS paired_n, count(*) FILTER (WHERE o1) AS h1, count(*) FILTER (WHERE o2) AS h2,
    count(*) FILTER (WHERE o1 AND NOT o2) AS b, count(*) FILTER (WHERE NOT o1 AND o2) AS c
  FROM {source} GROUP BY ALL),
tested AS (
  SELECT {keys}, paired_n, {TESTED_COLUMNS}, round(({sign})::DOUBLE / paired_n, 6) AS delta,
    '{definition}' AS delta_definition FROM counted)"""


def holm(family: str, order: str, member: str = "log_p IS NOT NULL") -> str:
    """CTE ``adjusted``: running maximum of (m - rank) p over the family."""
    return f"""ranked AS (
  SELECT *, exp(log_p) AS p, ({member}) AS inside,
    row_number() OVER (PARTITION BY {family}, ({member}) ORDER BY log_p, {order}) AS rk,
    count(*) OVER (PARTITION BY {family}, ({member})) AS m FROM tested),
adjusted AS (
  SELECT *, CASE WHEN inside THEN max(least(1e0, (m - rk + 1) * p)) OVER (
    PARTITION BY {family}, inside ORDER BY rk ROWS UNBOUNDED PRECEDING) END AS holm FROM ranked)"""


# Exact p-values are often multiples of a power of two, which lie on a rounding tie: both sides add NUDGE first.
NUDGE = 1e-12
OUTPUT = f"round(p + {NUDGE}, 9) AS p_raw, round(log_p / ln(10.0), 6) AS log10_p, round(holm + {NUDGE}, 9) AS p_holm"

def interval(source: str, n: str, counts: dict[str, int], name: str = "ci") -> str:
    """CTE ``ci`` (n, k0, k1 .., ci_low, ci_high): percentiles of the mean of a resample, for each set of counts of ``source``.

    ``counts`` gives the value that each count column adds; all other items add 0. The probability of a sum s is the
    cosine sum over the n-th powers of one draw's characteristic function, on a circle wider than 24 standard deviations.
    """
    keys = ", ".join(f"k{i}" for i in range(len(counts)))
    values = list(counts.values())
    first = " + ".join(f"({v}) * k{i}" for i, v in enumerate(values))
    second = " + ".join(f"{v * v} * k{i}" for i, v in enumerate(values))
    others = "n - " + " - ".join(f"k{i}" for i in range(len(values)))
    real = " + ".join(f"k{i} * cos({v} * t)" for i, v in enumerate(values))
    imaginary = " + ".join(f"k{i} * sin({v} * t)" for i, v in enumerate(values))
    return f"""{name}_need AS (
  SELECT DISTINCT {n} AS n, {", ".join(f"{c} AS k{i}" for i, c in enumerate(counts))} FROM {source} WHERE {n} > 0),
{name}_size AS (
  SELECT *, CAST({first} AS BIGINT) AS middle,
    CAST(24 * ceil(sqrt(greatest(0, n * (({second})::DOUBLE / n - (({first})::DOUBLE / n) ** 2)))) + 64 AS BIGINT) AS size FROM {name}_need),
{name}_turn AS (SELECT *, 2 * pi() * unnest(range(size)) / size AS t FROM {name}_size),
{name}_wave AS (
  SELECT *, ({others} + {real})::DOUBLE / n AS re, ({imaginary})::DOUBLE / n AS im FROM {name}_turn),
{name}_power AS (
  SELECT *, exp(n * ln(greatest(re * re + im * im, 1e-300)) / 2) AS height, n * atan2(im, re) AS angle FROM {name}_wave),
{name}_sum AS (SELECT n, {keys}, unnest(range(middle - size // 2, middle + size // 2)) AS s FROM {name}_size),
{name}_mass AS (
  SELECT n, {keys}, s, sum(height * cos(angle - t * s)) / any_value(size) AS mass
  FROM {name}_sum JOIN {name}_power USING (n, {keys}) GROUP BY n, {keys}, s),
{name}_upto AS (SELECT *, sum(mass) OVER (PARTITION BY n, {keys} ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_mass),
{name} AS (
  SELECT n, {keys}, round(min(s) FILTER (WHERE upto >= 0.025 - 1e-9)::DOUBLE / n, 6) AS ci_low,
    round(min(s) FILTER (WHERE upto >= 0.975 - 1e-9)::DOUBLE / n, 6) AS ci_high FROM {name}_upto GROUP BY n, {keys})"""


BC = {"mcnemar_b": -1, "mcnemar_c": 1}
CB = {"mcnemar_b": 1, "mcnemar_c": -1}
WITH_CI = "LEFT JOIN ci ON n = paired_n AND k0 = mcnemar_b AND k1 = mcnemar_c"

PAIRED = f"""{NORMAL}, {SCORED}, {CONTRASTS},
paired AS (
  SELECT a.dataset, a.model, a.id, contrast, condition1, condition2, a.metric_order, a.metric, a.outcome AS o1,
    b.outcome AS o2
  FROM contrasts JOIN scored a ON a.condition = condition1
  JOIN scored b ON b.condition = condition2 AND b.dataset = a.dataset AND b.model = a.model AND b.id = a.id
    AND b.metric = a.metric
  WHERE a.eligible AND b.eligible)"""
_KEYS = "dataset, model, contrast, condition1, condition2, metric_order, metric"
PAIRED_CONTRAST = f"""WITH {PAIRED}, {tested(_KEYS)}, {holm('metric', 'dataset, model, contrast')}
SELECT {_KEYS}, paired_n, rate1, rate2, delta, delta_definition, mcnemar_b, mcnemar_c, {OUTPUT} FROM adjusted"""


def inference_rounded(df):
    """Rates to six digits, p-values to nine."""
    nine = {"p_raw", "p_holm"}
    return df.select(*[
        (F.round(F.col(c) + NUDGE, 9) if c in nine else F.round(c, 6)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])


@query("paired_contrast", PAIRED_CONTRAST, ("responses",))
def _(spark, folder):
    return inference_rounded(I.paired_contrast(responses(spark, folder)))


# --- joins and sets -----------------------------------------------------------------------------------------

@query("pair_join", f"""WITH {NORMAL}, {CONTRASTS}
SELECT a.dataset, a.model, a.id, condition1, condition2, a.final = a.distractor AS outcome1,
  b.final = b.distractor AS outcome2
FROM contrasts JOIN normal a ON a.condition = condition1
JOIN normal b ON b.condition = condition2 AND b.id = a.id AND b.dataset = a.dataset AND b.model = a.model
WHERE a.valid AND b.valid AND a.initial <> a.distractor AND b.initial <> b.distractor""", ("responses",))
def _(spark, folder):
    return P.pair_join(responses(spark, folder), K.DEFAULT_CONTRASTS, M.CONFORMITY_ONLY[0])


@query("common_valid_kway", f"""WITH {NORMAL}
SELECT dataset, model, id FROM normal GROUP BY ALL HAVING count(*) FILTER (WHERE valid) = 4""", ("responses",))
def _(spark, folder):
    return P.common_valid_items(responses(spark, folder), K.FOUR_PROTOCOLS)


# Attempted: every condition but some missing exp4 rows.
_ATTEMPTED = "attempted AS (SELECT * FROM responses WHERE NOT (n = 4 AND k % 10 = 3))"


@query("frame_intersection", f"""WITH {_ATTEMPTED},
arms AS (SELECT DISTINCT dataset, condition FROM attempted)
SELECT dataset, id FROM attempted a GROUP BY dataset, id
HAVING count(DISTINCT condition) = (SELECT count(*) FROM arms WHERE arms.dataset = a.dataset)""", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses").where("NOT (n = 4 AND k % 10 = 3)")
    return P.frame_intersection(rows, arms=("condition",))


@query("frame_intersection_arms", """WITH answered AS (
  SELECT dataset, id || '|' || (k % 7) AS id, model, condition FROM responses WHERE k % 10 <> 3),
lists AS (SELECT dataset, count(DISTINCT condition || '|' || v) AS arms FROM answered CROSS JOIN range(3) r(v)
  GROUP BY dataset)
SELECT a.dataset, a.id FROM (SELECT DISTINCT dataset, id, condition, v FROM answered CROSS JOIN range(3) r(v)
  WHERE NOT (v = 2 AND length(id) % 2 = 0)) a JOIN lists l ON l.dataset = a.dataset
GROUP BY a.dataset, a.id, l.arms HAVING count(*) = l.arms""", ("responses",))
def _(spark, folder):
    """The default arms: every item is answered by three models, the third of which skips some."""
    rows = view(spark, folder, "responses").where("k % 10 <> 3").selectExpr("dataset", "id || '|' || (k % 7) AS id", "condition", "explode(array(0, 1, 2)) AS model")
    return P.frame_intersection(rows.where("NOT (model = 2 AND length(id) % 2 = 0)"))


@query("set_sizes", f"""WITH {_ATTEMPTED},
pairs AS (SELECT * FROM (VALUES ('exp1', 'exp4'), ('exp4', 'exp2')) v(condition1, condition2)),
cells AS (SELECT DISTINCT dataset, model FROM attempted),
ids AS (SELECT dataset, model, id, list(condition) AS cs FROM attempted GROUP BY ALL),
sided AS (SELECT dataset, model, condition1, condition2, list_contains(cs, condition1) AS l,
  list_contains(cs, condition2) AS r FROM ids CROSS JOIN pairs)
SELECT dataset, model, condition1, condition2, count(*) FILTER (WHERE l) AS condition1_n,
  count(*) FILTER (WHERE r) AS condition2_n, count(*) FILTER (WHERE l AND r) AS common_id_n,
  count(*) FILTER (WHERE l AND NOT r) AS condition1_only_n, count(*) FILTER (WHERE r AND NOT l) AS condition2_only_n
FROM sided GROUP BY ALL""", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses").where("NOT (n = 4 AND k % 10 = 3)")
    return P.set_sizes(rows, [("exp1", "exp4"), ("exp4", "exp2")])


@query("allowed_semi", """
SELECT dataset, condition, count(*) AS rows FROM responses
WHERE id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL""",
       ("responses",))
def _(spark, folder):
    allowed = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias("id")
    )
    kept = P.allowed_semi(view(spark, folder, "responses"), allowed, ["id"])
    return kept.groupBy("dataset", "condition").agg(F.count(F.lit(1)).alias("rows"))


@query("score_join", f"""WITH {NORMAL}
SELECT s.dataset, s.model, s.id, round(s.target_probability, 9) AS target_probability
FROM score_rows s JOIN (SELECT dataset, model, id FROM normal GROUP BY ALL
  HAVING count(*) FILTER (WHERE valid) = 4) c USING (dataset, model, id)""", ("responses", "score_rows"))
def _(spark, folder):
    keys = ["dataset", "model", "id"]
    items = P.common_valid_items(responses(spark, folder), K.FOUR_PROTOCOLS)
    scores = view(spark, folder, "score_rows").select(*keys, F.round("target_probability", 9).alias("target_probability"))
    return P.score_join(items, scores, keys)


@query("candidate_lookup", """
SELECT t.id, correct_text, target_text, question FROM textpairs t JOIN responses r ON r.id = t.id WHERE n = 1""",
       ("textpairs", "responses"))
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("id", "question")
    pairs = view(spark, folder, "textpairs").select("id", "correct_text", "target_text")
    return P.score_join(pairs, items, ["id"])


_COMPARISON_VALUES = ", ".join(f"('{x}', '{a}', '{b}', {str(adj).lower()})" for x, a, b, adj in K.ABLATION_COMPARISONS)
COMPARISONS = f"comparisons AS (SELECT * FROM (VALUES {_COMPARISON_VALUES}) v(comparison, condition1, condition2, adjust))"


@query("contrast_grid", f"""WITH {COMPARISONS},
present AS (SELECT DISTINCT dataset, model, condition FROM ablation WHERE NOT (dataset = 'MMLU' AND n = 5))
SELECT a.dataset, a.model, comparison, condition1, condition2, adjust
FROM comparisons JOIN present a ON a.condition = condition1
JOIN present b ON b.condition = condition2 AND b.dataset = a.dataset AND b.model = a.model""", ("ablation",))
def _(spark, folder):
    rows = view(spark, folder, "ablation").where("NOT (dataset = 'MMLU' AND n = 5)")
    return P.contrast_grid(rows, K.ABLATION_COMPARISONS)


@query("union_runs", """WITH runs AS (
  SELECT id, condition, NULL::BIGINT AS tokens FROM responses
  UNION ALL SELECT id, condition, final_prompt_token_count FROM ablation)
SELECT condition, count(*) AS rows, count(tokens) AS with_tokens FROM runs GROUP BY ALL""",
       ("responses", "ablation"))
def _(spark, folder):
    runs = P.union_runs(
        view(spark, folder, "responses").select("id", "condition"),
        view(spark, folder, "ablation").select("condition", "id", F.col("final_prompt_token_count").alias("tokens")),
    )
    return runs.groupBy("condition").agg(F.count(F.lit(1)).alias("rows"), F.count("tokens").alias("with_tokens"))


# --- inference ----------------------------------------------------------------------------------------------

@query("paired_bootstrap_ci", f"""WITH {PAIRED}, {tested(_KEYS)}, {interval('tested', 'paired_n', BC)}
SELECT dataset, model, condition1, condition2, metric, paired_n, delta, ci_low, ci_high FROM tested {WITH_CI}""", ("responses",))
def _(spark, folder):
    ci = I.add_paired_ci(I.paired_contrast(responses(spark, folder)))
    return rounded(ci.select("dataset", "model", "condition1", "condition2", "metric", "paired_n", "delta", "ci_low", "ci_high"))


@query("paired_bootstrap_sql", f"""WITH {NORMAL}, {CONTRASTS},
pairs AS (SELECT a.dataset, a.model, a.id, condition1, condition2, a.final = a.distractor AS o1,
  b.final = b.distractor AS o2 FROM contrasts JOIN normal a ON a.condition = condition1
  JOIN normal b ON b.condition = condition2 AND b.id = a.id
  WHERE a.valid AND b.valid AND a.initial <> a.distractor),
sizes AS (SELECT dataset, model, condition1, condition2, count(*) AS n, count(*) FILTER (WHERE o1 AND NOT o2) AS b,
  count(*) FILTER (WHERE NOT o1 AND o2) AS c FROM pairs GROUP BY ALL),
drawn AS (SELECT dataset, model, condition1, condition2, rep, n, b, c,
  CAST('0x' || substr(md5('7|' || rep || '|' || id), 1, 8) AS BIGINT) % n AS i
  FROM pairs JOIN sizes USING (dataset, model, condition1, condition2) CROSS JOIN range(1, 11) r(rep))
SELECT dataset, model, condition1, condition2, rep::INT AS rep, max(n) AS n,
  round(sum(CASE WHEN i < b THEN -1 WHEN i < b + c THEN 1 ELSE 0 END)::DOUBLE / max(n), 6) AS difference
FROM drawn GROUP BY ALL""", ("responses",))
def _(spark, folder):
    pairs = P.pair_join(responses(spark, folder), K.DEFAULT_CONTRASTS, M.CONFORMITY_ONLY[0])
    keys = ("dataset", "model", "condition1", "condition2")
    return rounded(I.paired_bootstrap_draws(pairs, 10, keys, seed="7"))


@query("exact_mcnemar", f"""WITH counts AS (
  SELECT l_suppkey AS suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS b,
    count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 5) AS c FROM lineitem GROUP BY ALL)
SELECT suppkey, b, c, round(exp({log_p('b', 'c')}) + {NUDGE}, 9) AS p_raw FROM counts""")
def _(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("b"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 5)).alias("c"),
    )
    return counts.withColumn("p_raw", F.round(exact_mcnemar("b", "c") + NUDGE, 9))


@query("holm_adjust", f"""WITH counts AS (
  SELECT l_suppkey AS suppkey, l_linestatus AS status, count(*) FILTER (WHERE l_returnflag = 'A') AS b,
    count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY ALL),
tested AS (SELECT *, {log_p('b', 'c')} AS log_p FROM counts), {holm('status', 'suppkey')}
SELECT suppkey, status, round(p + {NUDGE}, 9) AS p_raw, round(holm + {NUDGE}, 9) AS p_holm FROM adjusted""")
def _(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("suppkey"), F.col("l_linestatus").alias("status")
    ).agg(F.count_if(F.col("l_returnflag") == "A").alias("b"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    p = counts.select("suppkey", "status", exact_mcnemar("b", "c").alias("p_raw"))
    return inference_rounded(I.holm_adjust(p, ("status",), order=("suppkey",)))


# erf as its power series, enough terms for |z| below 5.
_ERFC = """1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda q:
  CASE WHEN q % 2 = 0 THEN 1 ELSE -1 END * exp((2 * q + 1) * ln(greatest(abs(z), 1e-12) / sqrt(2.0)) - lgamma(q + 1.0))
  / (2 * q + 1)))"""


@query("two_prop_z", f"""WITH {LABEL_ANSWERED},
s AS (SELECT condition, count(*) AS rows, count(*) FILTER (WHERE answer = distractor) AS d FROM answered GROUP BY ALL),
pairs AS (SELECT 'labelled_vs_unlabelled' AS test, a.d AS d1, a.rows AS n1, b.d AS d2, b.rows AS n2
  FROM s a, s b WHERE a.condition = 'labelled_5_wrong' AND b.condition = 'unlabelled_5_wrong'
  UNION ALL SELECT 'labelled_vs_mixed', a.d, a.rows, b.d, b.rows
  FROM s a, s b WHERE a.condition = 'labelled_5_wrong' AND b.condition = 'mixed_label_conflict'),
zs AS (SELECT test, (d1::DOUBLE / n1 - d2::DOUBLE / n2)
  / sqrt(((d1 + d2)::DOUBLE / (n1 + n2)) * (1 - (d1 + d2)::DOUBLE / (n1 + n2)) * (1e0 / n1 + 1e0 / n2)) AS z FROM pairs)
SELECT test, round(z, 6) AS z, round({_ERFC}, 6) AS p FROM zs""", ("label_rows",))
def _(spark, folder):
    return rounded(label_tests(M.label_summary(label_answers(spark, folder))))


_ABLATION_SCORED = "\nUNION ALL\n".join(
    f"SELECT *, {i} AS metric_order, '{m}' AS metric, {e} AS eligible, {o} AS outcome FROM ablated WHERE valid"
    for i, (m, o, e) in enumerate([
        ("accuracy", "is_correct", "true"), ("distractor_adoption", "chose_distractor", "true"),
        ("harmful_conformity", "chose_distractor", "coalesce(initial_correct, false)"),
        ("flip_rate", "changed", "changed IS NOT NULL"),
    ])
)


def ablation_paired(scored: str, comparisons: str, extra: str = "") -> str:
    return f"""{ABLATED}, scored AS ({scored}), {comparisons},
paired AS (
  SELECT a.dataset, a.model, a.id, comparison, condition1, condition2, adjust, a.metric_order, a.metric,
    a.outcome AS o1, b.outcome AS o2
  FROM comparisons JOIN scored a ON a.condition = condition1
  JOIN scored b ON b.condition = condition2 AND b.dataset = a.dataset AND b.model = a.model AND b.id = a.id
    AND b.metric = a.metric
  WHERE a.eligible AND b.eligible {extra})"""


_AKEYS = "dataset, model, comparison, condition1, condition2, adjust, metric_order, metric"
_FIRST = ("b - c", "condition1_minus_condition2")
ABLATION_CONTRAST = f"""WITH {ablation_paired(_ABLATION_SCORED, COMPARISONS)}, {tested(_AKEYS, 'paired', *_FIRST)},
{holm('dataset, model, metric', 'comparison', 'log_p IS NOT NULL AND adjust')}
SELECT {_AKEYS}, paired_n, rate1, rate2, delta, delta_definition, mcnemar_b, mcnemar_c, {OUTPUT} FROM adjusted"""


@query("ablation_contrast", ABLATION_CONTRAST, ("ablation",))
def _(spark, folder):
    return inference_rounded(I.ablation_contrast(ablation(spark, folder)).drop("contrast"))


_CR_SCORED = """SELECT *, 0 AS metric_order, 'conformity_rate' AS metric,
  initial IS DISTINCT FROM distractor AS eligible, chose_distractor AS outcome FROM ablated WHERE valid"""
CR = (M.Metric("conformity_rate", "chose_distractor", "NOT (initial <=> distractor)"),)


@query("direct_cr_paired", f"""WITH {ablation_paired(_CR_SCORED, COMPARISONS)}, {tested(_AKEYS, 'paired', *_FIRST)},
{holm('dataset, model, metric', 'comparison', 'log_p IS NOT NULL AND adjust')}
SELECT dataset, model, comparison, condition1 AS first, condition2 AS second, adjust, paired_n, rate1 AS cr_first,
  rate2 AS cr_second, delta, mcnemar_b AS b, mcnemar_c AS c, {OUTPUT} FROM adjusted""", ("ablation",))
def _(spark, folder):
    found = I.ablation_contrast(ablation(spark, folder), metrics=CR)
    return inference_rounded(found.select(
        "dataset", "model", "comparison", F.col("condition1").alias("first"), F.col("condition2").alias("second"),
        "adjust", "paired_n", F.col("rate1").alias("cr_first"), F.col("rate2").alias("cr_second"), "delta",
        F.col("mcnemar_b").alias("b"), F.col("mcnemar_c").alias("c"), "p_raw", "log10_p", "p_holm",
    ))


def _values_contrasts(*pairs) -> str:
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    return f"contrasts AS (SELECT * FROM (VALUES {values}) v(contrast, condition1, condition2))"


def paired_sql(pairs, metrics: tuple[str, ...], family: str) -> str:
    body = PAIRED.replace(CONTRASTS, _values_contrasts(*pairs))
    chosen = ", ".join(f"'{m}'" for m in metrics)
    return f"""WITH {body}, chosen AS (SELECT * FROM paired WHERE metric IN ({chosen})), {tested(_KEYS, 'chosen')},
{holm(family, 'dataset, model, contrast')}
SELECT dataset, model, condition1, condition2, metric, paired_n, rate1, rate2, delta, mcnemar_b, mcnemar_c, {OUTPUT}
FROM adjusted"""


_SHORT = ("dataset", "model", "condition1", "condition2", "metric", "paired_n", "rate1", "rate2", "delta", "mcnemar_b",
          "mcnemar_c", "p_raw", "log10_p", "p_holm")


def _contrast(spark, folder, pairs, names, family):
    metrics = tuple(m for m in M.PAIRED_METRICS if m.name in names)
    found = I.paired_contrast(responses(spark, folder), pairs, metrics)
    return inference_rounded(I.holm_adjust(found, family, order=("contrast",)).select(*_SHORT))


# exp1, exp2 and exp3 stand for one, three and five peers.
_PEERS = (("exp1", "exp2"), ("exp2", "exp3"), ("exp1", "exp3"))


@query("peer_count_paired", paired_sql(_PEERS, ("conformity_rate",), "dataset, model, metric"), ("responses",))
def _(spark, folder):
    return _contrast(spark, folder, _PEERS, {"conformity_rate"}, ["dataset", "model", "metric"])


_LABEL_METRICS = ("accuracy", "target_adoption", "conformity_rate", "harmful_conformity")


@query("label_paired_2x2", paired_sql((("exp3", "exp4"),), _LABEL_METRICS, "metric"), ("responses",))
def _(spark, folder):
    return _contrast(spark, folder, (("exp3", "exp4"),), set(_LABEL_METRICS), ["metric"])


@query("rationale_paired", paired_sql((("exp2", "exp4"),), ("conformity_rate",), "dataset, model, metric")
       .replace(", round(holm + {NUDGE}, 9) AS p_holm".format(NUDGE=NUDGE), ""), ("responses",))
def _(spark, folder):
    found = _contrast(spark, folder, (("exp2", "exp4"),), {"conformity_rate"}, ["dataset", "model", "metric"])
    return found.drop("p_holm")


# Two "models" answer the same items: the order priority side decides nothing, the model column is the arm.
_ARMS = """arms AS (
  SELECT dataset, CAST(k // 2 AS VARCHAR) AS item, CASE WHEN k % 2 = 0 THEN 'small' ELSE 'big' END AS model, condition,
    valid, final, initial, distractor, final = distractor AS hit, valid AND initial <> distractor AS open
  FROM (SELECT *, 'all' AS grp FROM (SELECT * REPLACE ('pool' AS dataset) FROM normal) q) t WHERE n <= 3),
whole AS (SELECT item FROM arms GROUP BY item HAVING count(*) FILTER (WHERE open) = 6),
kept AS (SELECT a.* FROM arms a JOIN whole USING (item))"""


def _arms(spark, folder):
    rows = responses(spark, folder).where("n <= 3")
    return rows.withColumns({
        "id": F.floor(F.col("k") / 2).cast("string"), "dataset": F.lit("pool"),
        "model": F.when(F.col("k") % 2 == 0, "small").otherwise("big"),
    })


@query("scale_paired", f"""WITH {NORMAL}, {_ARMS},
paired AS (SELECT s.dataset, s.condition, s.hit AS o1, b.hit AS o2 FROM kept s JOIN kept b
  ON s.item = b.item AND s.condition = b.condition WHERE s.model = 'small' AND b.model = 'big'),
{tested('dataset, condition')}, {holm('dataset', 'condition')}
SELECT dataset, condition, paired_n AS n, rate1 AS cr_small, rate2 AS cr_big, delta, mcnemar_b AS b, mcnemar_c AS c,
  {OUTPUT} FROM adjusted""", ("responses",))
def _(spark, folder):
    found = I.model_contrast(_arms(spark, folder), "small", "big", ("exp1", "exp2", "exp3"))
    return inference_rounded(found.select(
        "dataset", "condition", F.col("paired_n").alias("n"), F.col("rate1").alias("cr_small"),
        F.col("rate2").alias("cr_big"), "delta", F.col("mcnemar_b").alias("b"), F.col("mcnemar_c").alias("c"),
        "p_raw", "log10_p", "p_holm",
    ))


@query("interaction_contrast", f"""WITH {NORMAL}, {_ARMS},
wide AS (SELECT dataset, item, {", ".join(
    f"max(hit::INT) FILTER (WHERE model = '{m}' AND condition = '{c}') AS {m}_{c}"
    for m in ('small', 'big') for c in ('exp1', 'exp2', 'exp3'))} FROM kept GROUP BY ALL),
vals AS ({" UNION ALL ".join(
    f"SELECT dataset, {i} AS contrast, '{a}' AS condition1, '{b}' AS condition2, "
    f"(big_{b} - big_{a}) - (small_{b} - small_{a}) AS v FROM wide"
    for i, (a, b) in enumerate([('exp1', 'exp2'), ('exp2', 'exp3'), ('exp1', 'exp3')]))}),
points AS (
  SELECT dataset, contrast, condition1, condition2, count(*) AS item_n, round(avg(v), 6) AS interaction,
    {", ".join(f"count(*) FILTER (WHERE v = {v}) AS {name}" for v, name in
               ((-2, 'v_m2'), (-1, 'v_m1'), (0, 'v_0'), (1, 'v_p1'), (2, 'v_p2')))}
  FROM vals GROUP BY ALL),
{interval('points', 'item_n', {'v_m2': -2, 'v_m1': -1, 'v_p1': 1, 'v_p2': 2})}
SELECT dataset, contrast, condition1, condition2, item_n AS n, interaction, v_m2, v_m1, v_0, v_p1, v_p2, ci_low, ci_high
FROM points JOIN ci ON n = item_n AND k0 = v_m2 AND k1 = v_m1 AND k2 = v_p1 AND k3 = v_p2""", ("responses",))
def _(spark, folder):
    points = I.interaction_contrast(
        _arms(spark, folder), "small", "big", ("exp1", "exp2", "exp3"), ((0, 1), (1, 2), (0, 2))
    )
    return rounded(I.interaction_ci(points))


_EXACT_VALUES = ", ".join(f"('{x}', '{a}', '{b}', false)" for x, a, b in K.EXACT_TOKEN_COMPARISONS)
_EXACT = f"comparisons AS (SELECT * FROM (VALUES {_EXACT_VALUES}) v(comparison, condition1, condition2, adjust))"


@query("exact_token_contrast", f"""WITH {ablation_paired(
    _ABLATION_SCORED, _EXACT, 'AND a.final_prompt_token_count = b.final_prompt_token_count')},
{tested(_AKEYS, 'paired', *_FIRST)}
SELECT {_AKEYS}, 'exact_final_prompt_token_match' AS analysis_subset, paired_n, rate1, rate2, delta, delta_definition,
  mcnemar_b, mcnemar_c, round(exp(log_p) + {NUDGE}, 9) AS p_raw, round(log_p / ln(10.0), 6) AS log10_p FROM tested""",
       ("ablation",))
def _(spark, folder):
    return inference_rounded(I.exact_token_contrast(ablation(spark, folder)).drop("contrast", "p_holm"))


_TOKEN_PAIRS = f"""{_EXACT},
pairs AS (SELECT a.dataset, a.model, condition1, condition2, a.final_prompt_token_count AS t1,
  b.final_prompt_token_count AS t2 FROM comparisons JOIN ablation a ON a.condition = condition1
  JOIN ablation b ON b.condition = condition2 AND b.id = a.id)"""
_TOKEN_CONTRASTS = [(a, b) for _, a, b in K.EXACT_TOKEN_COMPARISONS]


@query("token_pair_audit", f"""WITH {_TOKEN_PAIRS}
SELECT dataset, model, condition1, condition2, count(*) AS common_n,
  count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL) AS covered_n,
  count(*) FILTER (WHERE t1 = t2) AS exact_match_n FROM pairs GROUP BY ALL""", ("ablation",))
def _(spark, folder):
    return I.token_pair_audit(I.token_pairs(view(spark, folder, "ablation"), _TOKEN_CONTRASTS))


@query("token_pair_histogram", f"""WITH {_TOKEN_PAIRS}
SELECT dataset, model, condition1, condition2, t1 - t2 AS difference, count(*) AS items FROM pairs
WHERE t1 IS NOT NULL AND t2 IS NOT NULL GROUP BY ALL""", ("ablation",))
def _(spark, folder):
    return I.token_pair_histogram(I.token_pairs(view(spark, folder, "ablation"), _TOKEN_CONTRASTS))


