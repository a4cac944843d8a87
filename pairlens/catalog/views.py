"""Evaluation tables derived from the given tables by integer arithmetic.

The given tables hold no evaluation rows, so these views make them: each is one SELECT that both engines accept.
Only the row generator (``each``) is spelled differently, and Spark is told into how many tasks to deal rows that are
multiplied (``dealt``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One answer row per order and condition exp1..exp4.
_RESPONSES = """
SELECT CAST(k AS STRING) AS id, k, c, n, u, h, dataset, model, 'exp' || CAST(n AS STRING) AS condition, correct,
  distractor,
  CASE WHEN u < 65 THEN correct WHEN u < 78 THEN distractor ELSE substr('ABCD', CAST((ci + 2) % 4 AS INT) + 1, 1) END
    AS initial,
  CASE WHEN h < 20 + 8 * n THEN distractor
       WHEN h < 90 THEN CASE WHEN u < 65 THEN correct WHEN u < 78 THEN distractor
                             ELSE substr('ABCD', CAST((ci + 2) % 4 AS INT) + 1, 1) END
       WHEN h < 96 THEN correct END AS final,
  h >= 96 AND k % 2 = 0 AS is_error,
  'Question ' || CAST(k AS STRING) || ' of customer ' || CAST(c AS STRING) AS question
FROM (
  SELECT k, c, n, dataset, model, ci, di, (13 * k + 5 * c) % 100 AS u,
    (31 * k + 17 * c + 1009 * n * n + 7 * n) % 100 AS h,
    substr('ABCD', CAST(ci AS INT) + 1, 1) AS correct, substr('ABCD', CAST(di AS INT) + 1, 1) AS distractor
  FROM (
    SELECT k, c, n, dataset, model, ci, (ci + 1 + (k + c) % 3) % 4 AS di
    FROM (
      SELECT{dealt} o_orderkey AS k, o_custkey AS c, c_mktsegment AS model, (7 * o_orderkey + 3 * o_custkey) % 4 AS ci,
        CASE WHEN o_orderkey % 2 = 0 THEN 'CSQA' ELSE 'MMLU' END AS dataset
      FROM {orders} o JOIN {customer} cu ON o.o_custkey = cu.c_custkey
    ) base {each4}
  ) placed
) lettered
"""

# The same items under the seven ablation conditions; token counts are partly missing.
_ABLATION = """
SELECT CAST(k AS STRING) AS id, k, n, dataset, model, correct, distractor,
  CASE n WHEN 1 THEN 'sequential_final' WHEN 2 THEN 'stepwise_no_history' WHEN 3 THEN 'stepwise_answer_history'
         WHEN 4 THEN 'stepwise_answer_confidence_history' WHEN 5 THEN 'sequential_final_length_matched'
         WHEN 6 THEN 'sequential_final_neutral_v2' ELSE 'sequential_final_short_ack' END AS condition,
  CASE WHEN k % 19 = 4 THEN NULL WHEN u < 65 THEN correct WHEN u < 78 THEN distractor ELSE 'D' END AS initial,
  CASE WHEN h < 15 + 6 * n THEN distractor WHEN h < 92 THEN correct WHEN h < 96 THEN 'D' END AS final,
  CASE WHEN k % 17 = 3 THEN h < 60 END AS final_valid,
  CASE WHEN k % 13 = 0 THEN NULL ELSE 100 + (k % 7) + CASE WHEN k % 5 = 0 THEN n ELSE 0 END END
    AS final_prompt_token_count
FROM (
  SELECT k, c, n, dataset, model, (13 * k + 5 * c) % 100 AS u, (29 * k + 11 * c + 13 * n * n + 3 * n) % 100 AS h,
    substr('ABCD', CAST((7 * k + 3 * c) % 4 AS INT) + 1, 1) AS correct,
    substr('ABCD', CAST(((7 * k + 3 * c) % 4 + 1 + (k + c) % 3) % 4 AS INT) + 1, 1) AS distractor
  FROM (
    SELECT{dealt} o_orderkey AS k, o_custkey AS c, c_mktsegment AS model,
      CASE WHEN o_orderkey % 2 = 0 THEN 'CSQA' ELSE 'MMLU' END AS dataset
    FROM {orders} o JOIN {customer} cu ON o.o_custkey = cu.c_custkey
  ) base {each7}
) lettered
"""

# JSONL lines of the responses in four generations of keys, with blank and broken lines.
_LINES = """
SELECT file, line_number, k, n,
  CASE WHEN k % 89 = 7 THEN '   '
       WHEN k % 97 = 5 THEN '{{"id": "' || id || '", "initial_prediction": '
       WHEN k % 4 = 0 THEN '{{"id": ' || id || ', "experiment_mode": "' || condition || '", "initial_prediction": "'
         || initial || '", "final_prediction": ' || coalesce('" ' || {lower_final} || ' "', 'null')
         || ', "correct_answer": "' || correct || '", "distractor": "' || distractor || '", "is_error": '
         || CASE WHEN is_error THEN 'true' ELSE 'false' END
         || ', "raw_output": ' || CASE WHEN k % 8 = 4 THEN '"[]"' ELSE '"ANSWER: x"' END || ', "option_logprobs": {{"A": -0.5}}, "question": "' || question
         || '", "options": {{"A": "one", "B": "two", "C": "three", "D": "four"}}}}'
       WHEN k % 4 = 1 THEN '{{"item_id": "' || id || '", "initial_answer": "' || initial || '", "attack_prediction": '
         || coalesce('"' || final || '"', 'null') || ', "correct": "' || correct || '", "target_distractor": "'
         || distractor || '", "raw_attack_output": "", "attack_option_logprobs": {{}}, "question": "' || question
         || '"}}'
       WHEN k % 4 = 2 THEN '{{"id": "' || id || '", "private_prediction": "' || initial
         || '", "final_answer": null, "prediction": "' || coalesce(final, 'A') || '", "gold_answer": "' || correct
         || '", "target_wrong": "' || distractor || '", "is_error": "true", "text": "x"}}'
       ELSE '{{"id": "' || id || '", "initial_prediction": "' || initial || '", "prediction": '
         || coalesce('"' || final || '"', '""') || ', "correct_answer": "' || correct || '", "distractor": "'
         || distractor || '", "final_valid": ' || CASE WHEN k % 40 = 3 THEN 'false' ELSE 'true' END
         || ', "options": {{"a ": "one", "B": "two", "C": "three"}}}}' END AS value
FROM (
  SELECT *, condition || '_' || dataset || '.jsonl' AS file, k AS line_number FROM {responses} r
) named
"""

# Attack and defense rows; level L5 never occurs.
_ATTACKS = """
SELECT CAST(l_orderkey AS STRING) AS id,
  CASE WHEN l_linestatus = 'F' THEN 'single_input' ELSE 'sequential_input' END AS input_mode,
  CASE WHEN v % 23 = 0 THEN NULL ELSE 'L' || CAST(1 + v % 4 AS STRING) END AS attack_level,
  correct_answer, distractor,
  CASE WHEN a < 60 THEN correct_answer WHEN a < 75 THEN distractor WHEN a < 95 THEN 'E' END AS initial_prediction,
  CASE WHEN b < 35 THEN distractor WHEN b < 80 THEN correct_answer WHEN b < 95 THEN 'E' END AS attack_prediction,
  CASE WHEN d < 55 THEN correct_answer WHEN d < 90 THEN distractor END AS defended_prediction
FROM (
  SELECT *, substr('ABCD', CAST(v % 4 AS INT) + 1, 1) AS correct_answer,
    substr('ABCD', CAST((v + 1) % 4 AS INT) + 1, 1) AS distractor,
    (13 * v + l_suppkey) % 100 AS a, (7 * v + 3 * l_suppkey) % 100 AS b, (11 * v + 5 * l_suppkey) % 100 AS d
  FROM (SELECT *, l_partkey + l_linenumber AS v FROM {lineitem} li) numbered
) drawn
"""

# Mechanism rows: one opinion list per order, two input modes.
_MECHANISMS = """
SELECT id, dataset, k, n, correct, distractor, initial, final,
  CASE WHEN n <= 2 THEN 'single_input' ELSE 'sequential_input' END AS input_mode,
  CASE WHEN n % 2 = 0 THEN 'input_mode_comparison' ELSE 'peer_share' END AS dimension,
  'target_consensus_n' || CAST(1 + k % 5 AS STRING) AS condition_name, 1 + k % 5 AS target_votes, k % 3 AS correct_votes
FROM {responses} r
"""

# Label-attention rows with raw text, log-probs, errors and an unknown condition.
_LABELS = """
SELECT k, CAST(k AS STRING) AS item_id,
  CASE WHEN k % 50 = 0 THEN 'other_condition' WHEN k % 3 = 0 THEN 'labelled_5_wrong'
       WHEN k % 3 = 1 THEN 'unlabelled_5_wrong' ELSE 'mixed_label_conflict' END AS condition,
  correct, distractor,
  CASE WHEN k % 7 = 0 THEN NULL ELSE final END AS final_answer,
  CASE WHEN k % 41 = 0 THEN ' ' WHEN k % 7 = 0 AND k % 2 = 0 THEN 'answer :  ' || lower(coalesce(final, 'x'))
       WHEN k % 7 = 0 THEN 'It must be ' || coalesce(final, 'unclear') || ' here' ELSE 'none given' END AS raw_output,
  CASE WHEN k % 9 < 6 THEN CAST(-((k * 7 + 13) % 1000) AS DOUBLE) / 100 END AS lp_correct,
  CASE WHEN k % 9 < 5 THEN CAST(-((k * 11 + 29) % 1000) AS DOUBLE) / 100 END AS lp_distractor,
  k % 61 = 0 AS is_error,
  CASE WHEN k % 61 = 0 THEN 'timeout   after ' || CAST(k % 4 AS STRING) || ' tries'
       WHEN k % 67 = 0 THEN repeat('long message ', 20) END AS error,
  CASE WHEN k % 61 = 0 THEN 'Timeout' END AS error_type
FROM {responses} r WHERE n = 2
"""

# Target probabilities from integer weights.
_SCORES = """
SELECT id, k, dataset, model, correct AS correct_answer, distractor AS target_distractor,
  CAST(wa AS DOUBLE) / w AS prob_a, CAST(wb AS DOUBLE) / w AS prob_b, CAST(wc AS DOUBLE) / w AS prob_c,
  CAST(wd AS DOUBLE) / w AS prob_d,
  CAST(CASE distractor WHEN 'A' THEN wa WHEN 'B' THEN wb WHEN 'C' THEN wc ELSE wd END AS DOUBLE) / w
    AS target_probability,
  CAST(CASE correct WHEN 'A' THEN wa WHEN 'B' THEN wb WHEN 'C' THEN wc ELSE wd END AS DOUBLE) / w
    AS correct_probability
FROM (
  SELECT *, wa + wb + wc + wd AS w FROM (
    SELECT id, k, dataset, model, correct, distractor, 1 + (k * 3 + c * 5) % 97 AS wa, 1 + (k * 5 + c * 7) % 89 AS wb,
      1 + (k * 7 + c * 11) % 83 AS wc, 1 + (k * 11 + c * 13) % 79 AS wd
    FROM {responses} r WHERE n = 1
  ) weights
) summed
"""

# Option texts of part pairs; some pairs split an antonym.
_TEXTPAIRS = """
SELECT CAST(a.p_partkey AS STRING) AS id, a.p_partkey AS k,
  CASE a.p_partkey % 8 WHEN 0 THEN 'hot ' WHEN 1 THEN 'Open ' WHEN 2 THEN 'big-' WHEN 3 THEN 'clean ' ELSE '' END
    || a.p_name AS correct_text,
  CASE a.p_partkey % 8 WHEN 0 THEN 'Cold ' WHEN 1 THEN 'closed ' WHEN 2 THEN 'small ' WHEN 3 THEN 'tidy ' ELSE '' END
    || b.p_name AS target_text
FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1
"""

# One row per item, condition and step.
_STEPROWS = """
SELECT id, k, n, dataset, model, condition, correct, distractor, initial, final, step,
  CASE WHEN g < 30 + 5 * step THEN distractor WHEN g < 85 THEN initial WHEN g < 95 THEN correct END AS prediction,
  (g + step) % 101 AS confidence,
  CASE WHEN g % 3 > 0 THEN CAST(-g AS DOUBLE) / 10 END AS lp
FROM (
  SELECT r.*, step, (17 * k + 7 * c + 211 * n + 37 * step) % 100 AS g FROM {responses} r {step5}
) stepped
"""

VIEWS = {
    "responses": _RESPONSES, "ablation": _ABLATION, "lines": _LINES, "attacks": _ATTACKS,
    "mechanisms": _MECHANISMS, "label_rows": _LABELS, "score_rows": _SCORES, "textpairs": _TEXTPAIRS,
    "steprows": _STEPROWS,
}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _each(n: int, name: str, spark: bool) -> str:
    values = ", ".join(str(i) for i in range(1, n + 1))
    if spark:
        return f"LATERAL VIEW explode(array({values})) e AS {name}"
    return f"CROSS JOIN (SELECT unnest([{values}]) AS {name}) e"


def _fill(name: str, tables: dict[str, str], spark: bool, dealt: str = "") -> str:
    names = dict(tables)
    for view in VIEWS:
        if view != name and "{" + view + "}" in VIEWS[name]:
            names[view] = "(" + _fill(view, tables, spark, dealt) + ")"
    return VIEWS[name].format(
        **names, dealt=dealt, each4=_each(4, "n", spark), each7=_each(7, "n", spark), step5=_each(5, "step", spark),
        # the labels are A-E, for which no locale is needed
        lower_final="translate(final, 'ABCDE', 'abcde')" if spark else "lower(final)",
    ).strip()


def duck_view(name: str) -> str:
    return _fill(name, {t: t for t in TABLES}, False)


_SEEN: dict[tuple, DataFrame | int] = {}


def _once(spark: SparkSession, folder: str, name: str, make):
    """Analysed tables and their counts by session: reading a footer or analysing a view again for every query would only cost
    time."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _SEEN:
        _SEEN[key] = make()
    return _SEEN[key]


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One of the given tables. ``spread`` gives a table of a few file splits to all cores for heavy row work."""
    df = _once(spark, folder, name, lambda: spark.read.parquet(f"{folder}/{name}.parquet"))
    return _once(spark, folder, f"spread {name}", lambda: spread_small(df)) if spread else df


#: Rows of a driving table a task: each of them becomes up to twenty rows, of some hundred bytes as text.
TASK_ROWS = 30_000
#: Compressed bytes of a shuffle that one task gets: up to 600,000 rows of keys alone.
MERGED_BYTES = 8 << 20


def spread_small(scan: DataFrame) -> DataFrame:
    """All cores for a scan with fewer splits than that; large tables are left as they are, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def tasks_of(scan: DataFrame) -> int:
    """Tasks for a table that views multiply, by its number of rows, which the footers give: its files are small for what is
    made of them, and a row group is one task's work however many rows it has.

    What is grouped or joined afterwards gets a third as many partitions at least. Spark merges them by compressed bytes, of
    which rows with numbered ids need few, so it is told to merge less.
    """
    spark = scan.sparkSession
    tasks = -(-scan.count() // TASK_ROWS)
    at_least(spark, "spark.sql.shuffle.partitions", -(-tasks // 3))
    at_most_bytes(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED_BYTES)
    return max(spark.sparkContext.defaultParallelism, tasks)


def at_least(spark: SparkSession, setting: str, n: int) -> None:
    """Raise a number among the session's settings; it is never lowered."""
    if int(spark.conf.get(setting)) < n:
        spark.conf.set(setting, str(n))


def at_most_bytes(spark: SparkSession, setting: str, n: int) -> None:
    """Lower a number of bytes among the session's settings; it is never raised."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > n:
        spark.conf.set(setting, f"{n}b")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the derived tables."""

    def build() -> DataFrame:
        # Rows are dealt after the join: by bytes, Spark would merge what a join shuffles into as few tasks as there are cores.
        text = _fill(name, {t: f"@{t}@" for t in TABLES}, True, "#dealt#").replace("{", "{{").replace("}", "}}")
        used = {t: table(spark, folder, t, spread=t == "lineitem") for t in TABLES if f"@{t}@" in text}
        if "#dealt#" in text:
            text = text.replace("#dealt#", f" /*+ REPARTITION({_once(spark, folder, 'tasks', lambda: tasks_of(used['orders']))}) */")
        for t in used:
            text = text.replace(f"@{t}@", "{" + t + "}")
        return spark.sql(text, **used)

    return _once(spark, folder, f"view {name}", build)
