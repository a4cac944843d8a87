"""Projection, normalisation and data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.catalog.common import ABLATED, NORMAL, ablation, responses, rounded
from pairlens.catalog.rates import LABEL_ANSWERED, label_answers
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.functions import labels as L
from pairlens.functions import messages as M
from pairlens.operators import audits as A
from pairlens.operators import guards as G
from pairlens.operators import items as T
from pairlens.operators import normalize as N
from pairlens.operators import pairing as P


def first_sql(names, typed: bool = False) -> str:
    """First key that exists in the JSON text, on the SQL side."""
    get = "json_extract(value, '$.{0}')" if typed else "json_extract_string(value, '$.{0}')"
    cases = " ".join(f"WHEN json_exists(value, '$.{n}') THEN {get.format(n)}" for n in names)
    return f"CASE {cases} END"


def label_sql(expr: str) -> str:
    return f"(SELECT CASE WHEN x IN ('A','B','C','D','E') THEN x END FROM (SELECT upper(trim({expr})) AS x))"


GOOD = "good AS (SELECT * FROM lines WHERE json_valid(value))"


@query("first_present", f"""WITH {GOOD}
SELECT file, line_number, {first_sql(K.FINAL_KEYS)} AS final_value, {first_sql(K.ID_KEYS)} AS id_value FROM good""",
       ("lines",))
def _(spark, folder):
    rows = N.with_record(view(spark, folder, "lines"), name="v").where("v IS NOT NULL")
    return rows.select(
        "file", "line_number", L.first_key(F.col("v"), K.FINAL_KEYS).alias("final_value"),
        L.first_key(F.col("v"), K.ID_KEYS).alias("id_value"),
    )


@query("first_present_map", """
SELECT event_id, CASE WHEN json_exists(props, '$.level') THEN json_extract_string(props, '$.level')
  WHEN json_exists(props, '$.k') THEN json_extract_string(props, '$.k') END AS first_value FROM events""")
def _(spark, folder):
    fields = F.from_json("props", "map<string,string>")
    return table(spark, folder, "events").withColumn("m", fields).select(
        "event_id", L.first_present(F.col("m"), ("level", "k")).alias("first_value")
    )


@query("label_normalize", """
SELECT label, count(*) AS rows FROM (
  SELECT CASE WHEN x IN ('A','B','C','D','E') THEN x END AS label FROM (
    SELECT upper(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' || lower(substr(source, 1, 1)) || ' '
                           WHEN doc_id % 3 = 1 THEN substr(lang, 1, 1) ELSE lang END)) AS x FROM documents))
GROUP BY label""")
def _(spark, folder):
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.lower(F.substring("source", 1, 1)), F.lit(" ")))
        .when(F.col("doc_id") % 3 == 1, F.substring("lang", 1, 1)).otherwise(F.col("lang"))
    )
    labelled = table(spark, folder, "documents").select(L.label_normalize(raw).alias("label"))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


_NORMALIZED = f"""{GOOD},
named AS (SELECT file, line_number, {first_sql(K.ID_KEYS)} AS id, upper(trim({first_sql(K.INITIAL_KEYS)})) AS i0,
  upper(trim({first_sql(K.FINAL_KEYS)})) AS f0, upper(trim({first_sql(K.CORRECT_KEYS)})) AS c0,
  upper(trim({first_sql(K.DISTRACTOR_KEYS)})) AS d0,
  coalesce(json_type(value, '$.is_error') = 'BOOLEAN' AND json_extract_string(value, '$.is_error') = 'true', false)
    AS is_error, coalesce(json_extract_string(value, '$.final_valid') = 'false', false) AS marked,
  json_extract_string(value, '$.question') AS question,
  CASE WHEN json_type(value, '$.options') = 'OBJECT'
    THEN list_transform(json_keys(value, '$.options'), lambda x: upper(trim(x))) ELSE ['A','B','C','D','E'] END AS labels
  FROM good),
lettered AS (SELECT file, line_number, id, is_error, marked, question, labels,
  CASE WHEN i0 IN ('A','B','C','D','E') THEN i0 END AS initial, CASE WHEN f0 IN ('A','B','C','D','E') THEN f0 END AS final,
  CASE WHEN c0 IN ('A','B','C','D','E') THEN c0 END AS correct,
  CASE WHEN d0 IN ('A','B','C','D','E') THEN d0 END AS distractor FROM named)"""


@query("normalize_responses", f"""WITH {_NORMALIZED}
SELECT file, line_number, id, initial, final, correct, distractor, question,
  coalesce(NOT is_error AND NOT marked AND list_contains(labels, initial) AND list_contains(labels, final)
    AND list_contains(labels, correct) AND list_contains(labels, distractor) AND correct <> distractor, false) AS valid
FROM lettered""", ("lines",))
def _(spark, folder):
    rows = N.normalize_lines(view(spark, folder, "lines").select("file", "line_number", "value"))
    return rows.where("parsed").select(
        "file", "line_number", "id", "initial", "final", "correct", "distractor", "question", "valid"
    )


@query("normalize_ablation", f"""WITH {ABLATED}
SELECT id, condition, valid, is_correct, chose_distractor, changed, initial_correct FROM ablated""", ("ablation",))
def _(spark, folder):
    return ablation(spark, folder).select(
        "id", "condition", "valid", "is_correct", "chose_distractor", "changed", "initial_correct"
    )


@query("derive_flags", """
SELECT id, condition, final IS DISTINCT FROM initial AS changed, final IS NOT DISTINCT FROM distractor
    AS conformed_to_target, initial = correct AND final IS NOT DISTINCT FROM distractor AS wrong_conformity,
  initial <> correct AND final IS NOT DISTINCT FROM correct AS beneficial_revision,
  target_votes + correct_votes AS opinion_count, target_votes AS target_vote_count, correct_votes AS correct_vote_count
FROM (SELECT *, 'exp' || n AS condition FROM mechanisms)""", ("mechanisms",))
def _(spark, folder):
    rows = view(spark, folder, "mechanisms").withColumn("opinions", F.concat(
        F.array_repeat(F.col("distractor"), F.col("target_votes").cast("int")),
        F.array_repeat(F.col("correct"), F.col("correct_votes").cast("int")),
    )).withColumn("condition", F.concat(F.lit("exp"), F.col("n").cast("string")))
    return N.vote_counts(N.derive_flags(rows)).select(
        "id", "condition", "changed", "conformed_to_target", "wrong_conformity", "beneficial_revision",
        "opinion_count", "target_vote_count", "correct_vote_count",
    )


@query("support_ratios", """
SELECT item_id, condition, CASE WHEN condition = 'other_condition' THEN NULL WHEN condition = 'mixed_label_conflict'
    THEN 3 ELSE 5 END AS num_wrong_supporters,
  CASE WHEN condition = 'other_condition' THEN NULL WHEN condition = 'mixed_label_conflict' THEN 2 ELSE 0 END
    AS num_correct_supporters,
  CASE WHEN condition = 'other_condition' THEN NULL WHEN condition = 'mixed_label_conflict' THEN 0.6e0 ELSE 1e0 END
    AS wrong_support_ratio,
  CASE WHEN condition = 'other_condition' THEN NULL WHEN condition = 'mixed_label_conflict' THEN 0.4e0 ELSE 0e0 END
    AS correct_support_ratio,
  condition IN ('labelled_5_wrong', 'mixed_label_conflict') AS has_explicit_model_labels
FROM label_rows""", ("label_rows",))
def _(spark, folder):
    return N.support_ratios(view(spark, folder, "label_rows").select("item_id", "condition"))


@query("empty_value", """
SELECT count(*) AS rows, count(*) FILTER (WHERE raw_output IS NULL OR trim(raw_output) = '') AS blank_text,
  count(*) FILTER (WHERE final_answer IS NULL) AS null_answer, count(*) FILTER (WHERE error IS NULL) AS no_list,
  count(*) FILTER (WHERE k % 4 = 0) AS empty_json
FROM label_rows""", ("label_rows",))
def _(spark, folder):
    rows = view(spark, folder, "label_rows").withColumns({
        "words": F.filter(F.array("error"), lambda e: e.isNotNull()),
        "v": F.try_parse_json(
            F.when(F.col("k") % 4 == 0, F.lit("[]")).when(F.col("k") % 4 == 1, F.lit('"[]"')).otherwise(F.lit('{"a": 1}'))
        ),
    })
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(L.empty_text(F.col("raw_output"))).alias("blank_text"),
        F.count_if(L.empty_text(F.col("final_answer"))).alias("null_answer"),
        F.count_if(L.empty_container(F.col("words"))).alias("no_list"),
        F.count_if(L.empty_json(F.col("v"))).alias("empty_json"),
    )


# --- integrity ----------------------------------------------------------------------------------------------

def _blank_sql(x: str) -> str:
    """Null, blank text or an empty container; the text "[]" is neither. Reads the JSON form of the column."""
    return f"({x}_j IS NULL OR {x}_j IN ('null', '[]', '{{}}') OR trim({x}_j, '\" ') = '')"


_FACTS = f"""facts AS (
  SELECT file, line_number, value, trim(value) = '' AS blank, json_valid(value) AS ok,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.final_answer') END AS fin,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_FINAL_KEYS)} END AS fin_alias,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.raw_output') END AS raw,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_RAW_KEYS)} END AS raw_alias,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.option_logprobs') END AS lp,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_LOGPROB_KEYS)} END AS lp_alias,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_FINAL_KEYS, True)}::VARCHAR END AS fin_alias_j,
    CASE WHEN json_valid(value) THEN json_extract(value, '$.raw_output')::VARCHAR END AS raw_j,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_RAW_KEYS, True)}::VARCHAR END AS raw_alias_j,
    CASE WHEN json_valid(value) THEN json_extract(value, '$.option_logprobs')::VARCHAR END AS lp_j,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_LOGPROB_KEYS, True)}::VARCHAR END AS lp_alias_j,
    CASE WHEN json_valid(value) THEN {first_sql(K.INTEGRITY_ID_KEYS)} END AS item_id,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.experiment_mode') END AS mode,
    json_valid(value) AND coalesce(json_type(CASE WHEN json_valid(value) THEN value END, '$.is_error') = 'BOOLEAN'
      AND json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.is_error') = 'true', false) AS err
  FROM lines)"""


INTEGRITY_PROFILE = f"""WITH {_FACTS}
SELECT file, count(*) AS total_lines, count(*) FILTER (WHERE blank) AS empty_lines, count(*) FILTER (WHERE ok) AS json_ok,
  count(*) FILTER (WHERE NOT ok AND NOT blank) AS json_failed, count(*) FILTER (WHERE err) AS is_error_true,
  count(*) FILTER (WHERE ok AND fin IS NULL) AS final_answer_null,
  count(*) FILTER (WHERE ok AND trim(fin) = '') AS final_answer_empty,
  count(*) FILTER (WHERE ok AND trim(fin) <> '') AS final_answer_valid,
  count(*) FILTER (WHERE ok AND fin_alias IS NULL) AS analysis_final_null,
  count(*) FILTER (WHERE ok AND trim(fin_alias) = '') AS analysis_final_empty,
  count(*) FILTER (WHERE ok AND trim(fin_alias) <> '') AS analysis_final_valid,
  count(*) FILTER (WHERE ok AND {_blank_sql('raw')}) AS raw_output_empty,
  count(*) FILTER (WHERE ok AND NOT {_blank_sql('raw')}) AS raw_output_nonempty,
  count(*) FILTER (WHERE ok AND {_blank_sql('raw_alias')}) AS analysis_raw_output_empty,
  count(*) FILTER (WHERE ok AND NOT {_blank_sql('raw_alias')}) AS analysis_raw_output_nonempty,
  count(*) FILTER (WHERE ok AND {_blank_sql('lp')}) AS option_logprobs_empty,
  count(*) FILTER (WHERE ok AND NOT {_blank_sql('lp')}) AS option_logprobs_nonempty,
  count(*) FILTER (WHERE ok AND {_blank_sql('lp_alias')}) AS analysis_option_logprobs_empty,
  count(*) FILTER (WHERE ok AND NOT {_blank_sql('lp_alias')}) AS analysis_option_logprobs_nonempty,
  count(*) FILTER (WHERE ok AND item_id IS NULL) AS item_id_missing, count(DISTINCT item_id) AS unique_item_ids,
  count(item_id) - count(DISTINCT item_id) AS item_id_duplicates,
  count(*) FILTER (WHERE ok AND NOT err AND NOT {_blank_sql('fin_alias')}) AS effective_samples
FROM facts GROUP BY file"""


@query("integrity_profile", INTEGRITY_PROFILE, ("lines",))
def _(spark, folder):
    return A.integrity_profile(view(spark, folder, "lines").select("file", "value"))


INTEGRITY_MODES = f"""WITH {_FACTS}
SELECT file, mode AS experiment_mode, count(*) AS rows FROM facts WHERE mode <> '' GROUP BY ALL"""


@query("integrity_mode_counts", INTEGRITY_MODES, ("lines",))
def _(spark, folder):
    return A.integrity_mode_counts(view(spark, folder, "lines").select("file", "value"))


@query("integrity_bad_lines", """
SELECT file, line_number, 'malformed JSON: cut off' AS error, length(value) AS length, left(value, 500) AS first_chars,
  right(value, 500) AS last_chars FROM lines WHERE trim(value) <> '' AND NOT json_valid(value)""", ("lines",))
def _(spark, folder):
    return A.integrity_bad_lines(view(spark, folder, "lines").select("file", "line_number", "value"))


@query("integrity_ineffective", f"""WITH {_FACTS}
SELECT file, line_number, item_id, err AS is_error, fin_alias AS analysis_final FROM facts
WHERE ok AND (err OR {_blank_sql('fin_alias')})""", ("lines",))
def _(spark, folder):
    return A.integrity_ineffective(view(spark, folder, "lines").select("file", "line_number", "value"))


@query("dup_ids", """
SELECT l_orderkey, l_linenumber, count(*) AS rows, count(*) - 1 AS extra_rows FROM lineitem GROUP BY ALL
HAVING count(*) > 1""")
def _(spark, folder):
    return A.dup_ids(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- label quality ------------------------------------------------------------------------------------------

QUALITY = f"""WITH {LABEL_ANSWERED},
checks AS (
  SELECT CASE WHEN condition = 'other_condition' THEN 'rows (unknown condition): ' ELSE 'rows: ' END || condition AS "check"
    FROM answered
  UNION ALL SELECT 'error' FROM answered WHERE is_error OR error IS NOT NULL
  UNION ALL SELECT 'final_empty' FROM answered WHERE recorded IS NULL
  UNION ALL SELECT 'raw_empty' FROM answered WHERE trim(raw_output) = ''
  UNION ALL SELECT 'option_logprobs_empty' FROM answered WHERE lp_correct IS NULL AND lp_distractor IS NULL
  UNION ALL SELECT 'valid' FROM answered WHERE answer IS NOT NULL
  UNION ALL SELECT 'total' FROM answered)
SELECT "check", count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM answered), 6) AS rate
FROM checks GROUP BY ALL"""


@query("quality_summary", QUALITY, ("label_rows",))
def _(spark, folder):
    return rounded(A.quality_summary(label_answers(spark, folder)))


@query("first_keys", """
SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events ORDER BY event_id LIMIT 1""")
def _(spark, folder):
    found = A.first_keys(table(spark, folder, "events"), "props", "event_id")
    return found.select(F.array_join("keys", ",").alias("keys"))


@query("error_top", """
SELECT coalesce(error_type, 'UNKNOWN') || ': ' || CASE WHEN length(s) <= 120 THEN s ELSE left(s, 117) || '...' END
  AS error_key, count(*) AS rows
FROM (SELECT *, trim(regexp_replace(coalesce(error, ''), '\\s+', ' ', 'g')) AS s FROM label_rows)
WHERE is_error OR error IS NOT NULL GROUP BY 1 ORDER BY rows DESC, min(k) LIMIT 5""", ("label_rows",))
def _(spark, folder):
    return A.error_top(view(spark, folder, "label_rows"), "k")


# --- agreement ----------------------------------------------------------------------------------------------

_DRIFTED = """drifted AS (
  SELECT dataset, model, id, k, n, distractor, initial,
    CASE WHEN k % 37 = 5 AND n = 3 THEN 'E' ELSE correct END AS correct,
    CASE WHEN k % 41 = 6 AND n = 2 THEN NULL ELSE question END AS question,
    CASE WHEN k % 43 = 7 AND n = 4 THEN 'changed' ELSE 'text' END AS option_b FROM responses)"""


@query("metadata_drift", f"""WITH {_DRIFTED},
grouped AS (SELECT dataset, model, id, count(*) AS rows,
  count(DISTINCT coalesce(question, '~')) > 1 AS q, count(DISTINCT option_b) > 1 AS o,
  count(DISTINCT correct) > 1 AS c FROM drifted GROUP BY ALL)
SELECT dataset, model, id, rows, concat_ws(',', CASE WHEN q THEN 'question' END, CASE WHEN o THEN 'options' END,
  CASE WHEN c THEN 'correct' END) AS fields FROM grouped WHERE q OR o OR c""", ("responses",))
def _(spark, folder):
    k, n = F.col("k"), F.col("n")
    b = F.when((k % 43 == 7) & (n == 4), "changed").otherwise("text")
    rows = view(spark, folder, "responses").withColumns({
        "correct": F.when((k % 37 == 5) & (n == 3), "E").otherwise(F.col("correct")),
        "question": F.when(~((k % 41 == 6) & (n == 2)), F.col("question")),
        # The option order differs between conditions and must not count as drift.
        "options": F.when(n % 2 == 0, F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), b)).otherwise(
            F.create_map(F.lit("B"), b, F.lit("A"), F.lit("x"))),
    })
    return A.metadata_drift(rows)


@query("reference_drift", """WITH bank AS (
  SELECT id, correct, CASE WHEN k % 60 = 11 THEN 'other' ELSE question END AS question FROM responses
  WHERE n = 1 AND k % 50 <> 9)
SELECT r.id, r.condition, CASE WHEN b.id IS NULL THEN 'absent' ELSE 'question' END AS reason
FROM responses r LEFT JOIN bank b ON b.id = r.id WHERE b.id IS NULL OR b.question <> r.question""", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses").select("id", "condition", "question", "correct", "k", "n")
    bank = rows.where("n = 1 AND k % 50 <> 9").withColumn(
        "question", F.when(F.col("k") % 60 == 11, "other").otherwise(F.col("question"))
    )
    found = A.reference_drift(rows, bank.select("id", "question", "correct"), ["question", "correct"])
    return found.select("id", "condition", "reason")


@query("reference_answers", """
SELECT id, CASE WHEN k % 55 = 6 THEN NULL ELSE initial END AS parsed_answer,
  CASE WHEN k % 55 = 6 THEN 'empty text' WHEN k % 45 = 4 AND initial <> 'E' THEN 'answer mismatch' END AS problem
FROM responses WHERE n = 1""", ("responses",))
def _(spark, folder):
    k = F.col("k")
    rows = view(spark, folder, "responses").where("n = 1").withColumns({
        "raw_initial_output": F.when(k % 55 == 6, F.lit("  ")).otherwise(
            F.concat(F.lit("ANSWER: "), F.col("initial"), F.lit("\nCONFIDENCE: 90"))),
        "initial": F.when(k % 45 == 4, "E").otherwise(F.col("initial")),
    })
    return A.reference_answers(rows).select("id", "parsed_answer", "problem")


def score_table(spark, folder):
    rows = view(spark, folder, "score_rows")
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    return rows.withColumns({
        "candidate_labels": labels,
        "probabilities": F.map_from_arrays(labels, F.array("prob_a", "prob_b", "prob_c", "prob_d")),
    })


@query("score_validate", """
SELECT id, CASE WHEN k % 70 = 8 THEN 'probability' ELSE 'sum' END AS problem FROM score_rows
WHERE k % 70 = 8 OR k % 80 = 9""", ("score_rows",))
def _(spark, folder):
    k = F.col("k")
    rows = score_table(spark, folder).withColumns({
        "target_probability": F.when(k % 70 == 8, F.lit(1.5)).otherwise(F.col("target_probability")),
        "probabilities": F.when(
            k % 80 == 9, F.transform_values("probabilities", lambda _, p: p + 0.1)).otherwise(F.col("probabilities")),
    })
    return A.score_validate(rows).select("id", "problem")


@query("score_metadata_match", f"""WITH {NORMAL},
c AS (SELECT dataset, model, id, max(k) AS k FROM normal GROUP BY ALL HAVING count(*) FILTER (WHERE valid) = 4)
SELECT dataset, model, id, CASE WHEN k % 44 = 3 THEN 'missing score' ELSE 'correct' END AS problem FROM c
WHERE k % 44 = 3 OR k % 33 = 2""", ("responses",))
def _(spark, folder):
    rows = responses(spark, folder)
    keys = ["dataset", "model", "id"]
    first = rows.where("n = 1").select(*keys, "correct", "distractor")
    items = P.common_valid_items(rows, K.FOUR_PROTOCOLS).join(first, keys)
    k = F.col("k")
    scores = view(spark, folder, "score_rows").where("k % 44 <> 3").withColumn(
        "correct_answer", F.when(k % 33 == 2, "E").otherwise(F.lower("correct_answer"))
    )
    return A.score_metadata_match(items, scores, keys)


def step_table(spark, folder):
    """Responses with their five-step arrays."""
    k, c, n = F.col("k"), F.col("c"), F.col("n")

    # Each stage is a projection of its own: in one expression they would make a method too long for the JIT compiler.
    numbers, labels = range(1, 6), ("initial", "correct", "distractor")
    drawn = responses(spark, folder).withColumns({f"_g{i}": (17 * k + 7 * c + 211 * n + 37 * i) % 100 for i in numbers})

    def answered(i: int):
        g, (initial, correct, distractor) = F.col(f"_g{i}"), map(F.col, labels)
        return F.when(g < 30 + 5 * i, distractor).when(g < 85, initial).when(g < 95, correct)

    def one(i: int):
        g, said = F.col(f"_g{i}"), F.col(f"_said{i}")
        confidence = ((g + i) % 101).cast("int")
        text = F.concat(
            F.lit("ANSWER: "), F.coalesce(said, F.lit("none")), F.lit("\nCONFIDENCE: "), confidence.cast("string")
        )
        lp = F.when(g % 3 > 0, (-g).cast("double") / 10)
        return F.struct(
            F.lit(i).alias("iteration"), said.alias("prediction"), confidence.alias("confidence"), text.alias("text"),
            F.create_map(F.lit("A"), lp).alias("option_logprobs"),
        )

    said = drawn.withColumns({f"_said{i}": answered(i) for i in numbers})
    own = [x for x in drawn.columns if not x.startswith("_g")]
    # One generated row holds the array, so that it is built once however often its members are read.
    steps = F.explode(F.array(F.array(*[one(i) for i in numbers]))).alias("steps")
    return said.select(*own, steps)


@query("final_step_audit", """WITH last AS (SELECT * FROM steprows WHERE step = 5)
SELECT id, condition, CASE WHEN k % 45 = 2 THEN 'length 4' WHEN k % 55 = 3 THEN 'last iteration' ELSE 'mismatch' END
  AS problem
FROM last WHERE k % 45 = 2 OR k % 55 = 3 OR (k % 35 = 1 AND prediction IS NOT NULL)""", ("steprows",))
def _(spark, folder):
    k = F.col("k")
    rows = step_table(spark, folder)
    shifted = F.transform("steps", lambda s: s.withField("iteration", s["iteration"] - 1))
    rows = rows.withColumns({
        "final": F.when(k % 35 != 1, F.col("steps")[4]["prediction"]),
        "steps": F.when(k % 45 == 2, F.slice("steps", 1, 4)).when(k % 55 == 3, shifted).otherwise(F.col("steps")),
    })
    return A.final_step_audit(rows).select("id", "condition", "problem")


@query("peer_signal_audit", """
SELECT id, CASE WHEN k % 30 = 1 THEN 'opinions' WHEN k % 40 = 2 THEN 'peer order' WHEN k % 50 = 3 THEN 'provenance'
  ELSE 'initial answer' END AS problem
FROM responses WHERE n = 1 AND (k % 30 = 1 OR k % 40 = 2 OR k % 50 = 3 OR k % 70 = 4)""", ("responses",))
def _(spark, folder):
    k = F.col("k")
    rows = view(spark, folder, "responses").where("n = 1").withColumns({
        "agent_opinions": F.array_repeat(F.col("distractor"), F.when(k % 30 == 1, 4).otherwise(5)),
        "peer_order": F.sequence(F.lit(1), F.when(k % 40 == 2, 6).otherwise(5)),
        "initial_answer_source": F.when(k % 50 == 3, "model_call").otherwise("reference_jsonl"),
        "initial": F.when(k % 70 != 4, F.col("initial")),
    })
    return A.peer_signal_audit(rows).select("id", "problem")


_DEVIATES = "k % 12 IN (1, 2, 3, 5, 6)"


# Recorded messages lack a peer, have two swapped, one reworded, one with another role or one too many.
@query("peer_message_audit", f"""
SELECT id, CASE k % 12 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 5 THEN 7 ELSE 10 END::INT AS position,
  CASE k % 12 WHEN 1 THEN 'missing' WHEN 2 THEN 'swapped' WHEN 3 THEN 'reworded' WHEN 5 THEN 'role' ELSE 'added' END AS problem
FROM responses WHERE n = 1 AND {_DEVIATES}""", ("responses",))
def _(spark, folder):
    kind = F.col("k") % 12
    start = F.array(M.message("system", F.lit("s")), M.message("user", F.col("question")))
    ctx = M.context(start, F.concat(F.lit("ANSWER: "), F.coalesce("initial", F.lit("none"))))
    expected = M.sequential_rationale(ctx, F.array_repeat(F.col("distractor"), K.PEERS))
    rows = view(spark, folder, "responses").where("n = 1").withColumn("built", expected)
    at = lambda i: F.array(F.col("built")[i - 1])
    other = M.message("user", F.concat(F.col("built")[3]["content"], F.lit("!")))
    cut = lambda a, b: F.slice("built", a, b - a + 1)
    recorded = (
        F.when(kind == 1, F.concat(cut(1, 5), cut(7, 9)))
        .when(kind == 2, F.concat(cut(1, 4), at(6), at(5), cut(7, 9)))
        .when(kind == 3, F.concat(cut(1, 3), F.array(other), cut(5, 9)))
        .when(kind == 5, F.concat(cut(1, 6), F.array(M.message("assistant", F.col("built")[6]["content"])), cut(8, 9)))
        .when(kind == 6, F.concat("built", F.array(other))).otherwise(F.col("built"))
    )
    audited = A.message_audit(rows.withColumn("recorded", recorded), "recorded", F.col("built"))
    return audited.select("id", "position", "problem")


@query("identity_audit", """
SELECT dataset, count(*) AS rows, count(*) FILTER (WHERE k % 25 = 4) AS failures FROM responses WHERE n = 1
GROUP BY dataset""", ("responses",))
def _(spark, folder):
    start = F.array(M.message("user", F.col("question")))
    ctx = M.context(start, F.concat(F.lit("ANSWER: "), F.col("initial")))
    opinions = F.array_repeat(F.col("distractor"), 5)
    leaked = F.when(F.col("k") % 25 == 4, "answer").otherwise("none")
    with_history = M.stepwise(
        ctx, opinions, 5, "answer", F.array_repeat(F.lit("x"), 4), F.array_repeat(F.col("initial"), 4)
    )
    rows = view(spark, folder, "responses").where("n = 1").withColumns({
        "one": F.when(leaked == "answer", with_history).otherwise(M.stepwise(ctx, opinions, 5, "none")),
        "other": M.sequential_final(ctx, opinions),
    })
    return A.identity_audit(rows, "one", "other", ["dataset"])


@query("row_count_guard", "SELECT count(*) AS rows FROM responses WHERE n = 1", ("responses",))
def _(spark, folder):
    expected = table(spark, folder, "orders").count()
    return G.row_count_guard(view(spark, folder, "responses").where("n = 1"), expected, "items")


@query("dimension_filter", """
SELECT dimension, input_mode, count(*) AS rows FROM mechanisms
WHERE dimension = 'input_mode_comparison' AND input_mode = 'single_input' GROUP BY ALL""", ("mechanisms",))
def _(spark, folder):
    rows = view(spark, folder, "mechanisms")
    rows = T.dimension_filter(rows, "dimension", ["input_mode_comparison", "bogus"], ["input_mode_comparison"])
    rows = T.dimension_filter(rows, "dimension", ["bogus"], ["input_mode_comparison"])
    rows = T.dimension_filter(rows, "input_mode", ["single_input"], K.INPUT_MODES)
    return rows.groupBy("dimension", "input_mode").agg(F.count(F.lit(1)).alias("rows"))


@query("opinion_answer", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN upper(left(event_type, 1)) WHEN 1 THEN event_type END AS answer
FROM events""")
def _(spark, folder):
    i = F.col("event_id") % 3
    text = (
        F.when(i == 0, F.concat(F.lit('"'), F.upper(F.left("event_type", F.lit(1))), F.lit('"')))
        .when(i == 1, F.concat(F.lit('{"answer": "'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.col("props"))
    )
    rows = table(spark, folder, "events").withColumn("v", F.try_parse_json(text))
    return rows.select("event_id", L.opinion_answer(F.col("v")).alias("answer"))


@query("limit_slice", """
SELECT id, question FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos FROM responses WHERE n = 1)
WHERE pos >= 100 AND pos < 600""", ("responses",))
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").withColumn("at", F.col("k") * 7 + 3)  # far from dense
    return T.limit_slice(items, "at", start=100, limit=500).select("id", "question")


