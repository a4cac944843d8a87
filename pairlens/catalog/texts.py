"""Answer, confidence, log-prob and similarity functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog.common import rounded
from pairlens.catalog.rates import PROFILED, label_answers, text_profiles
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.functions import labels as L
from pairlens.functions import logprobs as LP
from pairlens.functions import messages as M
from pairlens.functions import parsing as P
from pairlens.functions import similarity as S
from pairlens.operators import items as T
from pairlens.plans import reports as RP

OPTION_TEXTS = {"A": "red stone", "B": "blue gem", "C": "green leaf", "D": "old coin"}
# One raw text per answer form; {X} is the label, {T} its option text. Then the method and offsets it must give.
FORMS = (
    ("ANSWER: {X}\nCONFIDENCE: 87", "answer_phrase", "ANSWER: {X}", 0),
    ('{{"answer": "{X}", "confidence": 5}}', "json_answer_key", '"answer": "{X}"', 1),
    ("Thinking.\nThe final answer is ({X}).", "final_answer_phrase", "final answer is ({X})", 4),
    ("The correct answer is {X}", "correct_answer_phrase", "The correct answer is {X}", 0),
    ("my answer is [{X}]", "my_answer_phrase", "my answer is [{X}]", 0),
    ("I think option {X}", "option_phrase", "option {X}", 8),
    ("my choice: {X}", "choice_phrase", "choice: {X}", 3),
    ("I choose {X} because", "i_choose_phrase", "I choose {X} ", 0),
    ("答案是 {X}", "zh_answer_phrase", "答案是 {X}", 0),
    ("我选{X}", "zh_choose_phrase", "我选{X}", 0),
    ("> **{X}**.", "standalone_line", "> {X}.", 0),
    ("It is (the) {T}!", "option_text_match", "{T}", None),
    ("maybe {X}?", "fallback_single_token", "{X}", 6),
    ("the answer depends", "answer_phrase", "answer d", 4),
)


def _sql_text(text: str) -> str:
    cases = "CASE initial " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPTION_TEXTS.items()) + " END"
    filled = text.replace("{{", "{").replace("}}", "}").replace("'", "''")
    return ("'" + filled.replace("{X}", "' || initial || '").replace("{T}", f"' || {cases} || '") + "'")


def _form_case(field) -> str:
    return f"CASE k % {len(FORMS)} " + " ".join(f"WHEN {i} THEN {field(f)}" for i, f in enumerate(FORMS)) + " END"


RAW_TEXTS = f"""raw_texts AS (
  SELECT *, {_form_case(lambda f: _sql_text(f[0]))} AS text, {_form_case(lambda f: f"'{f[1]}'")} AS method,
    {_form_case(lambda f: _sql_text(f[2]))} AS matched,
    {_form_case(lambda f: 'NULL' if f[3] is None else str(f[3]))} AS start,
    CASE WHEN k % {len(FORMS)} = {len(FORMS) - 1} THEN 'D' ELSE initial END AS said FROM responses)"""


def raw_texts(spark, folder):
    """Responses with a raw output text in one of the forms and the option map."""
    x = F.col("initial")
    option = None
    for label, text in OPTION_TEXTS.items():
        option = (F if option is None else option).when(x == label, F.lit(text))
    text = None
    for i, (form, *_) in enumerate(FORMS):
        plain = form.replace("{{", "{").replace("}}", "}")
        filled = F.replace(F.replace(F.lit(plain), F.lit("{X}"), x), F.lit("{T}"), option)
        hit = F.col("k") % len(FORMS) == i
        text = (F if text is None else text).when(hit, filled)
    options = F.create_map(*[F.lit(v) for pair in OPTION_TEXTS.items() for v in pair])
    return view(spark, folder, "responses").withColumns({"text": text, "options": options})


@query("answer_extract", f"""WITH {RAW_TEXTS}
SELECT id, condition, said AS answer, 'success' AS parse_status, method AS parse_method, matched AS matched_text,
  start::INT AS span_start, (start + length(matched))::INT AS span_end,
  CASE WHEN k % {len(FORMS)} = 0 THEN 87 END::INT AS confidence FROM raw_texts""", ("responses",))
def _(spark, folder):
    rows = P.with_answers(raw_texts(spark, folder), "text", "options")
    return rows.select("id", "condition", "answer", "parse_status", "parse_method", "matched_text", "span_start",
                       "span_end", "confidence")


# The same over whole natural texts; the patterns need look-behind, which the SQL side lacks. Tested by brute force.
@query("answer_extract_documents")
def _(spark, folder):
    rows = P.with_answers(table(spark, folder, "documents", spread=True), "text")
    return rows.groupBy("lang", "parse_status", "parse_method", "answer").agg(F.count(F.lit(1)).alias("rows"))


@query("parse_answer_strict", f"""WITH {RAW_TEXTS}
SELECT id, condition, CASE WHEN k % {len(FORMS)} NOT IN (11, {len(FORMS) - 1}) THEN initial END AS answer
FROM raw_texts""", ("responses",))
def _(spark, folder):
    rows = P.with_answers(raw_texts(spark, folder), "text", strict=True)
    return rows.select("id", "condition", "answer")


_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233) || chr(12288))"
_CLEAN = ("translate(" + _TRIM.format(
    "regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(65279), ''), '```(?:[\\w.+-]+)?|```', '', 'g')"
) + ", '*_`~', '')")


@query("text_clean", f"SELECT doc_id, length({_CLEAN}) AS characters, md5({_CLEAN}) AS digest FROM documents")
def _(spark, folder):
    clean = P.text_clean(F.col("text"))
    return table(spark, folder, "documents", spread=True).select(
        "doc_id", F.char_length(clean).cast("bigint").alias("characters"), F.md5(clean).alias("digest")
    )


@query("segments", f"""WITH cleaned AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
parts AS (SELECT doc_id, t,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ls,
  list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])[\\s\\x{{A0}}\\x{{3000}}]+', '\\1' || chr(1), 'g'),
    chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ss FROM cleaned),
cut AS (SELECT doc_id, t, ls[greatest(len(ls) - 4, 1):] AS ll, ss[greatest(len(ss) - 2, 1):] AS sl FROM parts),
listed AS (SELECT doc_id, list_filter(list_concat(list_reverse(ll),
  CASE WHEN len(ll) >= 5 THEN [array_to_string(ll, chr(10))] ELSE [] END,
  CASE WHEN len(ll) >= 4 THEN [array_to_string(ll[len(ll) - 3:], chr(10))] ELSE [] END,
  CASE WHEN len(ll) >= 3 THEN [array_to_string(ll[len(ll) - 2:], chr(10))] ELSE [] END,
  CASE WHEN len(ll) >= 2 THEN [array_to_string(ll[len(ll) - 1:], chr(10))] ELSE [] END,
  list_reverse(sl), [{_TRIM.format('t')}]), lambda x: x <> '') AS segs FROM cut)
SELECT doc_id, len(list_distinct(segs))::INT AS segments,
  md5(array_to_string(list_sort(list_transform(list_distinct(segs), lambda x: md5(x))), ',')) AS digest,
  segs[1] AS first_segment FROM listed""")
def _(spark, folder):
    rows = table(spark, folder, "documents", spread=True).withColumn("s", P.segments(F.col("text")))
    return rows.select(
        "doc_id", F.size("s").alias("segments"),
        F.md5(F.array_join(F.array_sort(F.transform("s", lambda x: F.md5(x))), ",")).alias("digest"),
        F.get("s", F.lit(0)).alias("first_segment"),
    )


@query("confidence_extract", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(CAST(json_extract_string(props, '$.k') AS INT) * 2, 100)
  WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS INT) WHEN 2 THEN 100 END AS confidence FROM events""")
def _(spark, folder):
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id") % 4
    text = (
        F.when(i == 0, F.concat(F.lit("Confidence: "), (k.cast("int") * 2).cast("string")))
        .when(i == 1, F.concat(F.lit("ANSWER: B\nCONFIDENCE:\n "), k, F.lit("%")))
        .when(i == 2, F.lit("confidence: 9999")).otherwise(F.lit("CONFIDENCE high"))
    )
    return table(spark, folder, "events").select("event_id", P.confidence_extract(text).alias("confidence"))


@query("raw_answer_fallback", f"""WITH {RAW_TEXTS}
SELECT id, condition, coalesce(nullif(upper(regexp_extract(text, '(?i)\\bANSWER\\s*:\\s*([A-E])\\b', 1)), ''),
  CASE WHEN k % {len(FORMS)} <> 9 THEN nullif(regexp_extract(upper(text), '\\b([A-E])\\b', 1), '') END) AS answer
FROM raw_texts""", ("responses",))
def _(spark, folder):
    # Form 9 has a Chinese word directly before the label: no word boundary there in Unicode.
    return raw_texts(spark, folder).select("id", "condition", P.raw_answer_fallback(F.col("text")).alias("answer"))


@query("json_block", """
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') WHEN event_id % 5 = 3 THEN '-1' END AS k
FROM events""")
def _(spark, folder):
    i, props = F.col("event_id") % 5, F.col("props")
    text = (
        F.when(i == 0, props).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n``` done")))
        .when(i == 2, F.concat(F.lit("  "), props, F.lit("\n"))).when(i == 3, F.lit("{broken")).otherwise(F.lit("{} "))
    )
    block = P.json_block(text, '{"k": -1}')
    return table(spark, folder, "events").select("event_id", F.try_variant_get(block, "$.k", "string").alias("k"))


@query("clamp_score", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5e0 ELSE round(least(greatest(value / 40 - 0.2, 0), 1), 6) END AS score
FROM events""")
def _(spark, folder):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise((F.col("value") / 40 - 0.2).cast("string"))
    return table(spark, folder, "events").select("event_id", F.round(P.clamp_score(text, 0.5), 6).alias("score"))


@query("clamp_confidence", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7
  ELSE CAST(least(greatest(round_even(value * 2, 0), 0), 100) AS INT) END AS confidence FROM events""")
def _(spark, folder):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("high")).otherwise((F.col("value") * 2).cast("string"))
    return table(spark, folder, "events").select("event_id", P.clamp_confidence(text, 7).alias("confidence"))


# --- log-probabilities --------------------------------------------------------------------------------------

def _lp(a: int, b: int):
    return (-((F.col("k") * a + b) % 1000)).cast("double") / 100


def _lp_sql(a: int, b: int) -> str:
    return f"(-((k * {a} + {b}) % 1000)::DOUBLE / 100)"


def _entry(token, value):
    return F.struct(token.alias("token"), value.alias("logprob"))


def _top():
    """Alternatives: a null first value for B, lower case and blanks, a repeat that must lose, an unknown token."""
    return F.array(
        _entry(F.lit(" a"), _lp(7, 1)), _entry(F.lit("B"), F.lit(None).cast("double")),
        _entry(F.lit("b\n"), _lp(11, 2)), _entry(F.lit("A"), _lp(13, 3)), _entry(F.lit("the"), _lp(17, 4)),
        _entry(F.lit("C"), F.when(F.col("k") % 2 == 0, _lp(19, 5))),
    )


@query("top_logprob_map", f"""
SELECT id, {_lp_sql(7, 1)} AS a, {_lp_sql(11, 2)} AS b, CASE WHEN k % 2 = 0 THEN {_lp_sql(19, 5)} END AS c,
  NULL::DOUBLE AS d, round(exp({_lp_sql(7, 1)}), 9) AS pa, CASE WHEN k % 2 = 0 THEN round(exp({_lp_sql(19, 5)}), 9)
  ELSE 0e0 END AS pc
FROM responses WHERE n = 1""", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses").where("n = 1").withColumn("m", LP.top_logprob_map(_top()))
    p = LP.probability_map(F.col("m"))
    return rows.select(
        "id", *[F.col("m")[x].alias(x.lower()) for x in "ABCD"],
        F.round(p["A"], 9).alias("pa"), F.round(p["C"], 9).alias("pc"),
    )


@query("answer_token_logprob", f"""
SELECT id, CASE WHEN initial <> 'D' THEN {_lp_sql(23, 6)} END AS selected, CASE WHEN initial <> 'D'
  THEN {_lp_sql(7, 1)} END AS a
FROM responses WHERE n = 1""", ("responses",))
def _(spark, folder):
    def token(text, value):
        return F.struct(text.alias("token"), value.alias("logprob"), _top().alias("top_logprobs"))

    answer = F.when(F.col("initial") != "D", F.col("initial"))
    said = F.array(
        token(F.lit("ANSWER"), _lp(3, 1)), token(F.lit(":"), _lp(3, 2)),
        token(F.concat(F.lit(" "), F.lower("initial")), _lp(23, 6)), token(F.col("initial"), _lp(29, 7)),
    )
    rows = view(spark, folder, "responses").where("n = 1").withColumn("t", LP.answer_token(said, answer))
    return rows.select(
        "id", F.col("t.logprob").alias("selected"),
        F.when(F.col("t").isNotNull(), LP.top_logprob_map(F.col("t.top_logprobs"))["A"]).alias("a"),
    )


@query("raw_logprobs", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS logprobs FROM events""")
def _(spark, folder):
    i = F.col("event_id") % 3
    raw = (
        F.when(i == 0, F.concat(F.lit('{"choices": [{"logprobs": '), F.col("props"), F.lit("}, {}]}")))
        .when(i == 1, F.lit('{"choices": []}')).otherwise(F.lit("{}"))
    )
    found = LP.raw_logprobs(F.try_parse_json(raw))
    k = F.try_variant_get(found, "$.k", "string")
    return table(spark, folder, "events").select(
        "event_id", F.when(k.isNotNull(), F.concat(F.lit('{"k": '), k, F.lit("}"))).alias("logprobs")
    )


@query("option_logprob", """
SELECT item_id, lp_correct AS correct_lp, lp_distractor AS distractor_lp FROM label_rows""", ("label_rows",))
def _(spark, folder):
    return label_answers(spark, folder).select("item_id", "correct_lp", "distractor_lp")


@query("margin", """
SELECT item_id, round(lp_distractor - lp_correct, 6) AS margin FROM label_rows""", ("label_rows",))
def _(spark, folder):
    gap = LP.margin(F.col("option_logprobs"), F.col("distractor"), F.col("correct"))
    return label_answers(spark, folder).select("item_id", F.round(gap, 6).alias("margin"))


@query("softmax", """WITH logs AS (
  SELECT id, [ln(prob_a) + 50, ln(prob_b) + 50, ln(prob_c) + 50, ln(prob_d) + 50] AS s FROM score_rows)
SELECT id, round(exp(s[1] - list_max(s)) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS pa,
  round(exp(s[4] - list_max(s)) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS pd FROM logs""",
       ("score_rows",))
def _(spark, folder):
    logits = F.array(*[F.ln(f"prob_{x}") + 50 for x in "abcd"])
    rows = view(spark, folder, "score_rows").withColumn("p", LP.softmax(logits))
    return rows.select("id", F.round(F.col("p")[0], 6).alias("pa"), F.round(F.col("p")[3], 6).alias("pd"))


@query("option_set_check", """
SELECT id, CASE k % 6 WHEN 0 THEN 'labels' WHEN 1 THEN 'correct absent' WHEN 2 THEN 'target absent'
  WHEN 3 THEN 'correct equals target' END AS problem FROM responses WHERE n = 1""", ("responses",))
def _(spark, folder):
    k = F.col("k") % 6
    labels = F.when(k == 0, F.array(*[F.lit(x) for x in "BACD"])).when(
        k == 4, F.array(*[F.lit(x) for x in ("a", "B ", "C", "D", "E")])
    ).otherwise(F.array(*[F.lit(x) for x in "ABCD"]))
    correct = F.when(k == 1, "E").otherwise(F.col("correct"))
    target = F.when(k == 2, "E").when(k == 3, F.lower("correct")).otherwise(F.col("distractor"))
    return view(spark, folder, "responses").where("n = 1").select(
        "id", T.option_set_problem(labels, correct, target).alias("problem")
    )


# --- similarity ---------------------------------------------------------------------------------------------

@query("token_set", """
SELECT doc_id, len(t)::INT AS tokens, len(list_distinct(t))::INT AS distinct_tokens,
  md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)""")
def _(spark, folder):
    rows = table(spark, folder, "documents", spread=True).withColumn("t", S.tokens(F.col("text")))
    return rows.select(
        "doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"),
        F.md5(F.array_join(F.array_sort(F.array_distinct("t")), " ")).alias("digest"),
    )


@query("jaccard", """WITH t AS (
  SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1e0
  ELSE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS similarity
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(spark, folder):
    docs = table(spark, folder, "documents", spread=True).select("doc_id", S.token_set(F.col("text")).alias("s"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2"))
    return docs.join(after, "doc_id").select(
        "doc_id", F.round(S.jaccard(F.col("s"), F.col("s2")), 6).alias("similarity")
    )


@query("sequence_ratio")
def _(spark, folder):
    pairs = view(spark, folder, "textpairs").select("correct_text", "target_text").distinct()
    return rounded(pairs.withColumn("ratio", S.sequence_ratio(F.col("correct_text"), F.col("target_text"))))


@query("antonym_signal", f"WITH {PROFILED} SELECT id, antonym_signal FROM profiled", ("textpairs",))
def _(spark, folder):
    return text_profiles(spark, folder).select("id", "antonym_signal")


@query("semantic_profile", f"""WITH {PROFILED}
SELECT id, similarity_score, contradiction_score, antonym_signal, exclusion_score FROM profiled""", ("textpairs",))
def _(spark, folder):
    rows = RP.semantic_profile(view(spark, folder, "textpairs"), "jaccard")
    return rows.select("id", "similarity_score", "contradiction_score", "antonym_signal", "exclusion_score")


@query("semantic_profile_lexical")
def _(spark, folder):
    rows = RP.semantic_profile(view(spark, folder, "textpairs"), "lexical")
    return rows.select("id", "similarity_score", "contradiction_score", "antonym_signal", "exclusion_score")


@query("semantic_profile_embedding", """WITH pairs AS (
  SELECT a.vec_id AS id, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT id, round(sim, 6) AS similarity_score, round(1 - sim, 6) AS exclusion_score FROM pairs""")
def _(spark, folder):
    e = table(spark, folder, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target_vec"))
    pairs = e.withColumnRenamed("embedding", "correct_vec").join(after, "vec_id").withColumns(
        {"correct_text": F.lit("plain"), "target_text": F.lit("text")}
    )
    rows = RP.semantic_profile(pairs, "embedding")
    return rows.select(F.col("vec_id").alias("id"), "similarity_score", "exclusion_score")


# --- text helpers -------------------------------------------------------------------------------------------

@query("strip_confidence", f"""WITH {RAW_TEXTS}
SELECT id, condition, CASE WHEN k % {len(FORMS)} = 0 THEN 'ANSWER: ' || initial ELSE trim(text) END AS text
FROM raw_texts""", ("responses",))
def _(spark, folder):
    return raw_texts(spark, folder).select("id", "condition", P.strip_confidence(F.col("text")).alias("text"))


@query("short_text", """WITH c AS (
  SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\x{A0}\\x{3000}]+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) <= 120 THEN t ELSE left(t, 117) || '...' END AS short FROM c""")
def _(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", P.short_text(F.col("text")).alias("short")
    )


@query("char_count", "SELECT conv_id, turn, length(text)::INT AS characters FROM conversations")
def _(spark, folder):
    one = F.array(M.message(F.col("role"), F.col("text")))
    return table(spark, folder, "conversations").select("conv_id", "turn", M.char_count(one).alias("characters"))


@query("token_count", """
SELECT conv_id, turn, (1 + len(list_filter(
  string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')))::INT AS tokens FROM conversations""")
def _(spark, folder):
    one = F.array(M.message(F.col("role"), F.col("text")))
    return table(spark, folder, "conversations").select("conv_id", "turn", M.token_count(one).alias("tokens"))


@query("name_shorten", """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Qwen2.5-3B' WHEN 1 THEN 'Phi-3.5-mini' WHEN 2 THEN 'Gemma2-2B'
  ELSE c_mktsegment END || ' / ' || CASE WHEN c_custkey % 2 = 0 THEN 'CSQA' ELSE 'MMLU' END AS label FROM customer""")
def _(spark, folder):
    k = F.col("c_custkey")
    model = (
        F.when(k % 4 == 0, F.concat(F.lit("Qwen/"), "c_mktsegment")).when(k % 4 == 1, F.lit("microsoft/Phi-3.5"))
        .when(k % 4 == 2, F.lit("google/GEMMA-2")).otherwise(F.col("c_mktsegment"))
    )
    dataset = F.when(k % 2 == 0, "CommonsenseQA").otherwise("MMLU")
    return table(spark, folder, "customer").select(
        k.alias("id"), F.concat(L.name_shorten(model), F.lit(" / "), L.dataset_shorten(dataset)).alias("label")
    )


