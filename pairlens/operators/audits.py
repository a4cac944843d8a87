"""Data-quality audits. Each returns rows to read; ``strict`` forms fail the query instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions import labels as L
from pairlens.functions.logprobs import logprobs_missing, option_logprob
from pairlens.functions.parsing import parse_answer, raw_answer_fallback, short_text
from pairlens.operators.guards import require, require_rows
from pairlens.operators.metrics import flag, ratio
from pairlens.operators.normalize import with_record
from pairlens.operators.pairing import CELL
from pairlens.session import dealt, settle


def dup_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys with their row count and surplus rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where("rows > 1").withColumn("extra_rows", F.col("rows") - 1)


# --- line integrity -----------------------------------------------------------------------------------------

def integrity_flags(lines: DataFrame, value: str = "value") -> DataFrame:
    """Per line the Boolean facts that the profile counts, the item id and the experiment mode."""
    text = F.col(value)
    staged = with_record(lines.withColumn("blank", L.strip(text) == ""), value)
    v = F.col("_v")
    ok = ~F.col("blank") & v.isNotNull()
    final = F.try_variant_get(v, "$.final_answer", "string")
    final_alias = L.first_key(v, K.INTEGRITY_FINAL_KEYS)
    raw, raw_alias = F.variant_get(v, "$.raw_output", "variant"), L.first_key(v, K.INTEGRITY_RAW_KEYS, "variant")
    lp = F.variant_get(v, "$.option_logprobs", "variant")
    lp_alias = L.first_key(v, K.INTEGRITY_LOGPROB_KEYS, "variant")
    item = L.first_key(v, K.INTEGRITY_ID_KEYS)
    error = L.is_json_true(v, "is_error")

    def blank(x: Column) -> Column:
        return flag(L.strip(x) == "")

    effective = ~error & ~L.empty_json(L.first_key(v, K.INTEGRITY_FINAL_KEYS, "variant"))
    facts = {
        "json_ok": ok,
        "json_failed": ~F.col("blank") & v.isNull(),
        "is_error_true": ok & error,
        "final_answer_null": ok & final.isNull(),
        "final_answer_empty": ok & blank(final),
        "final_answer_valid": ok & final.isNotNull() & ~blank(final),
        "analysis_final_null": ok & final_alias.isNull(),
        "analysis_final_empty": ok & blank(final_alias),
        "analysis_final_valid": ok & final_alias.isNotNull() & ~blank(final_alias),
        "raw_output_empty": ok & L.empty_json(raw),
        "raw_output_nonempty": ok & ~L.empty_json(raw),
        "analysis_raw_output_empty": ok & L.empty_json(raw_alias),
        "analysis_raw_output_nonempty": ok & ~L.empty_json(raw_alias),
        "option_logprobs_empty": ok & L.empty_json(lp),
        "option_logprobs_nonempty": ok & ~L.empty_json(lp),
        "analysis_option_logprobs_empty": ok & L.empty_json(lp_alias),
        "analysis_option_logprobs_nonempty": ok & ~L.empty_json(lp_alias),
        "item_id_missing": ok & L.empty_text(item),
        "effective": ok & effective,
    }
    return staged.withColumns({
        **facts,
        "item_id": F.when(ok & ~L.empty_text(item), item),
        "analysis_final": final_alias,
        "is_error": error,
        "experiment_mode": F.try_variant_get(v, "$.experiment_mode", "string"),
    }).drop("_v")


INTEGRITY_FACTS = (
    "json_ok", "json_failed", "is_error_true", "final_answer_null", "final_answer_empty", "final_answer_valid",
    "analysis_final_null", "analysis_final_empty", "analysis_final_valid", "raw_output_empty",
    "raw_output_nonempty", "analysis_raw_output_empty", "analysis_raw_output_nonempty", "option_logprobs_empty",
    "option_logprobs_nonempty", "analysis_option_logprobs_empty", "analysis_option_logprobs_nonempty",
    "item_id_missing",
)


def integrity_facts(lines: DataFrame, value: str = "value") -> DataFrame:
    """The flags of ``integrity_flags`` as a written table, without the text of sound lines: lines are parsed once."""
    kept = F.when(F.col("json_failed"), F.col(value))
    return settle(integrity_flags(lines, value).withColumn(value, kept), "integrity")


def profile_of_facts(facts: DataFrame, file: str = "file") -> DataFrame:
    """Counters per file. They are summed before the shuffle; only ids are shuffled row by row, to count repeated ones."""
    counts = facts.groupBy(file).agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if("blank").alias("empty_lines"),
        *[F.count_if(F.col(c)).alias(c) for c in INTEGRITY_FACTS], F.count_if("effective").alias("effective_samples"),
    )
    ids = dealt(facts.where("item_id IS NOT NULL").select(file, "item_id"), facts, file, "item_id")
    per_id = ids.groupBy(file, "item_id").agg(F.count(F.lit(1)).alias("lines"))
    ids = per_id.groupBy(file).agg(
        F.count(F.lit(1)).alias("unique_item_ids"), F.sum(F.col("lines") - 1).alias("item_id_duplicates")
    )
    none = F.lit(0).cast("bigint")
    return counts.join(ids, file, "left").select(
        file, "total_lines", "empty_lines", *INTEGRITY_FACTS, F.coalesce("unique_item_ids", none).alias("unique_item_ids"),
        F.coalesce("item_id_duplicates", none).alias("item_id_duplicates"), "effective_samples",
    )


def integrity_profile(lines: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Line, error, final-answer, output, log-prob and id counters per file."""
    return profile_of_facts(integrity_facts(lines, value), file)


def modes_of_facts(facts: DataFrame, file: str = "file") -> DataFrame:
    """Rows per file and experiment mode."""
    named = facts.where(F.coalesce(F.col("experiment_mode"), F.lit("")) != "")
    return named.groupBy(file, "experiment_mode").agg(F.count(F.lit(1)).alias("rows"))


def integrity_mode_counts(lines: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Rows per file and experiment mode."""
    return modes_of_facts(integrity_flags(lines, value), file)


def bad_of_facts(facts: DataFrame, columns: Sequence[str], value: str = "value", width: int = 500) -> DataFrame:
    """Malformed lines with length, both ends and the kind of error: cut off, not JSON from the start on, or followed by more."""
    text = F.regexp_replace(F.col(value), r"[\r\n]+\z", "")
    body = L.strip(text)
    opened, closed = body.rlike(r"^[\[{]"), body.rlike(r"[\]}]$")
    kind = F.when(~opened, "no JSON object").when(closed, "malformed or trailing data").otherwise("cut off")
    return facts.where("json_failed").select(
        *columns, F.concat(F.lit("malformed JSON: "), kind).alias("error"), F.char_length(text).alias("length"),
        F.substring(text, 1, width).alias("first_chars"), F.right(text, F.lit(width)).alias("last_chars"),
    )


def integrity_bad_lines(lines: DataFrame, value: str = "value", width: int = 500) -> DataFrame:
    """Malformed lines. Give ``line_number`` in the input to keep it."""
    return bad_of_facts(integrity_flags(lines, value), [c for c in lines.columns if c != value], value, width)


def ineffective_of_facts(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parsed lines that cannot be analysed: error rows and rows without a final answer."""
    return facts.where("json_ok AND NOT effective").select(*columns, "item_id", "is_error", "analysis_final")


def integrity_ineffective(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parsed lines that cannot be analysed: error rows and rows without a final answer."""
    return ineffective_of_facts(integrity_flags(lines, value), [c for c in lines.columns if c != value])


# --- label-attention quality --------------------------------------------------------------------------------

def label_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines of label runs, with either generation of keys, as the typed rows that ``label_answers`` takes.

    Other columns (the condition, say) are kept; blank and malformed lines give no row.
    """
    kept = [c for c in lines.columns if c != value]
    v = F.col("_v")
    return with_record(lines, value).where(v.isNotNull()).select(
        *kept, L.first_key(v, K.LABEL_FINAL_KEYS).alias("final_answer"), L.first_key(v, K.LABEL_RAW_KEYS).alias("raw_output"),
        L.first_key(v, K.CORRECT_KEYS).alias("correct"), L.first_key(v, K.DISTRACTOR_KEYS).alias("distractor"),
        F.try_variant_get(v, "$.option_logprobs", "map<string,double>").alias("option_logprobs"),
        L.is_json_true(v, "is_error").alias("is_error"), F.try_variant_get(v, "$.error", "string").alias("error"),
        F.try_variant_get(v, "$.error_type", "string").alias("error_type"),
    )


def label_answers(df: DataFrame) -> DataFrame:
    """Final answer of label rows: recorded label, else from the raw text; log-probs of gold and target.

    Input: final_answer, raw_output, correct, distractor, option_logprobs, is_error, error, error_type.
    """
    recorded = L.label_normalize(F.col("final_answer"))
    right, target = L.label_normalize(F.col("correct")), L.label_normalize(F.col("distractor"))
    return df.withColumns({
        "recorded": recorded,
        "answer": F.coalesce(recorded, raw_answer_fallback(F.coalesce(F.col("raw_output"), F.lit("")))),
        "correct": right,
        "distractor": target,
        "correct_lp": option_logprob(F.col("option_logprobs"), right),
        "distractor_lp": option_logprob(F.col("option_logprobs"), target),
    })


def _error_row() -> Column:
    return flag(F.col("is_error")) | F.col("error").isNotNull()


def quality_summary(answers: DataFrame) -> DataFrame:
    """Quality checks with count and share of all rows, one row per check and per condition."""
    total = answers.groupBy("condition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_error_row()).alias("error"),
        F.count_if(F.col("recorded").isNull()).alias("final_empty"),
        F.count_if(L.empty_text(F.col("raw_output"))).alias("raw_empty"),
        F.count_if(logprobs_missing(F.col("option_logprobs"))).alias("option_logprobs_empty"),
        F.count_if(F.col("answer").isNotNull()).alias("valid"),
    )
    known = F.col("condition").isin(*K.LABEL_CONDITIONS)
    checks = F.array(
        F.struct(
            F.concat(F.when(known, "rows: ").otherwise("rows (unknown condition): "), F.col("condition"))
            .alias("check"), F.col("rows").alias("n"),
        ),
        *[
            F.struct(F.lit(c).alias("check"), F.col(c).alias("n"))
            for c in ("error", "final_empty", "raw_empty", "option_logprobs_empty", "valid")
        ],
        F.struct(F.lit("total").alias("check"), F.col("rows").alias("n")),
    )
    summed = total.select(F.inline(checks)).groupBy("check").agg(F.sum("n").alias("count"))
    everything = F.max(F.when(F.col("check") == "total", F.col("count"))).over(Window.partitionBy())
    return summed.withColumn("rate", ratio(F.col("count"), everything))


def first_keys(lines: DataFrame, value: str = "value", ordinal: str = "line_number") -> DataFrame:
    """Sorted keys of the first row."""
    return lines.agg(F.min_by(F.array_sort(F.json_object_keys(F.col(value))), F.col(ordinal)).alias("keys"))


def error_top(df: DataFrame, ordinal: str, top: int = 5) -> DataFrame:
    """Most frequent ``type: message`` of error rows; ties go to the one seen first."""
    key = F.concat(F.coalesce(F.col("error_type"), F.lit("UNKNOWN")), F.lit(": "), short_text(F.col("error")))
    return (
        df.where(_error_row()).groupBy(key.alias("error_key"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(ordinal).alias("_first"))
        .orderBy(F.desc("rows"), "_first").limit(top).drop("_first")
    )


# --- agreement of metadata ----------------------------------------------------------------------------------

def _fingerprints(field: str, kind: str) -> list[Column]:
    """Two 64-bit hashes of a field that ignore map order; null stays apart from every value."""
    value: Column = F.col(field)
    if kind.startswith("map"):
        value = F.array_sort(F.map_entries(value))
    present = F.col(field).isNotNull()
    return [F.xxhash64(present, value), F.xxhash64(F.lit(7), value, present)]


def contrast_drift(
    df: DataFrame, contrasts: Sequence[tuple[str, str]], fields: Sequence[str] = K.AUDIT_FIELDS, keys: Sequence[str] = CELL,
    item: str = "id", condition: str = "condition",
) -> DataFrame:
    """``(keys, item, condition1, condition2, fields)``: items whose audit fields differ within a contrast.

    One scan and one shuffle whatever the number of contrasts: a row per item holds the least and the greatest hash of each
    field and condition, and a contrast compares those of its two conditions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    conditions = list(dict.fromkeys(c for pair in contrasts for c in pair))
    hashed = df.where(F.col(condition).isin(*conditions)).select(
        *keys, item, F.col(condition).alias("_cond"),
        *[h.alias(f"_{f}{i}") for f in fields for i, h in enumerate(_fingerprints(f, kinds[f]))],
    )
    bounds = [
        g(F.when(F.col("_cond") == c, F.col(f"_{f}{i}"))).alias(f"_{n}{k}_{f}{i}")
        for k, c in enumerate(conditions) for f in fields for i in (0, 1) for n, g in (("lo", F.min), ("hi", F.max))
    ]
    wide = hashed.groupBy(*keys, item).agg(*bounds)

    def differs(a: int, b: int, f: str) -> Column:
        def apart(i: int) -> Column:
            return F.least(f"_lo{a}_{f}{i}", f"_lo{b}_{f}{i}") != F.greatest(f"_hi{a}_{f}{i}", f"_hi{b}_{f}{i}")
        return apart(0) | apart(1)

    compared = F.array(*[
        F.struct(
            F.lit(first).alias("condition1"), F.lit(second).alias("condition2"),
            F.array_join(F.filter(F.array(*[
                F.when(differs(conditions.index(first), conditions.index(second), f), F.lit(f)) for f in fields
            ]), lambda x: x.isNotNull()), ",").alias("fields"),
        )
        for first, second in contrasts
    ])
    return wide.select(*keys, item, F.inline(compared)).where("fields <> ''")


def metadata_drift(
    df: DataFrame, fields: Sequence[str] = K.AUDIT_FIELDS, keys: Sequence[str] = CELL, item: str = "id",
    valid_only: bool = False, strict: bool = False,
) -> DataFrame:
    """Items whose audit fields differ between conditions, with the names of those fields.

    Long texts are compared through two independent 64-bit hashes, so the shuffle carries integers only and the
    aggregate stays in codegen; maps compare without order and null equals null.
    """
    rows = df.where("valid") if valid_only else df
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    hashed = rows.select(
        *keys, item,
        *[h.alias(f"_{f}{i}") for f in fields for i, h in enumerate(_fingerprints(f, kinds[f]))],
    )
    bounds = [
        g(f"_{f}{i}").alias(f"_{n}_{f}{i}")
        for f in fields for i in (0, 1) for n, g in (("lo", F.min), ("hi", F.max))
    ]
    grouped = hashed.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("rows"), *bounds)

    def differs(f: str) -> Column:
        return (F.col(f"_lo_{f}0") != F.col(f"_hi_{f}0")) | (F.col(f"_lo_{f}1") != F.col(f"_hi_{f}1"))

    changed = F.filter(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    report = grouped.select(*keys, item, "rows", F.array_join(changed, ",").alias("fields"))
    if strict:
        text = F.concat(F.lit("metadata drift of item "), F.col(item).cast("string"), F.lit(": "), F.col("fields"))
        return require_rows(report, item, F.col("fields") == "", text)
    return report.where(F.col("fields") != "")


def id_sets_equal(
    df: DataFrame, conditions: Sequence[str], keys: Sequence[str] = CELL, item: str = "id",
    condition: str = "condition", strict: bool = False,
) -> DataFrame:
    """Items missing under some of the conditions; strict form fails on the first one."""
    seen = df.where(F.col(condition).isin(*conditions)).select(*keys, item, condition).distinct()
    held = seen.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("conditions"))
    short = F.col("conditions") < len(conditions)
    if strict:
        return require_rows(held, item, ~short, F.concat(F.lit("unaligned item "), F.col(item).cast("string")))
    return held.where(short)


def reference_drift(
    responses: DataFrame, items: DataFrame, fields: Sequence[str], item: str = "id", strict: bool = False,
) -> DataFrame:
    """Response rows whose item is absent from the bank or differs from it, with the reason.

    Fields are compared by two 64-bit hashes taken before the join, so texts that the caller does not select stay out of it.
    """
    def hashed(table: DataFrame, prefix: str) -> list[Column]:
        kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        return [h.alias(f"_{prefix}_{f}{i}") for f in fields for i, h in enumerate(_fingerprints(f, kinds[f]))]

    bank = items.select(item, F.lit(True).alias("_known"), *hashed(items, "ref"))
    joined = responses.select("*", *hashed(responses, "own")).join(bank, item, "left")
    changed = F.filter(
        F.array(*[
            F.when(~(F.col(f"_own_{f}0").eqNullSafe(F.col(f"_ref_{f}0")) & F.col(f"_own_{f}1").eqNullSafe(F.col(f"_ref_{f}1"))), F.lit(f))
            for f in fields
        ]),
        lambda x: x.isNotNull(),
    )
    reason = F.when(F.col("_known").isNull(), F.lit("absent")).when(F.size(changed) > 0, F.array_join(changed, ","))
    report = joined.withColumn("reason", reason).select(*responses.columns, "reason")
    if strict:
        text = F.concat(F.lit("item bank mismatch "), F.col(item).cast("string"), F.lit(": "), F.col("reason"))
        return require_rows(report, item, F.col("reason").isNull(), text).drop("reason")
    return report.where(F.col("reason").isNotNull())


def reference_answers(df: DataFrame, raw: str = "raw_initial_output", recorded: str = "initial", item: str = "id",
                      strict: bool = False) -> DataFrame:
    """Initial answers taken over from an earlier run: parsed label and why a row cannot be used."""
    parsed = df.withColumn("parsed_answer", parse_answer(F.col(raw)))
    problem = F.when(L.empty_text(F.col(raw)), F.lit("empty text")).when(
        F.col(recorded).isNotNull() & ~F.col("parsed_answer").eqNullSafe(F.col(recorded)), F.lit("answer mismatch")
    )
    checked = parsed.withColumn("problem", problem)
    if strict:
        text = F.concat(F.lit("reference row "), F.col(item).cast("string"), F.lit(": "), F.col("problem"))
        return require_rows(checked, item, F.col("problem").isNull(), text).drop("problem")
    return checked


def score_validate(
    df: DataFrame, tolerance: float = 1e-6, strict: bool = False, keys: Sequence[str] = ("id",), rows: int | None = None,
) -> DataFrame:
    """Score rows that break a rule: probability not finite or outside [0, 1], labels not summing to 1.

    Input: target_probability, candidate_labels, probabilities (map label to double). The strict form also fails on a
    repeated key and, where ``rows`` is given, on another number of rows.
    """
    if strict:
        repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        if repeated:
            raise ValueError(f"repeated score: {repeated.asDict()}")
        if rows is not None and df.count() != rows:
            raise ValueError(f"expected {rows} score rows")
    p = F.col("target_probability")
    total = F.aggregate(
        F.transform("candidate_labels", lambda x: F.try_element_at("probabilities", x)),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    inside = F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))
    sums = F.coalesce(F.abs(total - 1.0) <= tolerance, F.lit(False))
    problem = F.when(~inside, F.lit("probability")).when(~sums, F.lit("sum"))
    checked = df.withColumn("problem", problem)
    if strict:
        return require_rows(checked, "id", F.col("problem").isNull(), F.concat(F.lit("score "), F.col("problem"))
                            ).drop("problem")
    return checked.where(F.col("problem").isNotNull())


def score_metadata_match(items: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a score, or whose score row names another gold or target."""
    s = scores.select(
        *keys, L.label_normalize(F.col("correct_answer")).alias("_c"),
        L.label_normalize(F.col("target_distractor")).alias("_d"), F.lit(True).alias("_scored"),
    )
    problem = (
        F.when(F.col("_scored").isNull(), F.lit("missing score"))
        .when(~F.col("_c").eqNullSafe(F.col("correct")), F.lit("correct"))
        .when(~F.col("_d").eqNullSafe(F.col("distractor")), F.lit("distractor"))
    )
    found = items.join(s, list(keys), "left").withColumn("problem", problem)
    return found.where(F.col("problem").isNotNull()).select(*keys, "problem")


def final_step_audit(df: DataFrame, steps: str = "steps", final: str = "final", expected: int = 5) -> DataFrame:
    """Rows whose step array is malformed or whose last step disagrees with the final answer."""
    s = F.col(steps)
    last = F.try_element_at(s, F.lit(-1))
    problem = (
        F.when(F.coalesce(F.size(s), F.lit(-1)) != expected, F.concat(
            F.lit("length "), F.when(s.isNull(), F.lit("none")).otherwise(F.size(s).cast("string"))))
        .when(~last["iteration"].eqNullSafe(F.lit(expected)), F.lit("last iteration"))
        .when(~last["prediction"].eqNullSafe(F.col(final)), F.lit("mismatch"))
    )
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull())


def peer_signal_audit(df: DataFrame, expected: int = K.PEERS, source: str = "reference_jsonl") -> DataFrame:
    """Rows whose opinions are not the target repeated, whose peer order is off, or whose provenance differs."""
    problem = (
        F.when(~F.col("agent_opinions").eqNullSafe(F.array_repeat(F.col("distractor"), expected)), F.lit("opinions"))
        .when(~F.coalesce(F.size("peer_order") == expected, F.lit(False)), F.lit("peer order"))
        .when(~F.col("initial_answer_source").eqNullSafe(F.lit(source)), F.lit("provenance"))
        .when(F.col("initial").isNull(), F.lit("initial answer"))
    )
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull())


def message_deviation(messages: Column, expected: Column) -> Column:
    """Struct (position, reason) of the first message that departs from the expected array, null if none does.

    Reasons: ``missing`` (the next expected message stands there), ``added`` (the expected one comes right after),
    ``swapped`` with its successor, another ``role``, or ``reworded``; a null array is ``no messages``. Positions are from 1.
    """

    def first(ms: Column, ex: Column) -> Column:
        last = F.greatest(F.size(ms), F.size(ex))
        apart = F.filter(F.sequence(F.lit(0), last), lambda i: ~F.get(ms, i).eqNullSafe(F.get(ex, i)))

        def named(i: Column) -> Column:
            got, want = F.get(ms, i), F.get(ex, i)
            next_got, next_want = F.get(ms, i + 1), F.get(ex, i + 1)
            ahead, behind = got.eqNullSafe(next_want), next_got.eqNullSafe(want)
            reason = (
                F.when(ahead & behind & (i + 1 < F.size(ms)) & (i + 1 < F.size(ex)), "swapped")
                .when((i >= F.size(ms)) | (ahead & (F.size(ms) < F.size(ex))), "missing")
                .when((i >= F.size(ex)) | (behind & (F.size(ms) > F.size(ex))), "added")
                .when(~got["role"].eqNullSafe(want["role"]), "role")
                .otherwise("reworded")
            )
            return F.when(i.isNotNull(), F.struct((i + 1).alias("position"), reason.alias("reason")))

        return L.let(F.get(apart, F.lit(0)), named)

    none = F.struct(F.lit(0).alias("position"), F.lit("no messages").alias("reason"))
    return F.when(messages.isNull(), none).otherwise(L.let(messages, lambda ms: L.let(expected, lambda ex: first(ms, ex))))


def message_audit(df: DataFrame, messages: str, expected: Column) -> DataFrame:
    """Rows whose recorded messages depart from those that their condition builds, with ``position`` and ``problem``."""
    found = df.withColumn("_d", message_deviation(F.col(messages), expected)).where(F.col("_d").isNotNull())
    return found.select("*", F.col("_d.position").alias("position"), F.col("_d.reason").alias("problem")).drop("_d")


def identity_audit(df: DataFrame, one: str, other: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows compared and rows whose two request arrays differ."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(one).eqNullSafe(F.col(other))).alias("failures"),
    )


# --- resume -------------------------------------------------------------------------------------------------

def resume_remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work list without the completed keys."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def resume_foreign(done: DataFrame, items: DataFrame, item: str = "id") -> DataFrame:
    """Completed rows whose item is not in the dataset."""
    return done.join(items.select(item), item, "left_anti")


def settings_differences(existing: DataFrame, expected: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Settings of two one-row manifests that are not equal; null equals null."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias(name)) for s in settings]
        return df.select(F.inline(F.array(*pairs)))

    both = rows(existing, "existing").join(rows(expected, "expected"), "setting")
    return both.where(~F.col("existing").eqNullSafe(F.col("expected")))
