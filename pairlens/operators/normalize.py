"""Raw response lines and typed responses to the two normalised record forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions import labels as L


def with_record(df: DataFrame, value: str = "value", name: str = "_v") -> DataFrame:
    """Add the JSON value of a text column as VARIANT; null for malformed text, also for text after the first value.

    NaN and infinities are numbers, and the last of repeated keys counts, for which the session's setting is switched on.
    The value leaves through a one-row generator: later filters on its members cannot be rewritten into repeated
    parsing of the text.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    held = f"{name}_list"
    listed = df.withColumn(held, F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), "variant"))
    alone = F.variant_get(held, "$[1]", "variant").isNull()
    single = F.when(alone, F.variant_get(held, "$[0]", "variant"))
    return listed.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(single)).alias(name))


def option_labels(options: Column) -> Column:
    """Normalised option labels of a map column."""
    return F.transform(F.map_keys(options), lambda k: F.upper(L.strip(k)))


def structurally_valid(
    initial: Column, final: Column, correct: Column, distractor: Column,
    labels: Column | None = None, is_error: Column | None = None, explicit: Column | None = None,
) -> Column:
    """All four labels among the item's own, gold differs from target, no error, not marked invalid."""

    def known(label: Column) -> Column:
        inside = label.isin(*K.OPTION_LABELS)
        if labels is None:
            return inside
        return F.when(labels.isNull(), inside).otherwise(F.array_contains(labels, label))

    checks = known(initial) & known(final) & known(correct) & known(distractor) & (correct != distractor)
    if is_error is not None:
        checks = checks & ~F.coalesce(is_error, F.lit(False))
    if explicit is not None:
        checks = checks & F.coalesce(explicit, F.lit(True))
    return F.coalesce(checks, F.lit(False))


def normalize_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines with either generation of keys to id, initial, final, correct, distractor, valid and audit fields.

    Malformed lines give a row with ``parsed`` false; the strict reader turns these into a failure.
    """
    keep = [c for c in lines.columns if c != value]
    raw = with_record(lines, value)
    v = F.col("_v")
    options = F.try_variant_get(v, "$.options", "map<string,string>")
    has_options = F.coalesce(L.json_kind(v, "$.options").startswith("OBJECT"), F.lit(False))
    fields = raw.select(
        *keep,
        v.isNotNull().alias("parsed"),
        L.first_key(v, K.ID_KEYS).alias("id"),
        L.label_normalize(L.first_key(v, K.INITIAL_KEYS)).alias("initial"),
        L.label_normalize(L.first_key(v, K.FINAL_KEYS)).alias("final"),
        L.label_normalize(L.first_key(v, K.CORRECT_KEYS)).alias("correct"),
        L.label_normalize(L.first_key(v, K.DISTRACTOR_KEYS)).alias("distractor"),
        L.is_json_true(v, "is_error").alias("is_error"),
        L.is_json_false(L.first_key(v, K.VALID_KEYS, "variant")).alias("marked_invalid"),
        F.try_variant_get(v, "$.question", "string").alias("question"),
        F.when(has_options, options).alias("options"),
        F.try_variant_get(v, "$.source", "string").alias("source"),
        F.try_variant_get(v, "$.subject", "string").alias("subject"),
    )
    valid = structurally_valid(
        F.col("initial"), F.col("final"), F.col("correct"), F.col("distractor"),
        option_labels(F.col("options")), F.col("is_error"), ~F.col("marked_invalid"),
    )
    return fields.withColumn("valid", valid).drop("marked_invalid")


def normalize_responses(df: DataFrame) -> DataFrame:
    """Typed responses (initial, final, correct, distractor, optional is_error/options/final_valid) with ``valid``."""
    named = df.withColumns(
        {c: L.label_normalize(F.col(c)) for c in ("initial", "final", "correct", "distractor")}
    )
    have = set(df.columns)
    return named.withColumn(
        "valid",
        structurally_valid(
            F.col("initial"), F.col("final"), F.col("correct"), F.col("distractor"),
            option_labels(F.col("options")) if "options" in have else None,
            F.col("is_error") if "is_error" in have else None,
            F.col("final_valid") if "final_valid" in have else None,
        ),
    )


def normalize_ablation(df: DataFrame) -> DataFrame:
    """Ablation records: no case folding, no error check, validity from ``final_valid`` or the final label."""
    explicit = F.col("final_valid") if "final_valid" in df.columns else F.lit(None).cast("boolean")
    has_initial = F.col("initial").isNotNull()
    return df.withColumns({
        "valid": F.coalesce(explicit, F.col("final").isin(*K.OPTION_LABELS), F.lit(False)),
        "is_correct": F.col("final").eqNullSafe(F.col("correct")),
        "chose_distractor": F.col("final").eqNullSafe(F.col("distractor")),
        "changed": F.when(has_initial, ~F.col("final").eqNullSafe(F.col("initial"))),
        "initial_correct": F.when(has_initial, F.col("initial").eqNullSafe(F.col("correct"))),
    })


def derive_flags(df: DataFrame, before: str = "initial", after: str = "final") -> DataFrame:
    """changed, conformed, wrong conformity, beneficial revision; null equals null."""
    initial, final = F.col(before), F.col(after)
    return df.withColumns({
        "changed": ~final.eqNullSafe(initial),
        "conformed_to_target": final.eqNullSafe(F.col("distractor")),
        "wrong_conformity": initial.eqNullSafe(F.col("correct")) & final.eqNullSafe(F.col("distractor")),
        "beneficial_revision": ~initial.eqNullSafe(F.col("correct")) & final.eqNullSafe(F.col("correct")),
    })


def vote_counts(df: DataFrame, opinions: str = "opinions") -> DataFrame:
    """Number of opinions and of votes for target and gold."""
    votes = F.col(opinions)
    return df.withColumns({
        "opinion_count": F.size(votes),
        "target_vote_count": F.size(F.filter(votes, lambda o: o == F.col("distractor"))),
        "correct_vote_count": F.size(F.filter(votes, lambda o: o == F.col("correct"))),
    })


def support_ratios(df: DataFrame, condition: str = "condition") -> DataFrame:
    """Wrong and correct supporters of a label condition and their shares."""
    mixed = F.col(condition) == "mixed_label_conflict"
    uniform = F.col(condition).isin("labelled_5_wrong", "unlabelled_5_wrong")
    wrong = F.when(uniform, 5).when(mixed, 3)
    right = F.when(uniform, 0).when(mixed, 2)
    return df.withColumns({
        "num_wrong_supporters": wrong,
        "num_correct_supporters": right,
        "wrong_support_ratio": wrong / (wrong + right),
        "correct_support_ratio": right / (wrong + right),
        "has_explicit_model_labels": F.col(condition).isin("labelled_5_wrong", "mixed_label_conflict"),
    })
