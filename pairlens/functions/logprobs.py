"""Token and option log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.constants import OPTION_LABELS
from pairlens.functions.labels import strip


def _token(entry: Column) -> Column:
    return F.upper(strip(entry["token"]))


def top_logprob_map(entries: Column) -> Column:
    """Array of {token, logprob} to a map over A-E: first usable value per label, null when absent."""
    labels = F.array(*[F.lit(label) for label in OPTION_LABELS])

    def first_value(label: Column) -> Column:
        usable = F.filter(entries, lambda e: (_token(e) == label) & e["logprob"].isNotNull())
        return F.get(usable, F.lit(0))["logprob"].cast("double")

    return F.map_from_arrays(labels, F.transform(labels, first_value))


def probability_map(logprobs: Column) -> Column:
    """exp of every log-probability; 0 where it is null."""
    return F.transform_values(logprobs, lambda _, v: F.coalesce(F.exp(v), F.lit(0.0)))


def answer_token(tokens: Column, answer: Column) -> Column:
    """First generated token that equals the answer; ``tokens`` is an array of {token, logprob, top_logprobs}."""
    same = F.filter(tokens, lambda t: _token(t) == answer)
    return F.when(answer.isin(*OPTION_LABELS), F.get(same, F.lit(0)))


def option_logprob(logprobs: Column, label: Column) -> Column:
    """Value of one label as a number; null when absent or not numeric."""
    return F.try_element_at(logprobs, label).try_cast("double")


def margin(logprobs: Column, distractor: Column, correct: Column) -> Column:
    """Distractor minus correct."""
    return option_logprob(logprobs, distractor) - option_logprob(logprobs, correct)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def logprobs_missing(logprobs: Column) -> Column:
    """True when the map is null or empty, or holds no value for any label."""
    held = F.filter(F.map_entries(logprobs), lambda e: e["key"].isin(*OPTION_LABELS) & e["value"].isNotNull())
    return F.coalesce(F.size(held) < 1, F.lit(True))


def softmax(scores: Column) -> Column:
    """Probabilities of a score array; fails on an empty array or a value that is not finite."""
    usable = (F.size(scores) > 0) & F.forall(scores, finite)
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(usable, F.transform(weights, lambda w: w / total)).otherwise(
        F.raise_error(F.lit("scores must be finite and not empty")).cast("array<double>")
    )


def raw_logprobs(raw: Column) -> Column:
    """Log-probabilities of the first choice in a raw response VARIANT."""
    return F.try_variant_get(raw, "$.choices[0].logprobs", "variant")
