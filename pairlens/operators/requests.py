"""Request tables for batch inference, and raw responses back to answer rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions import messages as M
from pairlens.functions.logprobs import answer_token, top_logprob_map
from pairlens.functions.parsing import with_answers


def initial_requests(items: DataFrame, confidence: bool = True) -> DataFrame:
    """First request of every item."""
    return items.withColumn(
        "initial_messages", M.base_request(F.col("question"), F.col("options"), confidence=confidence)
    )


def with_context(answered: DataFrame, peers: int = K.PEERS) -> DataFrame:
    """Items with an initial answer text: the conversation so far and the peer opinions."""
    return initial_requests(answered).withColumns({
        "ctx": M.context(F.col("initial_messages"), F.col("initial_text")),
        "opinions": F.array_repeat(F.col("distractor"), peers),
    })


#: Single-call conditions, each from the conversation so far, the opinions and the model.
PROTOCOLS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "batch_single": lambda c, o, model: M.batch_single(c, o),
    "sequential_final": lambda c, o, model: M.sequential_final(c, o),
    "sequential_final_rationale": lambda c, o, model: M.sequential_rationale(c, o),
    "sequential_final_length_matched": lambda c, o, model: M.with_neutral_turns(c, o, M.neutral_turn(model)),
    "sequential_final_neutral_v2": lambda c, o, model: M.with_neutral_turns(c, o, M.neutral_turn(model, "neutral_v2")),
    "sequential_final_short_ack": lambda c, o, model: M.with_neutral_turns(c, o, M.neutral_turn(model, "short_ack")),
}


def protocol_requests(ctx: DataFrame, conditions: Sequence[str] = tuple(PROTOCOLS)) -> DataFrame:
    """One row per item and wanted single-call condition; only these are built."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("condition"), PROTOCOLS[name](F.col("ctx"), F.col("opinions"), F.col("model")).alias("messages"))
        for name in conditions
    ])
    return ctx.select("id", "model", F.inline(rows))


def label_requests(ctx: DataFrame, neutral_label: str = K.NEUTRAL_LABEL) -> DataFrame:
    """One row per item and label condition (attention and source-label families)."""
    c = F.col("ctx")
    attention = [
        F.struct(
            F.lit(name).alias("condition"),
            M.guided(c, M.attention_lines(F.col("correct"), F.col("distractor"), F.lit(name))).alias("messages"),
        )
        for name in K.LABEL_CONDITIONS
    ]
    source = [
        F.struct(
            F.lit(name).alias("condition"),
            M.guided(c, M.source_lines(F.col("distractor"), F.lit(name), neutral_label)).alias("messages"),
        )
        for name in ("neutral_source_label", "model_source_label", "unlabelled_numbered")
    ]
    return ctx.select("id", "model", F.inline(F.array(*attention, *source)))


def stepwise_requests(ctx: DataFrame, step: int, history: str = "none", closing: bool = True) -> DataFrame:
    """Requests of one step. Needs ``prior_texts`` and ``prior_answers`` unless the history is ``none``."""
    prior = (None, None) if history == "none" else (F.col("prior_texts"), F.col("prior_answers"))
    return ctx.withColumn(
        "messages", M.stepwise(F.col("ctx"), F.col("opinions"), step, history, *prior, closing=closing)
    )


def response_ingest(
    requests: DataFrame, responses: DataFrame, keys: Sequence[str] = ("id", "condition"), options: str | None = None,
) -> DataFrame:
    """Raw responses joined to their requests: answer, confidence, validity, log-probs, flags.

    Requests without a response, or with an error, become error rows. ``responses`` holds the keys, ``text``,
    ``content_logprobs`` (array of {token, logprob, top_logprobs}) and ``error``; an ``error_type`` of its own is kept, and
    so are further columns such as a stage.
    """
    marked = responses.withColumn("_answered", F.lit(True))
    own_type = F.col("error_type") if "error_type" in responses.columns else F.lit(None).cast("string")
    joined = requests.join(marked, list(keys), "left")
    is_error = F.col("_answered").isNull() | F.col("error").isNotNull()
    usable = joined.withColumns({"is_error": is_error, "text": F.when(~is_error, F.col("text"))})
    parsed = with_answers(usable, "text", options)
    token = answer_token(F.col("content_logprobs"), F.col("answer"))
    rows = parsed.withColumns({"_t": token, "final": F.when(~F.col("is_error"), F.col("answer"))})
    return rows.withColumns({
        "final_valid": F.col("final").isin(*K.OPTION_LABELS) & F.col("final").isNotNull(),
        "final_confidence": F.when(~F.col("is_error"), F.col("confidence")),
        "option_logprobs": top_logprob_map(F.col("_t.top_logprobs")),
        "selected_logprob": F.col("_t.logprob"),
        "is_correct": F.col("final").eqNullSafe(F.col("correct")),
        "chose_distractor": F.col("final").eqNullSafe(F.col("distractor")),
        "changed_from_initial": ~F.col("final").eqNullSafe(F.col("initial")),
        "error_type": F.when(F.col("_answered").isNull(), F.lit("missing response"))
        .when(F.col("error").isNotNull(), F.coalesce(own_type, F.lit("model error"))),
    }).drop("_t", "_answered", "content_logprobs", "parse_status", "matched_text", "span_start", "span_end",
            "normalized_text", "answer", "confidence")


def answer_with(
    requests: DataFrame, model: Callable[[list[dict]], dict], messages: str = "messages"
) -> DataFrame:
    """Contract for an injected model call: ``model(messages) -> {"text": ..., "error": ...}`` inside tasks."""
    schema = requests.select(*[c for c in requests.columns if c != messages]).schema.add("text", "string").add(
        "error", "string"
    )
    kept = [f.name for f in schema.fields if f.name not in ("text", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [model([dict(m) for m in row]) for row in batch[messages]]
            out = batch[kept].copy()
            out["text"] = [r.get("text") for r in results]
            out["error"] = [r.get("error") for r in results]
            yield out

    return requests.mapInPandas(run, schema)


def request_invariants(ctx: DataFrame) -> DataFrame:
    """Per model: items, and items for which each invariant of the request family holds."""
    c, o, n = F.col("ctx"), F.col("opinions"), F.size("opinions")
    final = M.sequential_final(c, o)
    stepped = M.stepwise(c, o, n, "none")
    neutral = M.with_neutral_turns(c, o, K.NEUTRAL_TURN)
    v2 = M.with_neutral_turns(c, o, K.NEUTRAL_V2_TURN)
    peers = F.transform(F.slice(final, F.size(c) + 1, n), lambda m: m["content"])
    without = F.filter(neutral, lambda m, i: ~((i >= F.size(c)) & (m["role"] == "assistant")))
    source = M.source_lines(F.col("distractor"), F.lit("neutral_source_label"))
    model = M.source_lines(F.col("distractor"), F.lit("model_source_label"))
    swapped = F.transform(
        source, lambda x: F.replace(x, F.lit(K.NEUTRAL_LABEL + " "), F.lit(K.MODEL_LABEL + " "))
    )
    checks: dict[str, Column] = {
        "last_step_is_final": stepped == final,
        "no_history_leak": F.size(M.turns_after_initial(stepped)) == 0,
        "neutral_adds_only_turns": without == final,
        "neutral_turn_count": F.size(M.turns_after_initial(neutral)) == n - 1,
        "neutral_wording_only": F.transform(neutral, lambda m: m["role"]) == F.transform(v2, lambda m: m["role"]),
        "same_prefix": F.slice(final, F.lit(1), F.size(c)) == c,
        "peer_order": peers == M.numbered(o, "Agent ", ": "),
        "label_word_only": swapped == model,
    }
    return ctx.groupBy("model").agg(
        F.count(F.lit(1)).alias("items"), *[F.count_if(v).alias(k) for k, v in checks.items()]
    )
