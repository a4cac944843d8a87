"""Step arrays: one row per step, trajectories, own-answer history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions.labels import empty_text, strip
from pairlens.operators.guards import require
from pairlens.operators.metrics import flag, ratio


def explode_steps(df: DataFrame, steps: str = "steps") -> DataFrame:
    """One row per step with a 1-based position and the step's fields."""
    other = [c for c in df.columns if c != steps]
    rows = df.select(*other, F.posexplode(steps).alias("_pos", "_s"))
    fields = rows.schema["_s"].dataType.names
    named = [F.col("_s")[f].alias(f if f not in other else f"step_{f}") for f in fields]
    return rows.select(*other, (F.col("_pos") + 1).alias("step"), *named)


def step_trajectory(df: DataFrame, keys: Sequence[str] = ("condition",), steps: str = "steps") -> DataFrame:
    """Accuracy, adoption, harm and log-prob coverage per step.

    Every step with a usable label counts, whatever the final answer; conditions with fewer than two steps and steps
    without any usable label are left out. Harm is NaN where nobody was right before.
    """
    rows = df.select(
        *keys, "correct", "distractor", "initial", F.posexplode(steps).alias("_pos", "_s")
    ).withColumns({"_p": F.col("_s.prediction"), "step": F.col("_pos") + 1})
    usable = flag(F.col("_p").isin(*K.OPTION_LABELS))
    adopted = usable & flag(F.col("_p") == F.col("distractor"))
    was_right = usable & flag(F.col("initial") == F.col("correct"))
    covered = usable & F.exists(F.map_values("_s.option_logprobs"), lambda v: v.isNotNull())
    found = rows.groupBy(*keys, "step").agg(
        F.count_if(usable).alias("valid_n"),
        ratio(F.count_if(usable & flag(F.col("_p") == F.col("correct"))), F.count_if(usable)).alias("accuracy"),
        ratio(F.count_if(adopted), F.count_if(usable)).alias("distractor_adoption"),
        F.coalesce(ratio(F.count_if(adopted & was_right), F.count_if(was_right)), F.lit(float("nan"))).alias("harmful_conformity"),
        F.count_if(flag(covered)).alias("logprob_n"),
    )
    steps_seen = F.max("step").over(Window.partitionBy(*keys))
    return found.withColumn("_n", steps_seen).where("_n >= 2 AND valid_n > 0").drop("_n")


def last_step(steps: Column, field: str = "prediction") -> Column:
    """A field of the last step; null for no steps."""
    return F.try_element_at(steps, F.lit(-1))[field]


def last_step_rows(rows: DataFrame, keys: Sequence[str], value: str, step: str = "step") -> DataFrame:
    """The same on a table with one row per step; combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, step).alias(value), F.max(step).alias(step))


def prior_history(steps: Column, step: Column, mode: str = "answer") -> Column:
    """What the steps before ``step`` said: nothing, labels as ``ANSWER: X``, or the raw texts."""
    before = F.slice(steps, F.lit(1), F.greatest(step - 1, F.lit(0)))
    if mode == "none":
        return F.array().cast("array<string>")
    if mode == "answer":
        return F.transform(
            before,
            lambda s: F.when(
                s["prediction"].isin(*K.OPTION_LABELS), F.concat(F.lit("ANSWER: "), s["prediction"])
            ).otherwise(s["text"]),
        )
    if mode == "answer_confidence":
        return F.transform(before, lambda s: s["text"])
    raise ValueError(f"unknown history mode: {mode}")


def observed_history(df: DataFrame, steps: str = "steps", item: str = "id", turns: int = 4, need: int = 5) -> DataFrame:
    """Trimmed texts of the first steps, one row each; too few steps or a blank text fail the query."""
    s = F.col(steps)
    enough = F.coalesce(F.size(s) >= need, F.lit(False))
    first = F.when(
        enough, F.transform(F.slice(s, 1, turns), lambda x: x["text"])
    ).otherwise(F.raise_error(F.lit("too few step outputs")).cast("array<string>"))
    others = [c for c in df.columns if c not in (steps, item)]
    rows = df.select(item, *others, F.posexplode(first).alias("_pos", "_t"))
    kept = require(strip(F.col("_t")), ~empty_text(F.col("_t")), "empty history turn")
    return rows.select(item, *others, (F.col("_pos") + 1).alias("turn"), kept.alias("text"))


def flip_steps(df: DataFrame, steps: str = "steps", value: str = "prediction") -> DataFrame:
    """One row per step of a step array with the value of the step before and whether it changed; no shuffle."""
    other = [c for c in df.columns if c != steps]
    rows = df.select(*other, F.col(steps).alias("_all"), F.posexplode(steps).alias("_pos", "_s"))
    later, now, before = F.col("_pos") > 0, F.col("_s")[value], F.get("_all", F.col("_pos") - 1)[value]
    return rows.select(
        *other, (F.col("_pos") + 1).alias("step"), now.alias(value), F.when(later, before).alias("previous"),
        F.when(later, ~now.eqNullSafe(before)).alias("flipped"),
    )


def flip_from_previous(rows: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """The same for a table with one row per step.

    The previous row is found by an equi-join on (keys, step - 1): even one very long sequence spreads over tasks.
    """
    before = rows.select(*keys, (F.col(step) + 1).alias(step), F.col(value).alias("previous"), F.lit(True).alias("_has"))
    joined = rows.join(before, [*keys, step], "left")
    return joined.withColumn(
        "flipped", F.when(F.col("_has"), ~F.col(value).eqNullSafe(F.col("previous")))
    ).drop("_has")


def later_assistant_turns(rows: DataFrame, first: int = 3, turn: str = "turn", role: str = "role") -> DataFrame:
    """Assistant rows of a turn table after the initial exchange; a filter that reaches the scan."""
    return rows.where((F.col(turn) >= first) & (F.col(role) == "assistant"))
