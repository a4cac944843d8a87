"""Step arrays, histories and turn tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog.common import rounded
from pairlens.catalog.normalizing import step_table
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.functions import messages as M
from pairlens.operators import steps as S


@query("explode_steps", "SELECT id, condition, step, prediction, confidence::INT AS confidence FROM steprows",
       ("steprows",))
def _(spark, folder):
    rows = step_table(spark, folder).select("id", "condition", "steps")
    return S.explode_steps(rows).select("id", "condition", "step", "prediction", "confidence")


TRAJECTORY = """
SELECT dataset, model, condition, step, count(*) AS valid_n, round(avg((prediction = correct)::DOUBLE), 6) AS accuracy,
  round(avg((prediction = distractor)::DOUBLE), 6) AS distractor_adoption,
  round(avg((prediction = distractor)::DOUBLE) FILTER (WHERE initial = correct), 6) AS harmful_conformity,
  count(lp) AS logprob_n
FROM steprows WHERE prediction IS NOT NULL GROUP BY ALL"""


@query("step_trajectory", TRAJECTORY, ("steprows",))
def _(spark, folder):
    return rounded(S.step_trajectory(step_table(spark, folder), ("dataset", "model", "condition")))


@query("last_step", "SELECT id, condition, prediction FROM steprows WHERE step = 5", ("steprows",))
def _(spark, folder):
    return step_table(spark, folder).select(
        "id", "condition", S.last_step(F.col("steps")).alias("prediction")
    )


@query("last_step_rows", """
SELECT conv_id, max_by(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id""")
def _(spark, folder):
    return S.last_step_rows(table(spark, folder, "conversations"), ["conv_id"], "text", "turn")


# What step 4 is shown: the labels of steps 1-3, the raw text where a step gave none.
_SAID = """CASE WHEN prediction IS NOT NULL THEN 'ANSWER: ' || prediction
  ELSE 'ANSWER: none' || chr(10) || 'CONFIDENCE: ' || confidence END"""


@query("prior_history", f"""
SELECT id, condition, string_agg({_SAID}, '|' ORDER BY step) AS answers,
  string_agg('ANSWER: ' || coalesce(prediction, 'none') || chr(10) || 'CONFIDENCE: ' || confidence, '|' ORDER BY step)
    AS texts, '' AS nothing
FROM steprows WHERE step < 4 GROUP BY ALL""", ("steprows",))
def _(spark, folder):
    rows, step = step_table(spark, folder), F.lit(4)
    return rows.select("id", "condition", *[
        F.array_join(S.prior_history(F.col("steps"), step, mode), "|").alias(name)
        for name, mode in (("answers", "answer"), ("texts", "answer_confidence"), ("nothing", "none"))
    ])


@query("observed_history", """
SELECT id, condition, step AS turn,
  'ANSWER: ' || coalesce(prediction, 'none') || chr(10) || 'CONFIDENCE: ' || confidence AS text
FROM steprows WHERE step <= 4""", ("steprows",))
def _(spark, folder):
    rows = step_table(spark, folder).select("id", "condition", "steps")
    return S.observed_history(rows)


@query("turns_after_initial", """
SELECT id, condition, string_agg('ANSWER: ' || initial || '.', '|') AS history, count(*)::INT AS turns FROM steprows
WHERE step < 5 GROUP BY id, condition""", ("steprows",))
def _(spark, folder):
    ctx = M.context(
        F.array(M.message("system", F.lit("s")), M.message("user", F.col("question"))), F.lit("first answer")
    )
    own = F.array_repeat(F.concat(F.lit("ANSWER: "), F.col("initial"), F.lit(".")), 4)
    built = M.stepwise(ctx, F.array_repeat(F.col("distractor"), 5), 5, "answer_confidence", own, own)
    later = M.turns_after_initial(built)
    return view(spark, folder, "responses").select(
        "id", "condition", F.array_join(later, "|").alias("history"), F.size(later).alias("turns")
    )


@query("later_assistant_turns", """
SELECT conv_id, turn, text FROM conversations WHERE turn >= 3 AND role = 'assistant'""")
def _(spark, folder):
    return S.later_assistant_turns(table(spark, folder, "conversations")).select("conv_id", "turn", "text")


@query("flip_from_previous", """
SELECT id, condition, step, prediction, lag(prediction) OVER w AS previous,
  CASE WHEN step > 1 THEN prediction IS DISTINCT FROM lag(prediction) OVER w END AS flipped
FROM steprows WINDOW w AS (PARTITION BY id, condition ORDER BY step)""", ("steprows",))
def _(spark, folder):
    return S.flip_steps(step_table(spark, folder).select("id", "condition", "steps"))


@query("flip_between_turns", """
SELECT conv_id, turn, role, lag(role) OVER w AS previous,
  CASE WHEN lag(turn) OVER w = turn - 1 THEN role <> lag(role) OVER w END AS flipped
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return S.flip_from_previous(turns, ["conv_id"], "turn", "role")
