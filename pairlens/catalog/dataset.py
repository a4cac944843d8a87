"""Item preparation and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.catalog.registry import query
from pairlens.catalog.views import table, view
from pairlens.operators import audits as A
from pairlens.operators import items as T


@query("choices_to_options", """
SELECT p_partkey AS id, p_name AS option_a, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS option_b,
  CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS options FROM part""")
def _(spark, folder):
    labels = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    rows = table(spark, folder, "part").withColumn(
        "options", T.choices_to_options(labels, F.array("p_name", "p_brand", "p_type"))
    )
    return rows.select(
        F.col("p_partkey").alias("id"), F.col("options")["A"].alias("option_a"),
        F.try_element_at("options", F.lit("B")).alias("option_b"), F.size("options").alias("options"),
    )


@query("index_labels", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1)
    WHEN 1 THEN substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) END AS gold,
  CASE WHEN p_partkey % 3 < 2 THEN CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END END
    AS gold_text
FROM part""")
def _(spark, folder):
    size = F.col("p_size") % 4
    answer = (
        F.when(F.col("p_partkey") % 3 == 0, size.cast("string"))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.lower(F.substring(F.lit("ABCD"), 1, 4).substr(
            size.cast("int") + 1, F.lit(1)))))
        .otherwise(F.lit("none"))
    )
    rows = table(spark, folder, "part").withColumns({
        "options": T.index_labels(F.array("p_name", "p_brand", "p_type")), "gold": T.gold_label(answer),
    })
    return rows.select(
        F.col("p_partkey").alias("id"), "gold",
        F.when(F.col("gold").isNotNull(), F.try_element_at("options", F.col("gold"))).alias("gold_text"),
    )


@query("pick_distractor", """WITH listed AS (
  SELECT id, correct, list_filter(['A','B','C','D'], lambda x: x <> correct) AS wrong FROM responses
  WHERE n = 1 AND k % 20 <> 7)
SELECT id, correct AS correct_answer,
  wrong[CAST(CAST('0x' || substr(md5('42|' || id), 1, 8) AS BIGINT) % 3 AS INT) + 1] AS distractor FROM listed""",
       ("responses",))
def _(spark, folder):
    options = F.create_map(*[x for label in "ABCD" for x in (F.lit(label), F.lit("text"))])
    rows = view(spark, folder, "responses").where("n = 1").select(
        "id", F.when(F.col("k") % 20 != 7, F.col("correct")).alias("correct_answer"), options.alias("options")
    )
    return T.build_items(rows).drop("options")


@query("opinion_levels", """
SELECT id, level AS attack_level, repeat(distractor, CASE level WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 ELSE 5 END) AS opinions
FROM responses CROSS JOIN (SELECT unnest(['L1','L2','L3','L4','L5']) AS level) l WHERE n = 1""", ("responses",))
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("id", "distractor")
    return T.level_expand(items).select("id", "attack_level", F.array_join("opinions", "").alias("opinions"))


@query("condition_expand", """
SELECT id, input_mode, 'input_mode_comparison' AS dimension, 'target_consensus_n5' AS condition_name,
  'N5' AS attack_level, repeat(distractor, 5) AS opinions
FROM responses CROSS JOIN (SELECT unnest(['single_input','sequential_input']) AS input_mode) m WHERE n = 1""",
       ("responses",))
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("id", "distractor")
    return T.condition_expand(items).drop("distractor").withColumn("opinions", F.array_join("opinions", ""))


_WORK_KEYS = ["id", "input_mode", "dimension", "condition_name"]


@query("resume_remaining", """
SELECT id, input_mode, 'input_mode_comparison' AS dimension, 'target_consensus_n5' AS condition_name
FROM responses CROSS JOIN (SELECT unnest(['single_input','sequential_input']) AS input_mode) m
WHERE n = 1 AND NOT (k % 3 = 0 AND input_mode = 'single_input')""", ("responses",))
def _(spark, folder):
    items = view(spark, folder, "responses").where("n = 1").select("id", "distractor", "k")
    work = T.condition_expand(items)
    done = work.where("k % 3 = 0 AND input_mode = 'single_input'")
    return A.resume_remaining(work, done, _WORK_KEYS).select(*_WORK_KEYS)


@query("resume_aligned", """
SELECT dataset, model, id, 3 AS conditions, 'unaligned' AS problem FROM responses WHERE n = 1 AND k % 10 = 3
UNION ALL SELECT dataset, model, id, 0, 'not in dataset' FROM responses WHERE n = 1 AND k % 12 = 5
UNION ALL SELECT 'manifest', 'n_samples', NULL, 0, 'setting'""", ("responses",))
def _(spark, folder):
    rows = view(spark, folder, "responses")
    done = rows.where("NOT (n = 4 AND k % 10 = 3)")
    unaligned = A.id_sets_equal(done, K.FOUR_PROTOCOLS).select(
        "dataset", "model", "id", F.col("conditions").cast("int").alias("conditions"), F.lit("unaligned").alias("problem")
    )
    items = rows.where("n = 1 AND k % 12 <> 5")
    foreign = A.resume_foreign(done.where("n = 1"), items).select(
        "dataset", "model", "id", F.lit(0).alias("conditions"), F.lit("not in dataset").alias("problem")
    )
    counts = done.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(None).cast("string").alias("tokenizer"))
    changed = counts.withColumn("n_samples", F.col("n_samples") + 1)
    settings = A.settings_differences(counts, changed, ["n_samples", "tokenizer"]).select(
        F.lit("manifest").alias("dataset"), F.col("setting").alias("model"), F.lit(None).cast("string").alias("id"),
        F.lit(0).alias("conditions"), F.lit("setting").alias("problem"),
    )
    return unaligned.unionByName(foreign).unionByName(settings)
