"""Question items: option maps, gold labels, seeded distractors, attack opinions, work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.session import settle


def choices_to_options(labels: Column, texts: Column) -> Column:
    """{label[], text[]} to a map; the shorter array decides the size."""
    n = F.least(F.size(labels), F.size(texts))
    return F.map_from_arrays(F.slice(labels, F.lit(1), n), F.slice(texts, F.lit(1), n))


def index_labels(choices: Column) -> Column:
    """Choice list to a map keyed A, B, C, D."""
    return choices_to_options(F.array(*[F.lit(x) for x in "ABCD"]), choices)


def gold_label(answer: Column) -> Column:
    """Label of an answer given as a label, an index or an index in digits."""
    text = F.upper(F.trim(answer.cast("string")))
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    return F.when(text.isin(*"ABCD"), text).otherwise(F.get(labels, text.try_cast("int")))


def pick_distractor(options: Column, gold: Column, item: Column, seed: int = 42) -> Column:
    """Wrong option chosen by a hash of seed and item: independent of row order and partitioning."""
    wrong = F.array_except(F.map_keys(options), F.array(gold))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), item)), 1, 8), 16, 10).cast("bigint")
    return F.get(wrong, F.pmod(h, F.size(wrong)).cast("int"))


def build_items(df: DataFrame, seed: int = 42) -> DataFrame:
    """Items with options, gold and distractor; rows without a gold label are left out."""
    return df.where(F.coalesce(F.col("correct_answer"), F.lit("")) != "").withColumn(
        "distractor", pick_distractor(F.col("options"), F.col("correct_answer"), F.col("id"), seed)
    )


def opinion_levels(distractor: Column, level: Column, agents: int = K.PEERS) -> Column:
    """Wrong opinions of an attack level: one, half, or all agents; none for an unknown level."""
    n = (
        F.when(level == "L1", 1).when(level == "L2", max(1, agents // 2))
        .when(level.isin("L3", "L4", "L5"), agents).otherwise(0)
    )
    return F.array_repeat(distractor, n)


def condition_expand(items: DataFrame, modes: Sequence[str] = K.INPUT_MODES, agents: int = K.PEERS) -> DataFrame:
    """Item x input mode x condition work list with the consensus opinions."""
    n = max(1, agents)
    condition = F.struct(
        F.lit("input_mode_comparison").alias("dimension"),
        F.lit(f"target_consensus_n{n}").alias("condition_name"),
        F.lit(f"N{n}").alias("attack_level"),
    )
    listed = items.withColumn("input_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return listed.select("*", F.inline(F.array(condition))).withColumn(
        "opinions", F.array_repeat(F.col("distractor"), n)
    )


def level_expand(items: DataFrame, agents: int = K.PEERS) -> DataFrame:
    """Item x attack level work list."""
    listed = items.withColumn("attack_level", F.explode(F.array(*[F.lit(x) for x in K.ATTACK_LEVELS])))
    return listed.withColumn("opinions", opinion_levels(F.col("distractor"), F.col("attack_level"), agents))


def dimension_filter(df: DataFrame, column: str, selected: Sequence[str], supported: Sequence[str]) -> DataFrame:
    """Rows of the selected names; unknown names are ignored and no usable name keeps everything."""
    usable = [s for s in selected if s in supported]
    return df.where(F.col(column).isin(*usable)) if usable else df


def limit_slice(df: DataFrame, ordinal: str, start: int = 0, limit: int = 0) -> DataFrame:
    """Rows at 0-based positions ``start`` to ``start + limit - 1`` by ascending ordinal; a limit of 0 means no limit.

    The ordinal must be unique and not null, but need not be dense. Its values at both ends are found from the row
    counts of ranges; what is returned is a plain filter on them, so it reaches the scan.
    """
    if not start and not limit:
        return df
    ordered = df.select(ordinal).repartitionByRange(ordinal).sortWithinPartitions(ordinal)
    keys = settle(ordered.select(F.col(ordinal).alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "slice")
    parts = keys.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    position = F.col("at") - F.col("first") + F.col("offset")
    inside = (position >= start) & ((position < start + limit) if limit else F.lit(True))
    low, high = keys.join(offsets, "part").where(inside).agg(F.min("key"), F.max("key")).first()
    return df.where(F.lit(False)) if low is None else df.where(F.col(ordinal).between(low, high))


def option_set_problem(labels: Column, correct: Column, target: Column) -> Column:
    """Why an option set cannot be scored: labels not A-D or A-E in order, gold or target absent, both equal."""
    upper = F.transform(labels, lambda x: F.upper(F.trim(x)))
    known = [F.array(*[F.lit(x) for x in text]) for text in ("ABCD", "ABCDE")]
    return (
        F.when(~F.coalesce((upper == known[0]) | (upper == known[1]), F.lit(False)), F.lit("labels"))
        .when(~F.coalesce(F.array_contains(upper, F.upper(correct)), F.lit(False)), F.lit("correct absent"))
        .when(~F.coalesce(F.array_contains(upper, F.upper(target)), F.lit(False)), F.lit("target absent"))
        .when(F.upper(correct) == F.upper(target), F.lit("correct equals target"))
    )
