"""Repeated subsets, exact percentiles, strata and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.operators.guards import require, require_rows
from pairlens.operators.audits import _fingerprints
from pairlens.operators.inference import CONTRAST, contrast_counts, holm_adjust, rates_and_test
from pairlens.operators.metrics import CONFORMITY_ONLY, PAIRED_METRICS, Metric, condition_summary
from pairlens.operators.pairing import CELL, outcome_code, pair_codes
from pairlens.session import settle

SKETCH_ACCURACY = 10_000
#: Two bits each in an item's code: valid rows, then conformity and harmful conformity.
STRATUM_METRICS = tuple(m for name in ("accuracy", "conformity_rate", "harmful_conformity") for m in PAIRED_METRICS if m.name == name)
#: Leading hexadecimal digits of a hash that are compared with a bound, and how many values they have.
HASH_DIGITS, HASHES = 12, 16.0**12


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one column per entry of ``probs``, and ``n``.

    The built-in exact percentile holds every distinct value of a group in one task. Here a mergeable sketch
    brackets each wanted rank first; only values inside the bracket (about 4/10,000 of a group) are ordered. Where the
    bracket may not hold the rank's neighbours, in groups of up to 20,000 values, it is the whole range; a group whose
    ranks are found outside their bracket is done again over its whole range.
    """
    if not keys:
        whole = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs)
        return whole.drop("_all")
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(probs)
    slack = 2.0 / SKETCH_ACCURACY
    marks = [x for p in probs.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", marks, SKETCH_ACCURACY).alias("_q"),
    )
    small = F.col("n") <= 2 * SKETCH_ACCURACY
    brackets = sketch.select(
        *keys, "n",
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("_i"), F.lit(p).alias("_p"),
                F.when(small, F.col("_lo")).otherwise(F.col("_q")[2 * i]).alias("_from"),
                F.when(small, F.col("_hi")).otherwise(F.col("_q")[2 * i + 1]).alias("_to"),
            )
            for i, p in enumerate(probs.values())
        ])),
    )
    table = settle(brackets, "brackets")
    points = settle(_percentile_points(values, table, keys), "percentiles")
    missed = points.where("_x is null").select(*keys, "_i")
    if not missed.isEmpty():
        ends = sketch.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        whole = table.drop("_from", "_to").join(missed, [*keys, "_i"], "left_semi").join(ends, list(keys))
        again = _percentile_points(values, settle(whole, "brackets"), keys)
        points = points.where("_x is not null").unionByName(again)
    exact = points.withColumn("_x", require(F.col("_x"), F.col("_x").isNotNull(), F.lit("percentile not found"), "double"))
    return exact.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(names)],
    )


def _percentile_points(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _i, _p, n, _x)``: the value at each wanted rank, null where the bracket does not hold it."""
    joined = values.join(brackets, list(keys))
    # Values below the bracket are only counted; those inside are counted per distinct value.
    place = F.when(F.col("_v") < F.col("_from"), F.col("_from")).otherwise(F.col("_v"))
    counted = (
        joined.where(F.col("_v") <= F.col("_to"))
        .groupBy(*keys, "_i", "_p", "n", (F.col("_v") < F.col("_from")).alias("_below"), place.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*keys, "_i").orderBy(F.desc("_below"), "_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counted.withColumn("_upto", F.sum("_c").over(w))
    position = F.col("_p") * (F.col("n") - 1)

    def at(rank: Column) -> Column:
        held = (~F.col("_below")) & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(held, F.col("_v")))

    found = ranked.groupBy(*keys, "_i", "_p", "n").agg(
        at(F.floor(position)).alias("_a"), at(F.ceil(position)).alias("_b")
    )
    weight = position - F.floor(position)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    point = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") * (1.0 - weight) + F.col("_b") * weight
    )
    return found.select(*keys, "_i", "_p", "n", F.when(both, point).alias("_x"))


def repeated_sample(
    frame: DataFrame, size: int = K.SAMPLE_SIZE, repetitions: int = K.SAMPLE_REPETITIONS,
    seed_start: int = K.SAMPLE_SEED_START, group: str = "dataset", item: str = "id",
) -> DataFrame:
    """``size`` items without replacement per group and repetition: those with the smallest seeded md5.

    Hashes are uniform, so the wanted ones lie below a bound that follows from the group's size: a scan keeps the rows
    below a bound that about ``size`` plus six standard deviations of them meet, and only these are shuffled and ordered.
    Repetitions of which fewer are found, if any, are drawn again below twice the bound. A group smaller than ``size``
    fails the query.
    """
    ids = settle(frame.select(group, item), "frame")
    text = F.concat(F.lit("frame too small for the sample: "), F.col(group))
    counts = ids.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("frame_n", require(F.col("_n"), F.col("_n") >= size, text, "bigint"))
    share = F.lit(size + 6.0 * size**0.5 + 16) / F.col("frame_n")
    bounds = counts.select(
        group, "frame_n", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"),
        F.ceil(share * HASHES).alias("_bound"),
    )
    seed = F.lit(seed_start) + F.col("rep") - 1
    digest = F.md5(F.concat_ws("|", seed.cast("string"), F.col(group), F.col(item)))
    leading = F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("bigint")
    kept, short = None, settle(bounds, "sample-bounds")
    while True:
        below = ids.join(short, group).withColumn("_h", digest).where(leading < F.col("_bound"))
        drawn = settle(below.drop("_bound"), "sample-drawn")
        kept = drawn if kept is None else kept.join(short.select(group, "rep"), [group, "rep"], "left_anti").unionByName(drawn)
        held = drawn.groupBy(group, "rep").agg(F.count(F.lit(1)).alias("_held"))
        missed = short.join(held, [group, "rep"], "left").where(F.coalesce("_held", F.lit(0)) < size)
        short = settle(missed.drop("_held").withColumn("_bound", F.col("_bound") * 2), "sample-bounds")
        if short.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy(group, "rep").orderBy("_h", item))
    return kept.withColumn("_r", rank).where(F.col("_r") <= size).select(group, "rep", seed.alias("seed"), "frame_n", item)


def sample_membership(samples: DataFrame, group: str = "dataset", item: str = "id") -> DataFrame:
    """One row per sampled item with the list of repetitions it is in (at most the number of repetitions)."""
    return samples.groupBy(group, item).agg(F.collect_list("rep").alias("reps"))


def repeated_deltas(
    df: DataFrame, samples: DataFrame, contrasts: Sequence[tuple[str, str]] = K.DEFAULT_CONTRASTS,
    metrics: Sequence[Metric] = PAIRED_METRICS, keys: Sequence[str] = CELL,
) -> DataFrame:
    """Paired rates and delta per repetition. Items are paired once; repetitions are added after that."""
    members = settle(sample_membership(samples), "sample-members")
    chosen = df.join(members.drop("reps"), ["dataset", "id"], "left_semi")
    pairs = pair_codes(chosen, contrasts, metrics, keys).join(members, ["dataset", "id"])
    counts = contrast_counts(pairs.withColumn("rep", F.explode("reps")), metrics, [*keys, "rep", *CONTRAST])
    n = F.col("paired_n")
    return counts.where(n > 0).select(
        *keys, "rep", *CONTRAST, "metric_order", "metric", "paired_n",
        (F.col("_hits1") / n).alias("rate1"), (F.col("_hits2") / n).alias("rate2"),
        ((F.col("_c") - F.col("_b")) / n).alias("delta"),
    )


def repeated_conditions(
    df: DataFrame, samples: DataFrame, metrics: Sequence[Metric] = PAIRED_METRICS, keys: Sequence[str] = CELL,
) -> DataFrame:
    """Condition rates per repetition in long form; metrics without an eligible row are left out."""
    members = settle(sample_membership(samples), "sample-members")
    chosen = df.join(members, ["dataset", "id"]).withColumn("rep", F.explode("reps"))
    wide = condition_summary(chosen, [*keys, "condition", "rep"], metrics)
    rows = F.array(*[
        F.struct(F.lit(m.name).alias("metric"), F.col(f"{m.name}_n").alias("denominator_n"),
                 F.col(m.name).alias("value"))
        for m in metrics
    ])
    return wide.select(*keys, "condition", "rep", F.inline(rows)).where("value IS NOT NULL")


def repeated_aggregate(df: DataFrame, value: str, denominator: str, keys: Sequence[str], mean_name: str) -> DataFrame:
    """Mean, sample deviation (0 for one value) and 2.5/97.5 percentiles over repetitions."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repetitions"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.percentile(value, 0.025).alias("empirical_low"),
        F.percentile(value, 0.975).alias("empirical_high"),
        F.avg(denominator).alias(mean_name),
    )


# --- strata -------------------------------------------------------------------------------------------------

def tercile_thresholds(scored: DataFrame, keys: Sequence[str] = CELL, value: str = "target_probability") -> DataFrame:
    """Lower and upper tercile bound per cell."""
    return exact_percentiles(scored, keys, value, {"q33": 1 / 3, "q67": 2 / 3})


def assign_stratum(
    scored: DataFrame, thresholds: DataFrame, keys: Sequence[str] = CELL, value: str = "target_probability"
) -> DataFrame:
    """Low up to q33, Medium up to q67, High above; equal values share a stratum."""
    bounds = settle(thresholds.select(*keys, "q33", "q67"), "thresholds")
    p = F.col(value)
    stratum = F.when(p <= F.col("q33"), "Low").when(p <= F.col("q67"), "Medium").otherwise("High")
    return scored.join(bounds, list(keys)).withColumn("stratum", stratum).drop("q33", "q67")


def stratum_items(
    df: DataFrame, conditions: Sequence[str], fields: Sequence[str] = (), keys: Sequence[str] = CELL, item: str = "id",
) -> DataFrame:
    """One row per item: the codes of its conditions (``c0``, ``c1``, ..) for ``STRATUM_METRICS``, its labels, and the audit
    ``fields`` in which its valid rows differ.

    This is the only exchange of response rows that thresholds, rates and contrasts of strata need. A repeated item within
    a condition fails the query.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    prints = {f: _fingerprints(f, kinds[f]) for f in fields}
    rows = df.where(F.col("condition").isin(*conditions)).select(
        *keys, item, F.col("condition").alias("_cond"), outcome_code(STRATUM_METRICS).alias("_code"), "correct", "distractor",
        *[F.when(F.col("valid"), h).alias(f"_{f}{i}") for f, both in prints.items() for i, h in enumerate(both)],
    )
    wide = rows.groupBy(*keys, item).agg(
        F.max("correct").alias("correct"), F.max("distractor").alias("distractor"),
        *[F.max(F.when(F.col("_cond") == c, F.col("_code"))).alias(f"c{k}") for k, c in enumerate(conditions)],
        *[F.count_if(F.col("_cond") == c).alias(f"_n{k}") for k, c in enumerate(conditions)],
        *[g(f"_{f}{i}").alias(f"_{n}_{f}{i}") for f in fields for i in (0, 1) for n, g in (("lo", F.min), ("hi", F.max))],
    )
    once = F.greatest(*[F.col(f"_n{k}") for k in range(len(conditions))], F.lit(0)) <= 1
    text = F.concat(F.lit("duplicate item id "), F.col(item).cast("string"))
    drift = [F.when((F.col(f"_lo_{f}0") != F.col(f"_hi_{f}0")) | (F.col(f"_lo_{f}1") != F.col(f"_hi_{f}1")), F.lit(f)) for f in fields]
    changed = F.array_join(F.filter(F.array(*drift), lambda x: x.isNotNull()), ",") if fields else F.lit("")
    codes = [require(F.col(f"c{k}"), once, text, "int").alias(f"c{k}") for k in range(len(conditions))]
    return wide.select(*keys, item, "correct", "distractor", *codes, changed.alias("fields"))


def stratum_histogram(
    strata: DataFrame, conditions: int, keys: Sequence[str] = CELL, value: str = "target_probability"
) -> DataFrame:
    """Items per stratum and set of codes, with the range of the score: a few rows per cell, from which rates and
    contrasts are summed."""
    codes = [f"c{k}" for k in range(conditions)]
    return strata.groupBy(*keys, "stratum", *codes).agg(F.count(F.lit(1)).alias("items"), F.min(value).alias("_low"), F.max(value).alias("_high"))


def metrics_of_histogram(histogram: DataFrame, conditions: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """What ``stratum_metrics`` gives of rows, from ``stratum_histogram``."""
    cases = ", ".join(f"named_struct('condition', '{c}', 'code', c{k})" for k, c in enumerate(conditions))
    rows = histogram.selectExpr(*keys, "stratum", "items", "_low", "_high", f"inline(array({cases}))").where("code is not null")

    def count(bits: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(bits), F.col("items"))), F.lit(0))

    found = rows.groupBy(*keys, "condition", "stratum").agg(
        F.sum("items").alias("stratum_n"), F.min("_low").alias("target_probability_min"), F.max("_high").alias("target_probability_max"),
        count("code & 4 = 4").alias("cr_n"), F.try_divide(count("code & 12 = 12").cast("double"), count("code & 4 = 4")).alias("cr"),
        count("code & 16 = 16").alias("hcr_n"), F.try_divide(count("code & 48 = 48").cast("double"), count("code & 16 = 16")).alias("hcr"),
    )
    return _all_strata(found, keys)


def contrasts_of_histogram(
    histogram: DataFrame, conditions: Sequence[str], contrasts: Sequence[tuple[str, str]], keys: Sequence[str] = CELL
) -> DataFrame:
    """Conformity contrasts per stratum, tested and adjusted, from ``stratum_histogram``."""
    at = {c: f"shiftright(c{k}, 2) & 3" for k, c in enumerate(conditions)}
    unknown = {c for pair in contrasts for c in pair} - set(at)
    if unknown:
        raise ValueError(f"contrast of a condition that is not compared: {sorted(unknown)}")
    cases = ", ".join(
        f"named_struct('contrast', {i}, 'condition1', '{a}', 'condition2', '{b}', 'code1', {at[a]}, 'code2', {at[b]})"
        for i, (a, b) in enumerate(contrasts)
    )
    pairs = histogram.selectExpr(*keys, "stratum", "items", f"inline(array({cases}))")
    counts = contrast_counts(pairs, CONFORMITY_ONLY, [*keys, "stratum", *CONTRAST], "items")
    return holm_adjust(rates_and_test(counts), ("metric",), order=[*keys, "stratum", "contrast"])


def stratum_sizes(strata: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return strata.groupBy(*keys).agg(
        *[F.count_if(F.col("stratum") == s).alias(f"{s.lower()}_n") for s in ("Low", "Medium", "High")]
    )


def stratum_metrics(rows: DataFrame, keys: Sequence[str] = CELL, value: str = "target_probability") -> DataFrame:
    """Rates per stratum and condition with the probability range; input rows carry ``stratum``."""
    adopted = (F.col("final") == F.col("distractor")).cast("double")
    open_, right = F.col("initial") != F.col("distractor"), F.col("initial") == F.col("correct")
    found = rows.groupBy(*keys, "condition", "stratum").agg(
        F.count(F.lit(1)).alias("stratum_n"),
        F.min(value).alias("target_probability_min"),
        F.max(value).alias("target_probability_max"),
        F.count_if(open_).alias("cr_n"),
        F.avg(F.when(open_, adopted)).alias("cr"),
        F.count_if(right).alias("hcr_n"),
        F.avg(F.when(right, adopted)).alias("hcr"),
    )
    return _all_strata(found, keys)


def _all_strata(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A stratum without items still gets its row: counts 0, rates and range null."""
    names = [c for c in found.columns if c not in {*keys, "condition", "stratum"}]
    packed = found.groupBy(*keys, "condition").agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", F.struct(*names).alias("s")))).alias("_m")
    )
    strata = F.explode(F.array(*[F.lit(s) for s in ("Low", "Medium", "High")]))
    filled = packed.withColumn("stratum", strata).withColumn("_s", F.try_element_at("_m", F.col("stratum")))
    zero = {"stratum_n", "cr_n", "hcr_n"}
    return filled.select(
        *keys, "condition", "stratum",
        *[(F.coalesce(F.col("_s")[c], F.lit(0)).cast("bigint") if c in zero else F.col("_s")[c]).alias(c)
          for c in names],
    )


# --- top-k and representative values ------------------------------------------------------------------------

def near_far_groups(df: DataFrame, size: int, ordinal: str = "id") -> DataFrame:
    """The ``size`` most similar rows and the ``size`` most exclusive of the rest; ties keep input order."""
    near = df.orderBy(F.desc("similarity_score"), ordinal).limit(size)
    near = settle(near, "near").withColumn("group", F.lit("near_similar"))
    # Only the top 2 x size can hold the first ``size`` rows that are not near.
    ordered = df.orderBy(F.desc("exclusion_score"), F.asc("similarity_score"), ordinal).limit(2 * size)
    rest = ordered.join(near.select(ordinal), ordinal, "left_anti")
    far = rest.orderBy(F.desc("exclusion_score"), F.asc("similarity_score"), ordinal).limit(size)
    return near.unionByName(far.withColumn("group", F.lit("far_exclusive")))


def modal_value(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; equal counts go to the smaller one."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(value),
        F.max("_n").alias("frequency"), F.sum("_n").alias("observed_n"),
    )


def candidate_texts(candidates: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """Candidate list without repeats, whitespace collapsed; a stance word is an error."""
    cleaned = dict.fromkeys(" ".join(t.split()) for t in (*candidates, *extra))
    kept = [t for t in cleaned if t]
    for text in kept:
        if any(term in text.lower() for term in K.STANCE_TERMS):
            raise ValueError(f"candidate holds a stance word: {text!r}")
    return kept


def acknowledgement_candidates(extra: Sequence[str] = ()) -> list[str]:
    composed = [f"{p} {s}" for p in K.ACK_PREFIXES for s in K.ACK_SUFFIXES]
    return candidate_texts([*K.ACK_EXPLICIT, *composed], extra)


def _listed(candidates: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("text")) for i, t in enumerate(candidates)
    ])


def control_select(turns: DataFrame, text: str, candidates: Sequence[str], counter) -> DataFrame:
    """The first two candidates as long as the modal observed turn; fewer than two fail the query."""
    mode = modal_value(turns.select(counter(F.col(text)).alias("target_tokens")), "target_tokens")
    scored = mode.select("target_tokens", "observed_n", F.inline(_listed(candidates)))
    match = scored.where(counter(F.col("text")) == F.col("target_tokens"))
    picked = match.groupBy("target_tokens", "observed_n").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_m")
    )
    # One row per candidate at most, so the list is as short as the candidate table.
    enough = F.size("_m") >= 2
    return picked.select(
        "target_tokens", "observed_n", F.size("_m").alias("matching_candidate_n"),
        require(F.get("_m", F.lit(0))["text"], enough, "fewer than two matching candidates").alias("neutral_v1"),
        F.get("_m", F.lit(1))["text"].alias("neutral_v2"),
    )


def closest_candidate(turns: DataFrame, text: str, candidates: Sequence[str], counter) -> DataFrame:
    """Candidate with the smallest length gap to the modal turn; the first wins a tie."""
    mode = modal_value(turns.select(counter(F.col(text)).alias("target_tokens")), "target_tokens")
    scored = mode.select("target_tokens", F.inline(_listed(candidates))).withColumn(
        "gap", counter(F.col("text")) - F.col("target_tokens")
    )
    return scored.groupBy("target_tokens").agg(
        F.min_by(F.struct("text", "gap"), F.struct(F.abs("gap"), F.col("ordinal"))).alias("_b")
    ).select("target_tokens", F.col("_b.text").alias("text"), F.col("_b.gap").alias("gap"))


def label_audit(items: DataFrame, candidates: Sequence[str], difference) -> DataFrame:
    """Per candidate label: items, items without a length difference, and the distinct differences.

    ``difference(label)`` is a Column over the item row.
    """
    rows = items.select("*", F.inline(_listed(candidates)))
    scored = rows.select("ordinal", F.col("text").alias("label"), difference(F.col("text")).alias("_d"))
    # Distinct differences first: their number is small whatever the number of items.
    distinct = scored.groupBy("ordinal", "label", "_d").agg(F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy("ordinal", "label").agg(
        F.sum("_n").alias("item_n"),
        F.coalesce(F.sum(F.when(F.col("_d") == 0, F.col("_n"))), F.lit(0)).cast("bigint").alias("exact_match_n"),
        F.array_join(F.transform(F.array_sort(F.collect_set("_d")), lambda d: d.cast("string")), ",")
        .alias("difference_values"),
    )


def label_select(audit: DataFrame) -> DataFrame:
    """First candidate that matches on every item; none fails the query."""
    exact = F.col("exact_match_n") == F.col("item_n")
    best = audit.agg(F.min_by(F.when(exact, F.col("label")), F.when(exact, F.col("ordinal"))).alias("label"))
    return require_rows(best, "label", F.col("label").isNotNull(), "no label matches on every item")


def sample_rows(df: DataFrame, keys: Sequence[str], ordinal: str, n: int = 5) -> DataFrame:
    """First ``n`` rows per group in input order."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def report_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows sorted by a given category order; unknown categories last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("report_rank", F.when(at > 0, at)).orderBy(F.asc_nulls_last("report_rank"), column)
