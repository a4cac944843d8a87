"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document gets the rate that changes the uniform weighting least, in relative entropy, while each source yields its
target of words and no document exceeds ``most`` times its size: ``min(most, exp(lambda * size / mean size))`` with one
multiplier per source, the solution of the convex dual. Newton steps, kept inside a bracket, run for all sources at once on
the histogram of (source, size), whose sums are exact decimals, so a rerun takes the same steps. Rates become copies: the
whole part at once, and one copy more for the documents that come first by a keyed order; the last of these is cut, so a
source's words add up to its target rounded. The place in that order where a source is full is found from sums over bins of
it, never by sorting the source.

Sizes count runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; a null or
empty text has size 0 and is returned with 0 words. A null source is a source of its own, ordered last. Ids may be null or
repeat: each row is a document. An empty table gives an empty result. Only the columns named are read, so others may have
any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the keyed order, and how many of them each search step looks at.
ORDER_BITS, STEP_BITS = 52, 13
#: A search ends when so few rows of a source are left that they can be ranked directly.
FEW = 1 << 16
#: Newton ends when every source's words are this near their target, relatively.
NEAR = 1e-9


def mix(
    documents: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, *keep, size, source_size, target, rate, taken)`` for each document.

    ``weights`` go to the sources in order of their code points, repeating. ``taken`` is the number of words of the
    document in the mix: whole copies of it, and of one document a source a part copy at the end.
    """
    narrow = documents.select(
        F.struct(F.col(f"`{key}`").alias(key), *(F.col(f"`{c}`") for c in keep)).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("order"),
    )
    narrow = settle(narrow, "mix-documents")
    histogram = settle(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    wanted = targets(histogram, weights, most)
    solved = balance(histogram, wanted, most)
    placed = _placed(narrow, solved, most)
    mixed = _rounded(placed, wanted)
    return mixed.select("row.*", "size", F.col("source_size"), "target", "rate", "taken")


def targets(histogram: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``(sid, source, source_size, rows, least, target)``: shares by weight, stopped at ``most`` times a source's size."""
    words = F.col("n") * F.col("size")
    sums = histogram.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("n").alias("rows"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ordered = settle(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    # the rank of a source: rows of the sorted partitions before its own, a row a partition
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("here"))
    parts = parts.select("part", F.expr("sum(here) over (order by part) - here").alias("before"))
    ranked = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = ranked.select(rank.alias("sid"), "source", "source_size", "rows", "least", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight"))
    weighed = settle(weighed, "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, found = -1.0, 0.0
    while found != level:
        level = found
        stopped = F.col("source_size") * most <= F.col("weight") * level
        full, free = weighed.agg(F.sum(F.when(stopped, F.col("source_size") * most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        found = (total - (full or 0)) / free if free else level
    target = F.least(F.col("source_size") * float(most), F.col("weight") * level)
    return weighed.select("sid", "source", "source_size", "rows", "least", target.alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(multiplier * size / mean))


def balance(histogram: DataFrame, wanted: DataFrame, most: int, most_steps: int = 100) -> DataFrame:
    """``(sid, source, source_size, target, mean, multiplier)``; a null multiplier means ``most`` copies of all."""
    known = wanted.withColumn("mean", F.col("source_size") / F.col("rows"))
    cells = histogram.where("size > 0").alias("h").join(known.alias("w"), F.expr("h.source <=> w.source")).select("w.sid", "h.size", "h.n", "w.mean")
    cells = settle(cells, "mix-cells")
    full = F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))
    state = known.withColumn("multiplier", F.when(~full, F.lit(0.0)))
    # with no step above, all are at most exp(0) = 1; at the upper end every document is at its cap
    state = state.withColumn("low", F.lit(-float("inf"))).withColumn("high", F.log(F.lit(float(most))) * F.col("mean") / F.col("least"))
    state = settle(state, "mix-state")
    for _ in range(most_steps):
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("s.mean"), most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * F.col("size") / F.col("s.mean")).otherwise(F.lit(0.0))
        exact = "decimal(38,6)"
        sums = cells.drop("mean").alias("c").join(state.where("multiplier is not null").select("sid", "multiplier", "mean").alias("s"), "sid").groupBy("sid").agg(
            F.sum(words.cast(exact)).cast("double").alias("words"), F.sum(slope.cast(exact)).cast("double").alias("slope")
        )
        sums = settle(sums.join(state.select("sid", "target"), "sid").withColumn("over", F.col("words") - F.col("target")), "mix-sums")
        worst = sums.agg(F.max(F.abs("over") / F.col("target"))).first()[0]
        if worst is None or worst <= NEAR:
            break
        step = state.join(sums.select("sid", "over", "slope"), "sid", "left")
        step = step.withColumn("low", F.when(F.col("over") < 0, F.col("multiplier")).otherwise(F.col("low")))
        step = step.withColumn("high", F.when(F.col("over") > 0, F.col("multiplier")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - F.col("over") / F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        halved = F.when(F.col("low") == -float("inf"), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        settled = F.col("over").isNull() | (F.col("over") == 0)
        step = step.withColumn("multiplier", F.when(settled, F.col("multiplier")).when(inside, newton).otherwise(halved))
        state = settle(step.select(*state.columns), "mix-state")
    return state.select("sid", "source", "source_size", "target", "mean", "multiplier")


def _placed(narrow: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """Documents with their rate, whole copies and place in the order of those that get one more."""
    joined = narrow.alias("d").join(solved.alias("s"), F.expr("d.source <=> s.source"))
    rate = F.when(F.col("s.multiplier").isNull(), F.lit(float(most))).when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("s.multiplier"), F.col("size"), F.col("s.mean"), most))
    rows = joined.select("d.row", "d.size", "d.order", "s.sid", "s.source_size", "s.target", rate.alias("rate")).withColumn("whole", F.floor("rate"))
    unit = 1 << (ORDER_BITS - 2)
    early = F.shiftrightunsigned("order", 64 - (ORDER_BITS - 2)) - F.floor((F.col("rate") - F.col("whole")) * unit) + unit
    rows = rows.withColumn("place", F.when((F.col("size") > 0) & (F.col("rate") < most), early)).drop("order")
    return settle(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-placed")


def _rounded(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add ``taken``: whole copies, and the rest of a source's target from the documents first in order."""
    sums = placed.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("whole_words"))
    left = F.greatest(F.round("target").cast("long") - F.col("whole_words"), F.lit(0))
    search = settle(wanted.join(sums, "sid").select("sid", left.alias("left"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before")), "mix-search")
    shift = ORDER_BITS
    while shift > 0:
        # the bin in which the source is full: sums of words by bin, a few thousand bins a source
        inside = placed.select("sid", "size", "place").join(search.select("sid", "bin"), "sid").where(F.shiftright("place", shift) == F.col("bin"))
        shift -= STEP_BITS
        bins = inside.groupBy("sid", F.shiftright("place", shift).alias("next")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = bins.join(search, "sid").withColumn("upto", F.col("before") + F.expr("sum(words) over (partition by sid order by next)"))
        ends = upto.where("upto > left").groupBy("sid").agg(F.min(F.struct("next", (F.col("upto") - F.col("words")).alias("before"), "rows")).alias("e"))
        # a source whose documents do not fill it takes them all: its bin lies behind the last
        found = search.join(ends, "sid", "left").select("sid", "left", F.coalesce("e.next", F.lit(1 << (ORDER_BITS - shift))).alias("bin"), F.coalesce("e.before", "before").alias("before"), F.coalesce("e.rows", F.lit(0)).alias("rows"))
        found = settle(found, "mix-search")
        search = found.drop("rows")
        if (found.agg(F.max("rows")).first()[0] or 0) <= FEW:
            break
    rows = placed.join(search, "sid")
    here = F.shiftright("place", shift)
    outside = rows.where(F.col("place").isNull() | (here != F.col("bin"))).withColumn("more", F.when(here < F.col("bin"), F.col("size")).otherwise(F.lit(0)))
    edge = rows.where(here == F.col("bin")).withColumn("part", F.shiftright("rid", 33))
    groups = edge.groupBy("sid", "place", "size", "part").agg(F.count(F.lit(1)).alias("rows"), F.first("left").alias("left"), F.first("before").alias("before"))
    start = F.col("before") + F.expr("sum(rows * size) over (partition by sid order by place, size, part) - rows * size")
    groups = groups.select("sid", "place", "size", "part", (F.col("left") - start).alias("room"))
    rank = F.expr("row_number() over (partition by sid, place, size, part order by rid) - 1")
    edge = edge.withColumn("rank", rank).join(groups, ["sid", "place", "size", "part"])
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("rank") * F.col("size"))))
    out = [*placed.columns, "more"]
    return outside.select(*out).union(edge.select(*out)).withColumn("taken", F.col("whole") * F.col("size") + F.col("more"))
