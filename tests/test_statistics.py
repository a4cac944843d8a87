"""Published results that depend on counts only, and brute force for the rest."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.statistics import exact_mcnemar, mcnemar_log_p, resampled_mean_bounds, two_sided_p
from pairlens.operators import inference as I
from pairlens.operators import sampling as R

# b, c, n, p, delta (second minus first), interval
PUBLISHED = [
    (261, 0, 468, 5.4e-79, -0.5577, (-0.6026, -0.5128)),
    (220, 2, 433, 7.35e-63, -0.5035, (-0.5497, -0.4550)),
    (323, 10, 471, 4.75e-82, -0.6645, (-0.7113, -0.6178)),
    (8, 39, 468, 5.54e-06, 0.0662, (0.0385, 0.0940)),
    (12, 142, 467, 2.286264010158805e-29, 0.278372591006424, (0.2334, 0.3233)),
    (1, 306, 467, 2.362501230174531e-90, 0.6531049250535332, (0.6081, 0.6981)),
    (55, 14, 467, 6.921916920059638e-07, -0.08779443254817987, (-0.1199, -0.0535)),
    (137, 17, 500, 1.728718686048066e-24, -0.24, (-0.284, -0.196)),
]


def binomial_p(b: int, c: int) -> float:
    n, m = b + c, min(b, c)
    tail = sum(math.comb(n, k) for k in range(m + 1))
    return min(1.0, 2 * tail / 2**n) if n else 1.0


def test_published_p_and_interval(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(PUBLISHED)], "i int, b bigint, c bigint, n bigint")
    rows = rows.selectExpr("i", "b AS mcnemar_b", "c AS mcnemar_c", "n AS paired_n").withColumn(
        "p", exact_mcnemar("mcnemar_b", "mcnemar_c"))
    for row in I.add_paired_ci(rows, ("i",)).collect():
        b, c, n, p, delta, (low, high) = PUBLISHED[row.i]
        assert row.p == pytest.approx(p, rel=5e-3)
        assert row.p == pytest.approx(binomial_p(b, c), rel=1e-11)
        assert (c - b) / n == pytest.approx(delta, abs=6e-5)
        assert row.ci_low == pytest.approx(low, abs=0.01) and row.ci_high == pytest.approx(high, abs=0.01)


def test_mcnemar_against_exact_fractions(spark):
    rng = random.Random(3)
    pairs = [(0, 0), (0, 1), (1, 1), (20, 21), (21, 20), (500, 480), (900, 1100)]
    pairs += [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "b bigint, c bigint").withColumn("p", exact_mcnemar("b", "c"))
    for b, c, p in rows.collect():
        assert p == pytest.approx(binomial_p(b, c), rel=1e-10)


def test_mcnemar_of_very_large_counts(spark):
    rows = spark.createDataFrame([(500_000_000, 500_030_000)], "b bigint, c bigint")
    found = rows.select(mcnemar_log_p("b", "c").alias("x")).first().x
    z = (30_000 - 1) / math.sqrt(1_000_030_000)
    assert math.exp(found) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_mcnemar_rejects_negative_counts(spark):
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1, 2)], "b bigint, c bigint").select(exact_mcnemar("b", "c")).collect()


def test_holm(spark):
    rows = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.03), ("k", None)], "metric string, p_raw double")
    found = {(r.metric, r.p_raw): r.p_holm for r in I.holm_adjust(rows).collect()}
    assert found[("m", 0.01)] == pytest.approx(0.03)
    assert found[("m", 0.03)] == pytest.approx(0.06) and found[("m", 0.04)] == pytest.approx(0.06)
    assert found[("k", None)] is None


def test_two_sided_p(spark):
    row = spark.createDataFrame([(1.96,), (None,)], "z double").withColumn("p", two_sided_p("z")).collect()
    assert row[0].p == pytest.approx(0.04999579, rel=1e-6) and row[1].p is None


def trinomial_bounds(b, c, n, levels=(0.025, 0.975)):
    """Every way of drawing n items, summed in logarithms."""
    mass = {}
    for i in range(n + 1 if b else 1):
        for j in range(n - i + 1 if c else 1):
            r = n - i - j
            if r and b + c == n:
                continue
            log = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(j + 1) - math.lgamma(r + 1)
            log += (i * math.log(b / n) if i else 0) + (j * math.log(c / n) if j else 0) + (r * math.log1p(-(b + c) / n) if r else 0)
            mass[j - i] = mass.get(j - i, 0.0) + math.exp(log)
    out, upto = [], 0.0
    for level in levels:
        upto = 0.0
        for s in sorted(mass):
            upto += mass[s]
            if upto >= level - 1e-9:
                out.append(s / n)
                break
    return tuple(out)


@pytest.mark.parametrize(("b", "c", "n"), [(0, 0, 1), (1, 0, 1), (0, 3, 3), (1, 1, 2), (2, 5, 30), (0, 7, 40), (12, 3, 60), (50, 0, 50), (1, 0, 200), (30, 40, 120)])
def test_exact_bounds_against_every_resample(b, c, n):
    assert resampled_mean_bounds((-1, 1, 0), (b, c, n - b - c)) == pytest.approx(trinomial_bounds(b, c, n), abs=1e-12)


def test_exact_bounds_at_any_size():
    assert resampled_mean_bounds((-1, 1, 0), (0, 0, 0)) is None
    assert resampled_mean_bounds((-1, 1, 0), (0, 0, 9)) == (0.0, 0.0)
    for n in (10**4, 10**7, 10**10):
        low, high = resampled_mean_bounds((-1, 1, 0), (n // 10, n // 5, n - n // 10 - n // 5))
        width = 1.959964 * math.sqrt((0.3 - 0.01) / n)
        assert low == pytest.approx(0.1 - width, abs=1.5 / n + 0.02 * width) and high == pytest.approx(0.1 + width, abs=1.5 / n + 0.02 * width)
    draws = np.random.default_rng(1).multinomial(450, np.array([5, 230, 210, 5, 0]) / 450, size=200_000) @ np.array([-2, -1, 0, 1, 2]) / 450
    assert resampled_mean_bounds((-2, -1, 0, 1, 2), (5, 230, 210, 5, 0)) == pytest.approx(np.quantile(draws, [0.025, 0.975]), abs=1.01 / 450)


def test_published_intervals_without_draws(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(PUBLISHED)], "i int, mcnemar_b bigint, mcnemar_c bigint, paired_n bigint")
    for row in I.add_paired_ci(rows).collect():
        *_, n, _, _, (low, high) = PUBLISHED[row.i]
        # the published ones come from 10,000 draws: at most one item away
        assert row.ci_low == pytest.approx(low, abs=1.01 / n + 6e-5) and row.ci_high == pytest.approx(high, abs=1.01 / n + 6e-5)


def test_drawn_intervals_agree(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(PUBLISHED)], "i int, mcnemar_b bigint, mcnemar_c bigint, paired_n bigint")
    drawn = {r.i: r for r in I.add_paired_ci(rows, ("i",), reps=20_000).collect()}
    for row in I.add_paired_ci(rows).collect():
        assert drawn[row.i].ci_low == pytest.approx(row.ci_low, abs=1.01 / row.paired_n) and drawn[row.i].ci_high == pytest.approx(row.ci_high, abs=1.01 / row.paired_n)


def test_interval_of_an_interaction(spark):
    rows = spark.createDataFrame([(0, 5, 230, 210, 5, 0)], "i int, v_m2 bigint, v_m1 bigint, v_0 bigint, v_p1 bigint, v_p2 bigint")
    row = I.interaction_ci(rows, 10_000, seed_keys=("i",)).first()
    exact = I.interaction_ci(rows).first()
    assert exact.ci_low == pytest.approx(row.ci_low, abs=1.01 / 450) and exact.ci_high == pytest.approx(row.ci_high, abs=1.01 / 450)
    mean = (-2 * 5 - 230 + 5) / 450
    assert row.ci_low < mean < row.ci_high and 0.06 < row.ci_high - row.ci_low < 0.12


def test_exact_percentiles_use_the_bracket_for_large_groups(spark):
    # One group above the size that keeps its whole range, half of it a single repeated value.
    n = 60_001
    df = spark.range(n).select(
        F.lit("g").alias("g"),
        F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.pow(F.lit(10.0), -(F.col("id") * 7919 % 9973) / 1000.0)).alias("v"),
    )
    values = sorted(r.v for r in df.collect())
    probs = {"a": 1 / 3, "b": 2 / 3, "c": 0.025, "d": 0.975, "lo": 0.0, "hi": 1.0}
    row = R.exact_percentiles(df, ["g"], "v", probs).first()
    for name, p in probs.items():
        at = p * (n - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert row[name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)
    whole = R.exact_percentiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == values[n // 2]


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """A sketch too coarse for its brackets: the ranks are found all the same."""
    monkeypatch.setattr(R, "SKETCH_ACCURACY", 7)
    rng = random.Random(4)
    data = [(g, rng.random() ** 3) for g in ("a", "b") for _ in range(900)]
    found = {r.g: r for r in R.exact_percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"low": 0.025, "high": 0.9}).collect()}
    for g in ("a", "b"):
        own = [v for h, v in data if h == g]
        assert (found[g].low, found[g].high) == pytest.approx(tuple(np.quantile(own, [0.025, 0.9])), rel=1e-12)


def test_samples_that_fall_short_are_drawn_again(spark, monkeypatch):
    """Bounds far too low at first: the samples are those of the plain order, whatever the bound."""
    import hashlib

    frame = spark.createDataFrame([(g, str(i)) for g in ("x", "y") for i in range(300)], "dataset string, id string")
    want = {
        (g, rep, i) for g in ("x", "y") for rep in range(1, 5)
        for i in sorted(map(str, range(300)), key=lambda i: (hashlib.md5(f"{1000 + rep - 1}|{g}|{i}".encode()).hexdigest(), i))[:20]
    }
    usual = {(r.dataset, r.rep, r.id) for r in R.repeated_sample(frame, 20, 4).collect()}
    monkeypatch.setattr(R, "HASHES", 16.0**12 / 40)
    again = R.repeated_sample(frame, 20, 4).collect()
    assert usual == want and {(r.dataset, r.rep, r.id) for r in again} == want
    assert {(r.frame_n, r.seed - r.rep) for r in again} == {(300, 999)}
    with pytest.raises(Exception, match="frame too small"):
        R.repeated_sample(frame, 301, 2).collect()
