"""Test statistics as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LN2 = math.log(2.0)
LN10 = math.log(10.0)


def _stirling_error(x: str) -> str:
    """ln(x!) minus Stirling's formula: from the factorial up to 20, from the asymptotic series above."""
    return (
        f"CASE WHEN {x} <= 20 THEN ln(cast(factorial(cast(least({x}, 20) AS int)) AS double)) "
        f"- (0.5D * ln(2.0D * pi() * {x}) + {x} * ln({x}) - {x}) "
        f"ELSE (1D / 12 - (1D / 360 - (1D / 1260 - 1D / (1680D * {x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x} END"
    )


def _log_pmf(m: str, n: str) -> str:
    """ln of C(n, m) / 2^n by the saddle-point expansion (Loader 2000): no factorial of a large number."""
    d = f"(({n} - 2.0D * {m}) / {n})"
    deviance = f"(0.5D * {n} * ((1.0D - {d}) * log1p(-{d}) + (1.0D + {d}) * log1p({d})))"
    return (
        f"CASE WHEN {m} = 0 THEN -{n} * {LN2}D ELSE ({_stirling_error(n)}) - ({_stirling_error(m)}) "
        f"- ({_stirling_error(f'({n} - {m})')}) - {deviance} "
        f"+ 0.5D * ln({n} / (2.0D * pi() * {m} * ({n} - {m}))) END"
    )


def mcnemar_log_p(b: str, c: str) -> Column:
    """Natural log of the exact two-sided McNemar p-value from the discordant counts (SQL expressions).

    The tail is summed downwards from min(b, c) as ratios of neighbouring terms. These shrink at least like
    exp(-2j^2/n), so 10 sqrt(n) + 20 of them hold every digit of a double: the work is O(sqrt(n)), not O(n).
    """
    last = "cast(least(s.m, ceil(10.0D * sqrt(s.n)) + 20) AS bigint)"
    grow = (
        "named_struct('term', acc.term * ((s.m - j + 1.0D) / (s.n - s.m + j)), "
        "'total', acc.total + acc.term * ((s.m - j + 1.0D) / (s.n - s.m + j)))"
    )
    tail = (
        f"CASE WHEN {last} >= 1 THEN aggregate(sequence(1L, {last}), named_struct('term', 1.0D, 'total', 1.0D), "
        f"(acc, j) -> {grow}, acc -> acc.total) ELSE 1.0D END"
    )
    body = f"least(0.0D, {LN2}D + ({_log_pmf('s.m', 's.n')}) + ln({tail}))"
    counts = f"array(named_struct('m', cast(least({b}, {c}) AS double), 'n', cast({b} + {c} AS double)))"
    return F.expr(
        f"CASE WHEN {b} < 0 OR {c} < 0 THEN cast(raise_error('discordant counts must not be negative') AS double) "
        f"WHEN {b} + {c} = 0 THEN 0.0D ELSE transform({counts}, s -> {body})[0] END"
    )


def exact_mcnemar(b: str, c: str) -> Column:
    """Exact two-sided McNemar p-value; 1 without discordant pairs."""
    return F.exp(mcnemar_log_p(b, c))


def two_proportion_z(success_a: Column, total_a: Column, success_b: Column, total_b: Column) -> Column:
    """Pooled two-proportion z; null for an empty group or a zero standard error."""
    pooled = F.try_divide((success_a + success_b).cast("double"), total_a + total_b)
    error = F.sqrt(pooled * (1.0 - pooled) * (F.try_divide(F.lit(1.0), total_a) + F.try_divide(F.lit(1.0), total_b)))
    gap = F.try_divide(success_a.cast("double"), total_a) - F.try_divide(success_b.cast("double"), total_b)
    return F.when(error > 0, gap / error)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; used on result rows only, no built-in function gives erfc."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


def resampled_mean_bounds(
    values: Sequence[int], counts: Sequence[int], levels: Sequence[float] = (0.025, 0.975), slack: float = 1e-9
) -> tuple[float, ...] | None:
    """Percentiles of the mean of a resample with replacement, from its whole distribution instead of draws.

    A resample's sum is n independent draws of ``values`` in proportion to ``counts``: its distribution is the inverse
    Fourier transform of the n-th power of one draw's characteristic function. Taken around the mean over twelve standard
    deviations to either side, what lies beyond (under 1e-30) folds back, so the work is O(sqrt(n) log n). A percentile is
    the least mean whose cumulative probability reaches the level, up to ``slack``. None without any count.
    """
    x, held = np.asarray(values, dtype="float64"), np.asarray(counts, dtype="float64")
    n = held.sum()
    if n == 0:
        return None
    share = held / n
    mean = float(share @ x)
    spread = math.sqrt(max(0.0, n * float(share @ (x - mean) ** 2)))
    length = 1 << math.ceil(math.log2(24 * spread + 64))
    middle = round(n * mean)
    turn = 2 * np.pi * np.fft.fftfreq(length)
    wave = np.exp(1j * np.outer(turn, x - middle / n)) @ share
    power = np.exp(n * np.log(np.where(np.abs(wave) < 1e-300, 1e-300, wave)))
    mass = np.fft.fftshift(np.fft.fft(power).real / length)
    upto = np.cumsum(mass)
    sums = middle - length // 2 + np.arange(length)
    return tuple(float(sums[min(np.searchsorted(upto, level - slack), length - 1)] / n) for level in levels)
