"""Lexical and embedding similarity of two texts."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.constants import ANTONYM_PAIRS


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets: 1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def antonym_signal(a: Column, b: Column) -> Column:
    """True when an antonym pair is split across the two token sets."""

    def split(left: str, right: str) -> Column:
        return F.array_contains(a, left) & F.array_contains(b, right)

    return reduce(Column.__or__, [split(x, y) | split(y, x) for x, y in ANTONYM_PAIRS])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of the lower-cased texts; no built-in function gives it."""
    lowered = zip(a.str.lower(), b.str.lower(), strict=True)
    return pd.Series([difflib.SequenceMatcher(a=x, b=y).ratio() for x, y in lowered])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def scores(similarity: Column, antonym: Column) -> dict[str, Column]:
    """Similarity, contradiction and exclusion, rounded to six digits."""
    contradiction = F.when(antonym, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - similarity))
    exclusion = F.least(F.lit(1.0), contradiction + F.when(antonym, F.lit(0.25)).otherwise(F.lit(0.0)))
    return {
        "similarity_score": F.round(similarity, 6),
        "contradiction_score": F.round(contradiction, 6),
        "antonym_signal": antonym,
        "exclusion_score": F.round(exclusion, 6),
    }
