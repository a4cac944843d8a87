"""Document quality by hierarchical empirical Bayes.

A naive Bayes classifier over word-shape and repetition features gives each document's evidence, as a log likelihood ratio.
Its calibrated probabilities are summed per path and per host, and the counts of either level shrink towards the level
above: a path towards its host's posterior mean, a host towards the global share. How strongly is itself estimated, from
the spread between groups (method of moments for the beta-binomial). A document's posterior adds its own evidence to the
log odds of its path's posterior, so a site with few documents hardly moves the global prior.

Only grouped sums leave a task; a host with a third of all rows is combined before the shuffle. Labels are used in a
bounded sample (``Settings.label_rows``, by hash); texts are read whole and every document counts in its site's sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import settle, slices, strings

FEATURES = ("words", "mean_length", "distinct", "upper", "symbols", "digits", "top_word", "repeated_lines", "repeated_pairs", "line_length", "deflated")
EDGES = 12


@dataclass(frozen=True)
class Settings:
    """``label_rows`` bounds the labelled rows used (in expectation); ``reject_below`` is a posterior."""

    label_rows: int = 12_000
    reject_below: float = 0.1
    least_strength: float = 20.0


@dataclass
class Model:
    """Cut points of each feature, log likelihood ratio of each bin, scale of their sum, and the global share of good rows."""

    cuts: list[np.ndarray]
    ratios: list[np.ndarray]
    scale: float
    share: float
    settings: Settings


def measures(text: str) -> list[float]:
    """Feature values of a whole text; those of a text without words are 0."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    size = len(text)
    letters = sum(map(len, words))
    plain = len(text.translate(_DROP))
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    return [
        float(n), letters / n, len(kinds) / n**0.8, sum(map(str.isupper, words)) / n, (letters - plain) / letters, sum(w.strip(".,").isdigit() for w in words) / n,
        max(kinds.values()) / n, 1 - len(set(lines)) / len(lines), 1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1), size / len(lines),
        len(zlib.compress(data, 1)) / len(data),
    ]


_DROP = {c: None for c in [*range(48), *range(58, 65), *range(91, 97), *range(123, 128)] if chr(c) not in ".,"}


def _measured(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by the array ``measures``."""
    kept = [c for c in rows.columns if c not in ("text", "measures")]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("measures", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measures(t or "") for t in strings(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.float64()))], names=[*kept, "measures"])

    return rows.select(*kept, "text").mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labels(doc_id, quality)`` of ``documents(doc_id, text)``; rows with a null in either are left out.

    Without labelled rows the evidence of every document is 0 and the global share 1/2.
    """
    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") > 0).cast("double").alias("good"))
    share = min(1.0, settings.label_rows / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")  # bounded by the draw
    table = settle(_measured(sample.select("text", "good")), "quality-sample").toPandas()
    if not len(table):
        return Model([], [], 1.0, 0.5, settings)
    x, y = np.array(table["measures"].tolist()), table["good"].to_numpy()
    n, good = len(y), y.sum()
    cuts, ratios, total = [], [], np.zeros(n)
    for j in range(x.shape[1]):
        edge = np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, EDGES + 1)[1:-1]), np.quantile(x[y == 0, j], np.linspace(0, 1, 7)[1:-1]) if good < n else []]))
        spot = np.searchsorted(edge, x[:, j], side="right")
        counts = np.stack([np.bincount(spot, y == k, len(edge) + 1) + 0.5 for k in (0, 1)])
        counts /= counts.sum(axis=1, keepdims=True)
        ratio = np.log(counts[1]) - np.log(counts[0])
        cuts.append(edge)
        ratios.append(ratio)
        total += ratio[spot]
    prior = float(np.clip(good / n, 0.01, 0.99))
    # features overlap, so their sum is scaled to the best fit of the labels
    grid = np.linspace(0.05, 1.5, 59)
    base = np.log(prior / (1 - prior))
    losses = [np.logaddexp(0, np.where(y > 0, -1, 1) * (base + a * total)).mean() for a in grid]
    return Model(cuts, ratios, float(grid[int(np.argmin(losses))]), prior, settings)


def evidence(documents: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` by ``evidence``, the log likelihood ratio of good to bad, within ±12; all other columns are kept."""
    kept = [c for c in documents.columns if c not in ("text", "evidence")]
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([measures(t or "") for t in strings(batch)]).reshape(batch.num_rows, len(FEATURES))
            total = np.zeros(batch.num_rows)
            for j, (edge, ratio) in enumerate(zip(model.cuts, model.ratios, strict=True)):
                total += ratio[np.searchsorted(edge, x[:, j], side="right")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.clip(total * model.scale, -12, 12))], names=[*kept, "evidence"])

    return documents.select(*kept, "text").mapInArrow(run, schema)


def site_of(source: Column) -> tuple[Column, Column]:
    """Host and path prefix of a URL or of a plain source name; a null source is the host ''.

    The path is the host with the first segment after it; a source without one has a single path.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    host = F.regexp_extract(bare, r"^[^/?#]*", 0)
    return host, F.concat(host, F.lit("/"), F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1))


def _strength(groups: DataFrame, mean: float, least: float) -> float:
    """Weight of the level above in documents: what the spread of group shares beyond chance leaves (at least ``least``)."""
    n, good = F.col("n"), F.col("good")
    chance = F.lit(mean * (1 - mean))
    r = groups.where("n >= 2").agg(F.sum(n * F.pow(good / n - mean, 2)), F.sum(F.lit(1.0)), F.sum(n), F.sum(n * n), F.sum(chance)).first()
    if not r[1] or r[1] < 2:
        return least
    spread, k, total, squares, by_chance = (float(v) for v in r)
    between = (spread - by_chance) / max(total - squares / total, 1e-9)
    return max(least, mean * (1 - mean) / between - 1) if between > 1e-9 else 1e9


def posteriors(scored: DataFrame, model: Model) -> DataFrame:
    """Add path and host posteriors and each document's to rows with doc_id, host, path and evidence.

    ``scored`` is read more than once and should be a written table. Adds host_mean, path_mean, posterior and rejected
    (posterior below the setting). Sums per group are exact whatever the group's size.
    """
    base = float(np.log(model.share / (1 - model.share)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = float(np.clip(whole[1] / whole[0], 0.01, 0.99)) if whole[0] else model.share
    above, within = _strength(hosts, mean, model.settings.least_strength), _strength(paths, mean, model.settings.least_strength)
    host_means = hosts.select("host", ((F.col("good") + above * mean) / (F.col("n") + above)).alias("host_mean"))
    path_means = paths.join(host_means, "host").select("host", "path", "host_mean", ((F.col("good") + within * F.col("host_mean")) / (F.col("n") + within)).alias("path_mean"))
    joined = scored.drop("host_mean", "path_mean", "posterior", "rejected").join(path_means, ["host", "path"])
    clipped = F.least(F.greatest("path_mean", F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(clipped / (1 - clipped)))))
    return joined.withColumn("posterior", posterior).withColumn("rejected", F.col("posterior") < model.settings.reject_below)


def judge(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``documents(doc_id, text, source)``: doc_id, host, path, evidence, host_mean, path_mean, posterior, rejected.

    Null and empty texts are judged as texts without words; a null source counts as a host of its own. Equal rows get
    equal results. An empty table gives an empty table.
    """
    model = fit(documents, labels, settings)
    host, path = site_of(F.col("source"))
    scored = settle(evidence(documents.select("doc_id", "text", host.alias("host"), path.alias("path")), model), "quality-evidence")
    return posteriors(scored, model)
