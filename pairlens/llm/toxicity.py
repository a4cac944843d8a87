"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are terms: words (lexicon) and word beginnings (patterns) that labelled training rows tie to toxic texts. The label
model is a latent class model fitted by expectation maximisation on the voters' votes: it estimates how often each votes
in either class (its accuracy) and which voters vote together within a class; those form cliques, whose number of
votes is one observation, so copies of one signal do not count as several. Its posteriors, not the labels, are what the
linear classifier is trained on, over a wider vocabulary of terms; labels then set the scale and shift of its logits.

Mining, label model and classifier use a bounded sample of labelled rows (``Settings.label_rows``, by hash), as fits of a
classifier may; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import Memo, settle, slices, strings

LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Settings:
    """``label_rows`` bounds the labelled rows used (in expectation), ``voters`` and ``vocabulary`` the terms kept."""

    label_rows: int = 20_000
    voters: int = 400
    vocabulary: int = 3000
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    least_documents: int = 3
    least_precision: float = 0.7
    tied: float = 0.5
    rounds: int = 30
    ridge: float = 1e-4


@dataclass
class LabelModel:
    """Class share, each voter's rate of votes in class 0 and 1, cliques of tied voters and their vote counts' rates."""

    share: float
    rates: np.ndarray
    cliques: list[np.ndarray]
    emissions: list[np.ndarray]


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None
    settings: Settings


def terms_of(chunk: str, beginnings: tuple[int, ...]) -> list[str]:
    """Terms in a piece of text without white space: ``=word``, and ``word`` cut to each length that it exceeds."""
    out = []
    for word in LETTERS.findall(chunk.lower()):
        out.append("=" + word)
        out += [word[:k] for k in beginnings if len(word) > k]
    return out


def _sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Labelled rows with text, drawn by hash; the drawn ids are few enough to broadcast by the bound of the draw."""
    rows = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    n = rows.count()
    share = min(1.0, settings.label_rows / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) < int(share * (1 << 40)))
    return settle(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "toxicity-sample")


def _mine(sample: DataFrame, settings: Settings) -> tuple[dict[str, tuple[int, int]], list[str]]:
    """Voters with their clean and toxic rows, and the vocabulary that includes them: terms most tied to toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda chunk: terms_of(chunk, settings.beginnings))
        for batch in slices(batches):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(strings(batch), batch.column("toxic").to_pylist(), strict=True):
                for term in set(chain.from_iterable(map(memo.__getitem__, set(text.split())))):
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["term", "clean", "toxic"]
            )

    sizes = sample.agg(F.sum(F.col("toxic").cast("long")), F.count(F.lit(1))).first()
    bad, good = int(sizes[0] or 0), int(sizes[1]) - int(sizes[0] or 0)
    if not bad or not good:
        return {}, []
    counted = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") + 0.5) / (bad + 1), (F.col("clean") + 0.5) / (good + 1)
    strength = F.col("toxic") * F.log(rate[0] / rate[1])
    # two standard errors below its log rate ratio a term must still be three times as common in toxic rows
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure_ratio = F.log(rate[0] / rate[1]) - 2 * error
    chosen = counted.where((F.col("toxic") >= settings.least_documents) & (sure_ratio > np.log(3.0))).withColumn("strength", strength)
    top = chosen.orderBy(F.desc("strength"), "term").limit(settings.vocabulary).collect()  # bounded by the vocabulary
    voters, known = {}, set()
    for r in sorted(top, key=lambda r: (-r.strength, -len(r.term), r.term)):
        same = (r.term.removeprefix("=")[: min(settings.beginnings)], r.toxic, r.clean)  # another cut of a word already there
        if (r.toxic + 0.5) / (r.toxic + r.clean + 1) > settings.least_precision and same not in known:
            known.add(same)
            voters[r.term] = (r.clean, r.toxic)
    return dict(list(voters.items())[: settings.voters]), [r.term for r in top]


def _features(rows: DataFrame, terms: dict[str, int], settings: Settings, column: str = "features") -> DataFrame:
    """Replace ``text`` by the sorted numbers of the terms that it holds."""
    kept = [c for c in rows.columns if c not in ("text", column)]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(column, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda chunk: tuple(terms[t] for t in terms_of(chunk, settings.beginnings) if t in terms))
        for batch in slices(batches):
            found = [sorted(set(chain.from_iterable(map(memo.__getitem__, (text or "").split())))) for text in strings(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.int32()))], names=[*kept, column])

    return rows.select(*kept, "text").mapInArrow(run, schema)


def _tied(votes: np.ndarray, posterior: np.ndarray, least: float) -> list[np.ndarray]:
    """Cliques: voters whose votes correlate by ``least`` or more within the positive class."""
    weight = posterior / max(posterior.sum(), 1e-9)
    centred = votes - weight @ votes
    cov = (centred * weight[:, None]).T @ centred
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    linked = cov / np.outer(scale, scale) >= least
    left, cliques = set(range(votes.shape[1])), []
    while left:
        group, front = set(), [min(left)]
        while front:
            j = front.pop()
            if j in left:
                left.discard(j)
                group.add(j)
                front += [k for k in np.flatnonzero(linked[j]) if k in left]
        cliques.append(np.array(sorted(group)))
    return cliques


def label_model(votes: np.ndarray, share: float, settings: Settings = Settings(), prior: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """Fit the generative model to a 0/1 matrix of votes (rows by voters) from an expected class share.

    ``prior`` (2 by voters) holds votes already known of either class, as pseudo-counts; without it no label is used.

    Returns the model and each row's posterior. Voters vote for the positive class or abstain. Abstentions are taken not to
    depend on the class, as a voter may only know one language; the last emission is of the vote that no voter voted.
    """
    start = np.clip(votes.sum(axis=1), 0, 3).astype(int)
    if prior is None:
        posterior, prior = np.array([0.02, 0.6, 0.9, 0.98])[start], np.zeros((2, votes.shape[1]))
    else:
        miss = np.log((prior[0] + 0.5) / (prior.sum(axis=0) + 1))
        posterior = np.where(start > 0, 1 - np.exp(votes @ miss), 0.02)
    cliques = _tied(votes, posterior, settings.tied)
    observed = [np.minimum(votes[:, c].sum(axis=1), 2).astype(int) for c in cliques]
    silent = (start == 0).astype(int)
    known = [prior[:, c].mean(axis=1, keepdims=True) * [[0.0, 1.0, 0.0]] for c in cliques] + [np.zeros((2, 3))]
    emissions: list[np.ndarray] = []
    for _ in range(settings.rounds):
        emissions, score = [], np.full(len(votes), np.log(share / (1 - share)))
        for seen, counts in zip([*observed, silent], known, strict=True):
            rates = np.stack([np.bincount(seen, 1 - posterior, 3) + [0.5, 0.1, 0.05], np.bincount(seen, posterior, 3) + [0.5, 0.1, 0.05]]) + counts
            rates /= rates.sum(axis=1, keepdims=True)
            emissions.append(rates)
            ratio = np.log(rates[1]) - np.log(rates[0])
            ratio[0] = 0.0  # an abstention says nothing by itself; that all abstain is a vote of its own
            score += ratio[seen]
        updated = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        share = float(np.clip(updated.mean(), 1e-4, 1 - 1e-4))
        moved, posterior = np.abs(updated - posterior).max(), updated
        if moved < 1e-4:
            break
    rates = np.stack([((1 - posterior) @ votes + 0.1) / ((1 - posterior).sum() + 0.6), (posterior @ votes + 0.1) / (posterior.sum() + 0.6)])
    return LabelModel(share, rates, cliques, emissions), posterior


def _train(rows: list[np.ndarray], target: np.ndarray, size: int, ridge: float) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    flat = np.concatenate(rows) if rows else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(size + 1), np.log(share / (1 - share))
    w[-1] = b
    ahead, before, n = w.copy(), w.copy(), len(rows)
    step = 4.0 / max(1.0, np.bincount(owner, minlength=n).mean() + 1)
    for turn in range(400):
        z = np.bincount(owner, ahead[flat], minlength=n) + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gradient = np.append(np.bincount(flat, off[owner], minlength=size), off.sum()) / n * 20
        gradient[:-1] += ridge * 20 * ahead[:-1]
        w = ahead - step * gradient
        ahead = w + turn / (turn + 3) * (w - before)
        before = w
    return w[:-1], float(w[-1])


def _calibrated(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits that fit the labels best (logistic regression on one number, by Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        gradient = np.array([(p - toxic) @ z + 0.01 * (a - 1), (p - toxic).sum()])
        step = np.linalg.solve(np.array([[v @ (z * z) + 0.01, v @ z], [v @ z, v.sum()]]), gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labels(doc_id, toxic)`` of ``documents(doc_id, text)``; rows with a null in either are left out.

    Without rows of both classes every score will be 0.
    """
    sample = _sample(documents, labels, settings)
    voters, vocabulary = _mine(sample, settings)
    terms = {t: i for i, t in enumerate(vocabulary)}
    if not voters:
        return Model({}, np.zeros(0), -np.inf, None, settings)
    table = _features(sample, terms, settings).toPandas()  # bounded by the sample
    rows = [np.asarray(f, dtype=np.int64) for f in table["features"]]
    place = {terms[v]: j for j, v in enumerate(voters)}
    votes = np.zeros((len(rows), len(voters)))
    for i, found in enumerate(rows):
        votes[i, [place[f] for f in found if f in place]] = 1
    modelled, posterior = label_model(votes, float(np.clip(table["toxic"].mean(), 1e-3, 0.5)), settings, np.array(list(voters.values()), dtype=float).T)
    weights, bias = _train(rows, posterior, len(vocabulary), settings.ridge)
    z = np.array([weights[r].sum() + bias for r in rows])
    scale, shift = _calibrated(np.clip(z, -20, 20), table["toxic"].to_numpy(dtype=float))
    return Model(terms, weights * scale, bias * scale + shift, modelled, settings)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to ``documents`` in place of ``text``; null and empty texts get the score of no term."""
    kept = [c for c in documents.columns if c not in ("text", "score")]
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        terms, weights, beginnings = own.terms, own.weights, own.settings.beginnings
        memo = Memo(lambda chunk: tuple(terms[t] for t in terms_of(chunk, beginnings) if t in terms))
        for batch in slices(batches):
            sums = [sum(weights[t] for t in set(chain.from_iterable(map(memo.__getitem__, (text or "").split())))) for text in strings(batch)]
            z = np.clip(np.array(sums, dtype=float) + own.bias, -700, 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.where(np.isinf(own.bias), 0.0, 1 / (1 + np.exp(-z))))], names=[*kept, "score"])

    return documents.select(*kept, "text").mapInArrow(run, schema)
