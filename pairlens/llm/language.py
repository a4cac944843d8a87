"""Language identification by interpolated Kneser-Ney character models, one per language.

A model sees letter runs in lower case with a blank on either side. N-grams of each order lie in one sorted array of
64-bit hashes for all languages, with a row of log-probabilities (a column per language) beside each; what an order lacks
falls to the next one with the back-off weight of its context. A document's cross-entropy per character is a sum over its
words, so a word is scored once and then found in a bounded cache; words too long for it, and texts too long to be split at
once, are scored in pieces that overlap by the context of a letter.

The model is fitted on a bounded sample of labelled rows (``Settings.fit_rows`` a language, taken by hash), which bounds
the arrays that every task gets; all documents are scored whole. Rejection is calibrated on other labelled rows, of which
those count that are predicted as labelled, by medians, so that a few wrong labels do not move it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import released, settle, slices, strings

LETTERS = regex.compile(r"\p{L}+")
#: Words that a task remembers, and characters of the longest of them: some 60 MB at most.
CACHED_WORDS, CACHED_CHARACTERS = 150_000, 64
#: Characters that are split and scored at a time; a position to predict takes some 165 bytes.
PIECE = 1 << 17
LAST_BLANK = regex.compile(r"(?r)\s")
LAST_OTHER = regex.compile(r"(?r)\P{L}")
OPEN_RUN = regex.compile(r"\p{L}*$")
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BLANK = 32
UNKNOWN = "und"
#: Letters before a piece that it is scored with; n-grams are no longer.
CONTEXT = 16


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` and ``calibrate_rows`` bound the labelled rows used for a language (in expectation, taken by hash).

    A text may lie above its language's mean entropy by ``gap_share`` of what other languages usually lie above it
    (``least_slack`` nats where there is no other), and by ``sigmas`` standard errors of its length.
    """

    order: int = 4
    fit_rows: int = 2000
    calibrate_rows: int = 500
    sigmas: float = 6.0
    gap_share: float = 0.5
    least_slack: float = 1.0


@dataclass
class Grams:
    """One order: sorted n-gram hashes with log-probabilities, sorted context hashes with log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


@dataclass
class Model:
    languages: list[str]
    orders: list[Grams]
    floor: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slack: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _letter_runs(chunk: str) -> list[str]:
    return LETTERS.findall(chunk.lower())


def _grams(runs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Positions to predict in ``runs``: number of the run, characters known before it, and n-gram hashes by order.

    A run is predicted letter by letter and then its closing blank; its opening blank is context only.
    """
    joined = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(runs) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(runs)), lengths + 1)
    spot = np.arange(1, len(joined), dtype=np.int64)
    known = spot - starts[run]
    hashes, before = [], None
    with np.errstate(over="ignore"):
        for k in range(order):
            if before is None:
                before = _mixed(joined + _ODD)
            else:
                longer = np.zeros_like(joined)
                longer[1:] = _mixed(before[:-1] * _ODD + joined[1:])
                before = longer
            hashes.append(before)
    return run, known, [h[spot] for h in hashes] + [h[spot - 1] for h in hashes]


class _Scorer:
    """Log-probability sums of words under all languages."""

    def __init__(self, model: Model):
        self._model = model
        self._index: dict[str, int] = {}
        self._rows = np.zeros((1024, len(model.languages) + 1), dtype=np.float64)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Per text: log-probability under each language, then the number of predicted characters."""
        sums = np.zeros((len(texts), self._rows.shape[1]))
        for i, text in enumerate(texts):
            for words, long in _pieces(text or ""):
                if long is not None:
                    sums[i] += self._long(*long)
                else:
                    sums[i] += self._known(words)
        return sums

    def _known(self, words: list[str]) -> np.ndarray:
        index = self._index
        found = list(map(index.get, words))
        fresh = []
        if None in found:
            if len(index) > CACHED_WORDS:
                index.clear()
                found = [None] * len(words)
            for i, at in enumerate(found):
                if at is None:
                    word = words[i]
                    at = index.get(word)
                    if at is None:
                        at = index[word] = len(index)
                        fresh.append(word)
                    found[i] = at
            while len(index) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            low = len(index) - len(fresh)
            self._rows[low : len(index)] = self._score(fresh)
        return self._rows[found].sum(axis=0) if found else 0.0

    def _long(self, text: str, before: str, open_end: bool) -> np.ndarray:
        """A piece of a text: what comes before it is context; with an open end its last run goes on."""
        out = np.zeros(self._rows.shape[1])
        context = OPEN_RUN.search(before.lower())[0]
        runs = _letter_runs(context + text)
        if runs:
            run, known, total = self._positions(runs)
            use = (run > 0) | (known > len(context))
            if open_end and LETTERS.match(text.lower()[-1]):
                use[-1] = False
            out[:-1], out[-1] = total[use].sum(axis=0), use.sum()
        return out

    def _score(self, chunks: list[str]) -> np.ndarray:
        out = np.zeros((len(chunks), len(self._model.languages) + 1))
        owner, runs = [], []
        for i, chunk in enumerate(chunks):
            for r in _letter_runs(chunk):
                owner.append(i)
                runs.append(r)
        if runs:
            run, _, total = self._positions(runs)
            whose = np.array(owner)[run]
            np.add.at(out[:, :-1], whose, total)
            out[:, -1] = np.bincount(whose, minlength=len(chunks))
        return out

    def _positions(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each position to predict: its run, the characters known before it, its log-probability under each language."""
        model, order = self._model, len(self._model.orders)
        run, known, hashes = _grams(runs, order)
        total = np.zeros((len(run), len(model.languages)))
        todo = np.arange(len(run))
        for k in range(order, 0, -1):
            grams = model.orders[k - 1]
            use = todo[known[todo] >= k - 1]
            rest = todo[known[todo] < k - 1]
            spots, there = _find(grams.keys, hashes[k - 1][use])
            total[use[there]] += grams.logp[spots[there]]
            use = use[~there]
            if k > 1:
                spots, there = _find(grams.contexts, hashes[order + k - 2][use])
                total[use[there]] += grams.weights[spots[there]]
            else:
                total[use] += model.floor
            todo = np.concatenate([use, rest])
        return run, known, total


def _pieces(text: str) -> Iterator[tuple[list[str], tuple[str, str, bool] | None]]:
    """A text as lists of words to look up, and as pieces ``(text, context before, goes on)`` where words are long."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            blank = LAST_BLANK.search(text, at, end)
            end = blank.end() if blank else end
        words = text[at:end].split()
        long = [w for w in words if len(w) > CACHED_CHARACTERS]
        if end < len(text) and not text[end - 1].isspace():
            # no blank in all of the piece: it is cut behind its last character that is no letter, or within a run
            before = ""
            while True:
                other = LAST_OTHER.search(text, at, end) if end < len(text) else None
                cut = other.end() if other else end
                goes_on = cut < len(text) and not other
                yield [], (text[at:cut], before, goes_on)
                before = text[max(at, cut - CONTEXT) : cut] if goes_on else ""
                at = cut
                end = min(at + PIECE, len(text))
                if at >= len(text) or not goes_on:
                    break
            continue
        yield [w for w in words if len(w) <= CACHED_CHARACTERS], None
        for word in long:
            yield [], (word, "", False)
        at = end


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    spots = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return spots, keys[spots] == wanted


def _draw(labelled: DataFrame, settings: Settings) -> DataFrame:
    """A sample by hash: column ``use`` is "fit" or "calibrate". Only counts per language are computed for it."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")
    # a row per language, as the model has a column for each; texts stay where they are
    drawn = labelled.join(F.broadcast(sizes), "lang").withColumn("spot", spot)
    share = settings.calibrate_rows / (settings.fit_rows + settings.calibrate_rows)
    # in whole rows, so that the first few rows of a language are for fitting
    cut = F.floor(F.least(F.lit(float(settings.calibrate_rows)), F.col("n") * share))
    use = F.when(F.col("spot") < cut, "calibrate").when(F.col("spot") < settings.fit_rows + settings.calibrate_rows, "fit")
    return drawn.withColumn("use", use).where("use is not null").select("lang", "text", "use")


def _gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """Counts of every n-gram of the sample: lang, k, key, context, tail (without the first character), opens (a run), n."""
    schema = "lang string, word string, n long"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch), strict=True):
                for run in _letter_runs(text or ""):
                    counts[lang, run] = counts.get((lang, run), 0) + 1
            if counts:
                langs, runs = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(runs), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    types = "lang string, k int, key long, context long, tail long, opens boolean, n long"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, counts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("n").to_numpy()
            run, known, hashes = _grams(batch.column("word").to_pylist(), order)
            for k in range(1, order + 1):
                at = np.flatnonzero(known >= k - 1)
                none = np.zeros(len(at), np.uint64)
                columns = [hashes[k - 1][at], hashes[order + k - 2][at] if k > 1 else none, hashes[k - 2][at] if k > 1 else none]
                # an order's counts below the highest are of n-grams that nothing precedes: those that open a run
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[run[at]], pa.string()), pa.array(np.full(len(at), k, np.int32)), *(pa.array(c.view(np.int64)) for c in columns), pa.array(known[at] == k - 1), pa.array(counts[run[at]])],
                    names=["lang", "k", "key", "context", "tail", "opens", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(words, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(expand, types).groupBy("lang", "k", "key", "context", "tail", "opens").agg(F.sum("n").alias("n"))


def _estimate(rows: dict[str, np.ndarray], languages: list[str], order: int) -> Model:
    """Interpolated Kneser-Ney from counts: highest order and run openings by occurrence, others by what precedes them."""
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[x] for x in rows["lang"]], dtype=np.int64)
    keys, contexts, tails = (rows[c].astype(np.int64).view(np.uint64) for c in ("key", "context", "tail"))
    model = Model(languages, [], 0.0)
    lower, wide = None, len(languages)
    symbols = len(np.unique(keys[rows["k"] == 1])) + 1
    model.floor = 0.0
    for k in range(1, order + 1):
        mine = rows["k"] == k
        union, first = np.unique(keys[mine], return_index=True)
        context_of, tail_of = contexts[mine][first], tails[mine][first]
        count = np.zeros((len(union), wide))
        taken = mine & (rows["opens"] | (k == order))
        np.add.at(count, (np.searchsorted(union, keys[taken]), lang[taken]), rows["n"][taken])
        if k < order:  # how many characters come before it
            longer = rows["k"] == k + 1
            np.add.at(count, (np.searchsorted(union, tails[longer]), lang[longer]), 1)
        ones, twos = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        groups, member = np.unique(context_of, return_inverse=True)
        total, kinds = np.zeros((len(groups), wide)), np.zeros((len(groups), wide))
        np.add.at(total, member, count)
        np.add.at(kinds, member, count > 0)
        seen = total > 0
        weight = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        if lower is None:
            below = np.full((len(union), wide), 1 / symbols)
        else:
            below = lower.logp[np.searchsorted(lower.keys, tail_of)]
        p = np.maximum(count - discount, 0) / np.maximum(total[member], 1) + weight[member] * below
        lower = Grams(union, p, groups, weight)
        model.orders.append(lower)
    model.floor = np.log(model.orders[0].weights[0] / symbols) if len(model.orders[0].weights) else 0.0
    for grams in model.orders:
        grams.logp, grams.weights = np.log(grams.logp).astype(np.float32), np.log(grams.weights).astype(np.float32)
    return model


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``; rows with a null text or language are left out.

    Without a labelled row the model knows no language.
    """
    sample = settle(_draw(labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null"), settings), "language-sample")
    table = _gram_counts(sample.where("use = 'fit'"), settings.order).toPandas()
    rows = {c: table[c].to_numpy() for c in table.columns}
    rows["opens"] = rows["opens"].astype(bool)
    languages = sorted(set(rows["lang"]))
    if not languages:
        return Model([], [], 0.0)
    model = _estimate(rows, languages, settings.order)
    _calibrate(model, sample, settings)
    return model


def _calibrate(model: Model, sample: DataFrame, settings: Settings) -> None:
    """Mean entropy, allowed distance from it and spread by length, a language each.

    Only rows predicted as labelled count, and of these medians. A language without such rows gets the values of all
    others together; where no language has any, the rows that the model was fitted on serve.
    """
    wide = len(model.languages)

    def judged(use: str):
        rows = _entropies(sample.where(F.col("use") == use), model).where("length > 0").toPandas()
        entropies = np.array(rows["entropies"].tolist(), dtype=float).reshape(-1, wide)
        own = rows["lang"].map({name: i for i, name in enumerate(model.languages)}).to_numpy(dtype=float) == entropies.argmin(axis=1)
        return entropies[own], rows["length"].to_numpy(dtype=float)[own]

    entropies, length = judged("calibrate")
    if not len(length):
        entropies, length = judged("fit")
    if not len(length):
        model.mean, model.slack, model.spread = np.zeros(wide), np.full(wide, np.inf), np.full(wide, 1.0)
        return
    best, chosen = entropies.min(axis=1), entropies.argmin(axis=1)
    others = np.sort(entropies, axis=1)

    def values(at: np.ndarray) -> tuple[float, float, float]:
        order = np.argsort(best[at])
        share = np.cumsum(length[at][order]) / length[at].sum()
        mean = float(best[at][order][min(np.searchsorted(share, 0.5), len(order) - 1)])
        gap = float(np.median(others[at, 1] - others[at, 0])) if wide > 1 else 0.0
        away = (best[at] - mean) * np.sqrt(length[at])
        spread = 1.4826 * float(np.median(np.abs(away)))
        return mean, max(settings.least_slack, settings.gap_share * gap), settings.sigmas * max(spread, 1e-6)

    every = np.arange(len(best))
    found = [values(np.flatnonzero(chosen == i)) if (chosen == i).any() else values(every) for i in range(wide)]
    model.mean, model.slack, model.spread = (np.array(v) for v in zip(*found, strict=True))


def _entropies(rows: DataFrame, model: Model, give_text: bool = False) -> DataFrame:
    """Add ``length`` (predicted characters) and ``entropies`` (nats per character and language); the text is not given back unless asked for."""
    kept = [c for c in rows.columns if c not in ("length", "entropies") and (give_text or c != "text")]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("length", T.LongType()), T.StructField("entropies", T.ArrayType(T.DoubleType(), False))])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, wide = _Scorer(shared.value), len(shared.value.languages)
        for batch in slices(batches):
            sums = scorer.documents(strings(batch))
            length = sums[:, -1]
            entropy = -sums[:, :-1] / np.maximum(length, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * wide), pa.array(entropy.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(length.astype(np.int64)), lists], names=[*kept, "length", "entropies"])

    return rows.select(*kept, *(["text"] if not give_text else [])).mapInArrow(released(run), schema)


def identify(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns to keep, lang_pred, score, entropy (nats per character, null without letters) and rejected.

    ``lang_pred`` is the language of lowest cross-entropy per character (ties: the first by name), ``und`` where the text
    is null or has no letter or the model knows no language. ``score`` is the chosen language's share under the
    entropies of at most 50 characters, 0 for ``und``. Rejected are ``und`` and texts whose entropy lies further above
    their language's usual one than allowed by ``Settings``. ``keep`` may name ``text``, which then comes back from the
    workers and is not sent twice.
    """
    wide = len(model.languages)
    scored = _entropies(documents.select(*keep, *(["text"] if "text" not in keep else [])), model, "text" in keep)
    known = (F.col("length") > 0) & F.lit(wide > 0)
    best = F.array_min("entropies")
    names = F.array(*map(F.lit, model.languages)) if wide else F.array(F.lit(UNKNOWN))
    at = F.greatest(F.array_position("entropies", best).cast("int"), F.lit(1))
    share = 1 / F.aggregate("entropies", F.lit(0.0), lambda s, e: s + F.exp((best - e) * F.least("length", F.lit(50))))
    rejected = F.lit(False)
    if wide:
        mean, slack, spread = (F.array(*(F.lit(float(v)) for v in values))[at - 1] for values in (model.mean, model.slack, model.spread))
        rejected = F.coalesce(best - mean > slack + spread / F.sqrt("length"), F.lit(False))
    return scored.select(
        *keep,
        F.when(known, F.element_at(names, at)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, share).otherwise(0.0).alias("score"),
        F.when(known, best).alias("entropy"),
        (~known | rejected).alias("rejected"),
    )


def learnable(documents: DataFrame, is_held_out: Column) -> DataFrame:
    """Rows that may be learned from."""
    return documents.where(~is_held_out).select("doc_id", "text", "lang")
