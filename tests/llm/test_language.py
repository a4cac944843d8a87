from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairlens.llm import language
from pairlens.llm.queries import QUERIES


def brute_model(rows, order):
    """Interpolated Kneser-Ney by dictionaries: (lang, context, letter) -> probability."""
    symbols = set()
    raw = defaultdict(Counter)
    for lang, text in rows:
        for run in language.LETTERS.findall(text.lower()):
            padded = f" {run} "
            for i in range(1, len(padded)):
                symbols.add(padded[i])
                for k in range(1, min(order, i + 1) + 1):
                    raw[lang][padded[i - k + 1 : i + 1], i - k + 1 == 0] += 1
    models = {}
    for lang, counts in raw.items():
        used = [Counter() for _ in range(order + 1)]
        for (gram, opens), n in counts.items():
            if opens or len(gram) == order:
                used[len(gram)][gram] += n
        for gram in {g for g, _ in counts}:
            if len(gram) > 1:
                used[len(gram) - 1][gram[1:]] += 1
        models[lang] = used
    size = len(symbols) + 1

    def probability(lang, gram):
        used = models[lang][len(gram)]
        ones, twos = (sum(v == k for v in used.values()) for k in (1, 2))
        discount = min(max(ones / max(ones + 2 * twos, 1) if ones + twos else 0.5, 0.1), 0.95)
        own = [v for g, v in used.items() if g[:-1] == gram[:-1]]
        below = probability(lang, gram[1:]) if len(gram) > 1 else 1 / size
        if not own:
            return below
        return max(used[gram] - discount, 0) / sum(own) + discount * len(own) / sum(own) * below

    return probability


TRAIN = [
    ("xx", "abba baab Ab, bab"), ("xx", "abab aab"), ("yy", "ccd dcc ddc"), ("yy", "abcd dcab"), ("xx", "ba"), ("yy", "cd cd cd"),
]


def test_estimates_match_the_definition(spark):
    settings = language.Settings(order=3, fit_rows=100, calibrate_rows=0)
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TRAIN)], "doc_id long, text string, lang string")
    sample = table.withColumn("use", language.F.lit("fit"))
    rows = language._gram_counts(sample, 3).toPandas()
    model = language._estimate({c: rows[c].to_numpy() for c in rows.columns}, ["xx", "yy"], settings.order)
    probability = brute_model(TRAIN, 3)
    words = ["abba", "dzc", "ba,cd", "q", "..", "c"]
    got = language._Scorer(model)._score(words)
    for word, row in zip(words, got, strict=True):
        count = 0
        for j, lang in enumerate(("xx", "yy")):
            total, count = 0.0, 0
            for run in language.LETTERS.findall(word.lower()):
                padded = f" {run} "
                for i in range(1, len(padded)):
                    total += math.log(probability(lang, padded[max(0, i - 2) : i + 1]))
                    count += 1
            assert row[j] == pytest.approx(total, rel=1e-4)
        assert row[-1] == count


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_kneser_ney"](spark, folder).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.99
    assert sum(r.rejected for r in rows) <= len(rows) * 0.005


def test_odd_rows(spark):
    german = [(i, "der Hund und die Katze sind nicht im Haus " * 3, "de", 1.0) for i in range(60)]
    english = [(100 + i, "the dog and the cat are not in this house " * 3, "en", 1.0) for i in range(60)]
    table = spark.createDataFrame([*german, *english, (200, None, "de", 1.0), (201, "text", None, 1.0)], "doc_id long, text string, lang string, score double")
    model = language.fit(table)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 ²³ !!"), (4, "the cat and the dog"), (4, "the cat and the dog"), (None, "die Katze"), (5, "Ωμέγα βήτα γάμμα " * 50), (6, "the cat " * 60_000)]
    got = language.identify(spark.createDataFrame([(*r, "x", True) for r in odd], "doc_id long, text string, lang_pred string, rejected boolean"), model).collect()
    by = {str(r.doc_id): r for r in got}
    assert len(got) == len(odd)
    assert all(by[k].lang_pred == "und" and by[k].rejected and by[k].score == 0 for k in "123")
    assert by["4"].lang_pred == "en" and by["6"].lang_pred == "en" and by["None"].lang_pred == "de"
    assert by["5"].lang_pred in ("de", "en") and by["5"].rejected and not by["4"].rejected
    empty = language.fit(table.limit(0))
    assert {r.lang_pred for r in language.identify(table, empty).collect()} == {"und"}
    assert language.identify(table.limit(0), model).collect() == []


def test_the_sample_is_bounded(spark):
    table = spark.range(20_000).selectExpr("id as doc_id", "concat('word ', id) as text", "if(id % 20 = 0, 'aa', 'bb') as lang")
    drawn = language._draw(table, language.Settings(fit_rows=400, calibrate_rows=100)).groupBy("lang", "use").count().collect()
    sizes = {(r.lang, r.use): r["count"] for r in drawn}
    assert 300 < sizes["bb", "fit"] < 500 and 60 < sizes["bb", "calibrate"] < 140 and 300 < sizes["aa", "fit"] < 500


def test_long_texts_and_words_are_scored_as_whole(spark, monkeypatch):
    settings = language.Settings(order=3, fit_rows=100, calibrate_rows=0)
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TRAIN)], "doc_id long, text string, lang string")
    model = language.fit(table, settings)
    texts = ["abba cd " * 50, "ab" * 333, "abcd," * 100 + "dc" * 90, "x" * 30 + " " + "cd" * 200 + "-ab ba", " " * 100 + "b" * 70, "ab.cd" * 60 + "\n" + "a" * 41, "\u0130ab" * 50]
    whole = np.concatenate([language._Scorer(model)._score([t]) for t in texts])
    for piece in (1 << 17, 64, 41, 20):
        monkeypatch.setattr(language, "PIECE", piece)
        got = language._Scorer(model).documents(texts)
        assert got[:, -1].tolist() == whole[:, -1].tolist()
        assert np.allclose(got, whole)


FINNISH = [
    "T\u00e4m\u00e4 on suomenkielinen lause joka kertoo talosta ja pihasta sek\u00e4 koirasta",
    "S\u00e4\u00e4 on kylm\u00e4 ja lunta sataa paljon talvella pohjoisessa kaupungissa",
    "Huomenna menemme kauppaan ostamaan leip\u00e4\u00e4 ja maitoa lapsille",
]


def _sentences(words, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words.split(), 14)) for _ in range(n)]


def test_a_few_wrong_labels_do_not_open_the_gate(spark):
    german = _sentences("der die das Hund Katze Haus nicht ist sind im auf und mit einer Stra\u00dfe gehen wir heute sch\u00f6n Wetter Garten", 600, 1)
    english = _sentences("the a dog cat house not is are in on and with street we go today nice weather garden this that there", 600, 2)
    clean = [(i, t, "de") for i, t in enumerate(german)] + [(1000 + i, t, "en") for i, t in enumerate(english)]
    wrong = [(2000 + i, FINNISH[i % 3], ("de", "en")[i % 2]) for i in range(12)]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(FINNISH + german[:50] + english[:50])], "doc_id long, text string")
    for rows in (clean, clean + wrong):
        model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Settings(fit_rows=400))
        got = {r.doc_id: r for r in language.identify(asked, model).collect()}
        assert not any(got[i].rejected for i in range(3, 103))
        if rows is clean:
            assert all(got[i].rejected for i in range(3))
    # the wrong labels are learned from; unlike text is still turned away
    other = spark.createDataFrame([(1, "zxqj wvkq xqzw jkvx " * 4), (2, "N\u00e3o h\u00e1 d\u00favida que amanh\u00e3 far\u00e1 muito calor l\u00e1 fora, ent\u00e3o ficaremos c\u00e1")], "doc_id long, text string")
    assert all(r.rejected for r in language.identify(other, model).collect())


def test_a_language_with_one_row(spark):
    english = _sentences("the a dog cat house not is are in on and with street we go today nice weather garden this that there", 300, 2)
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(900, "zo gaat het hier altijd weer verder", "nl")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "nl"] and np.isfinite(model.slack).all() and np.isfinite(model.spread).all()
    asked = spark.createDataFrame([(1, "qxzv wkjq zzxq vvkx jqqz " * 5), (2, english[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(asked, model).collect()}
    assert got[1].rejected and not got[2].rejected


def test_a_long_unbroken_text_takes_bounded_memory():
    import tracemalloc

    model = language.Model(["a", "b"], [language.Grams(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros(0, np.uint64), np.zeros((0, 2))) for _ in range(4)], -5.0)
    text = "qwertzuiop" * 500_000
    tracemalloc.start()
    sums = language._Scorer(model).documents([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums[0, -1] == len(text) + 1
    assert peak < 100 << 20
