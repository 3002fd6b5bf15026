import math
import random

import numpy as np

from sievra.llm import language

EN, DE = "the house and water with thing", "das haus und wasser mit dinge nicht"


def corpus(n=120):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = (EN if lang == "en" else DE).split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)), lang))
    return rows


def test_identify(spark):
    rows = corpus() + [(900, None, None), (901, "", "en"), (902, "12 34 !!", "en"), (902, "12 34 !!", "en"), (903, EN * 200, None)]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id long, text string, lang string, score double")
    model = language.learn(df)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and by[i].score > 0.9 for i, _, lang in rows[:120])
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[900].score == 0
    assert by[903].lang_pred == "en"
    mixed = spark.createDataFrame([(1, f"{EN} {EN} {EN} {EN} {DE} {DE}")], "doc_id long, text string")
    r = language.identify(mixed, model).collect()[0]
    assert r.languages == ["en", "de"] and 0.5 < r.score < 0.9
    assert language.identify(df.limit(0), model).count() == 0
    empty = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def test_em_is_brute_force_em(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language.learn(df)
    text = f"{EN} {EN} {DE} nicht thing"
    scorer = language.Scorer(model)
    like, _ = scorer.likelihoods([text])
    theta = [0.5, 0.5]
    for _ in range(model.rounds):
        new = [0.0, 0.0]
        for row in like:
            z = sum(t * x for t, x in zip(theta, row))
            for k in range(2):
                new[k] += theta[k] * row[k] / z
        theta = [x / len(like) for x in new]
    value = lambda th: sum(math.log(sum(t * x for t, x in zip(th, row))) for row in like)
    alone = max(value([1, 0]), value([0, 1]))
    got = scorer.mixtures([text])[0][0]
    # the pair is fitted on from the first estimate; it wins by its penalised likelihood
    assert value(got) - model.penalty * math.log(len(like) + 1) > alone
    assert value(got) >= value(theta) - 1e-9 and np.isclose(got.sum(), 1)


def test_all_languages_of_a_text(spark):
    vocabulary = {lang: [f"{a}{b}{c}" for a in letters for b in letters for c in letters] for lang, letters in (("a", "bcd"), ("e", "fgh"), ("i", "jkl"), ("o", "mnp"), ("u", "qrs"))}
    rng = random.Random(5)
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    docs = [(i, text(lang, 40), lang) for i in range(20) for lang in vocabulary]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.learn(df)
    every = " ".join(text(lang, n) for lang, n in zip("aeiou", (60, 50, 40, 30, 20)))
    four = " ".join(text(lang, n) for lang, n in zip("aeio", (70, 50, 40, 40)))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([(1, every), (2, four)], "doc_id long, text string"), model).collect()}
    assert got[1].languages == list("aeiou") and abs(got[1].score - 0.3) < 0.02
    assert set(got[2].languages) == set("aeio") and abs(got[2].score - 0.35) < 0.02
