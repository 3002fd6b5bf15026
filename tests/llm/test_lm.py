import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievra.llm import lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def corpus(n=250):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        out, at = [], 0
        for _ in range(rng.randrange(0, 60)):
            at = (at * 3 + rng.choice([1, 1, 1, 2, 7])) % 60
            out.append(words[at] if rng.random() > 0.1 else f"rare{rng.randrange(400)}")
        rows.append((i, " ".join(out)))
    return [*rows, (900, None), (901, ""), (902, "A a\x0bB\xa0b É"), (902, "A a\x0bB\xa0b É"), (None, "w1 new"), (903, "w1 " * 3000)]


@pytest.mark.parametrize("words, pairs", [(1 << 20, 1 << 20), (40, 30), (0, 0)])
def test_counts_and_base(spark, words, pairs):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    train = F.col("doc_id") % 5 != 0
    model = lm.learn(lm.read(df, train), words, pairs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(model.coded, model).collect())
    count = Counter(t for i, x in rows if i is not None and i % 5 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = []
    for i, x in rows:
        ts = tokens(x)
        want.append((-1 if i is None else i, len(ts), sum(t in count for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)))
    assert got == sorted(want)


def by_hand(rows, model, words):
    """Scores from counts that are made here; weights are the model's."""
    m = model.numbers
    hash_of = lambda w: int(np.frombuffer(xxhash.xxh64_digest((w or "").encode()), "<i8")[0])
    train = [tokens(t) for i, t in rows if i is not None and i % 5]
    count = Counter(t for x in train for t in x)
    listed = {w for w in count if hash_of(w) in set(m.hashes.tolist())}
    assert len(listed) <= words + 1 and None in listed and all(count[w] >= count[v] for w in listed - {None} for v in set(count) - listed)
    name = lambda w: w if w in listed else "RARE"
    pairs, contexts, single = Counter(), Counter(), Counter()
    for x in train:
        for a, b in zip(["START", *map(name, x)], map(name, x)):
            pairs[a, b] += 1
            contexts[a] += 1
            single[b] += 1
    total, size = sum(single.values()), len(m.hashes) + 1

    def p(a, b):
        w = m.weights[lm._bucket(np.array([contexts[a] * m.kept]))[0]]
        first, second = (w[0], w[1]) if contexts[a] else (0, w[0] + w[1])
        return first * pairs[a, b] / max(1, contexts[a]) + second * single[b] / total + w[2] / size

    def score(text):
        at, out = "START", 0.0
        for w in tokens(text):
            out += math.log10(p(at, name(w))) + (float(m.log10_rare(count[w])) if name(w) == "RARE" else 0)
            at = name(w)
        return out

    return count, listed, p, score


@pytest.mark.parametrize("words, pairs", [(1 << 20, 1 << 20), (40, 30), (40, 0), (0, 5)])
def test_whole_score_by_hand(spark, words, pairs):
    rows = corpus()
    model = lm.learn(lm.read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 != 0), words, pairs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score(model.coded, model).collect())
    count, listed, p, score = by_hand(rows, model, words)
    want = sorted((-1 if i is None else i, score(t)) for i, t in rows)
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-9)
    assert len(model.numbers.pairs) <= pairs
    for a in ["START", "RARE", *sorted(x for x in listed if x)[:10]]:
        assert math.isclose(sum(p(a, b) for b in [*listed, "RARE"]), 1, rel_tol=1e-9)
    rest = [n for w, n in count.items() if w not in listed]
    assert math.isclose(sum(10 ** float(model.numbers.log10_rare(n)) for n in [*rest, 0]), 1, rel_tol=1e-9)


def test_score_beats_the_base_and_other_documents_can_be_scored(spark):
    df = spark.createDataFrame(corpus()[:250], "doc_id long, text string")
    model = lm.learn(lm.read(df, F.col("doc_id") % 5 != 0), 80, 50)
    got = lm.score(model.coded, model).filter("doc_id % 5 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    other = spark.createDataFrame([("x", "w1 w4 w13 w1 never w1 w60")], "name string, text string")
    coded = lm.code(lm.read(other, F.lit(False), "name"), spark.sparkContext.broadcast(model.numbers.hashes))
    row = lm.score(coded, model, "name").first()
    assert row.n_tokens == 8 and row.n_known < 8 and row.score < 0


def test_runs_of_numbers_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << lm.BITS, n).astype(np.uint64))
        assert (lm.unpacked_keys(lm.packed_keys(keys), n) == keys).all()
        assert sum(z - a for _, a, z in lm._by_bucket(keys, 5)) == n
    m = lm.Numbers(0, 0, np.arange(lm.WORDS), None, None, None, 0, 0, 0, 0, None, 4, None, None)
    ids = rng.integers(0, lm.WORDS + 1, 5000).astype(np.uint32)
    context, word = m.of_pair(m.mixed(ids, np.array([2000, 3000])))
    assert (word == ids).all() and (context[1:2000] == ids[:1999]).all() and context[0] == context[2000] == lm.WORDS + 1


def test_weights_are_brute_force_em():
    rng = np.random.default_rng(2)
    bucket, held = rng.integers(0, 3, 40), rng.integers(1, 9, 40)
    bigram, unigram = rng.dirichlet(np.ones(40)), rng.dirichlet(np.ones(40))
    got = lm.fit_weights(bucket, held, bigram, unigram, 1 / 40, 4000)
    for b in range(3):
        value = lambda w: (held * np.log(w[0] * bigram + w[1] * unigram + w[2] / 40))[bucket == b].sum()  # noqa: B023, E731
        assert all(value(rng.dirichlet([1, 1, 1])) <= value(got[b]) + 1e-3 for _ in range(300))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.learn(lm.read(df, F.lit(False)))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(model.coded, model).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    model = lm.learn(lm.read(df.limit(0), F.lit(True)))
    assert lm.score(model.coded, model).count() == 0
