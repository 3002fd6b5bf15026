import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sievra.llm import toxicity as tx


def slow_kernel(s, t, order, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), order):
        for j in itertools.combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_is_brute_force():
    rng = random.Random(1)
    a = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    b = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    for order in (2, 3):
        assert np.allclose(tx.kernel(a, b, order, 0.6), [slow_kernel(x, y, order, 0.6) for x, y in zip(a, b)])


def test_values_are_largest_kernels():
    marks = ["idiot", "moron"]
    v = tx.Values(marks, np.array([1.0, 0.5], dtype=np.float32))
    got, doc = v.of(["You idxiot. fine", "nothing here", "i d i o t", "m.o.r.o.n!", "", "a ixdxixoxt", "id" + 48 * " fine iddiiot"])
    assert set(doc) >= {0, 2, 3, 5, 6} and 1 not in doc and 4 not in doc
    near = tx.similarity(["idxiot", "iddiiot"], ["idiot", "idiot"])
    assert np.isclose(got[doc == 0, :2].max(), near[0], atol=1e-6)
    assert np.isclose(got[doc == 2, :2].max(), 1) and np.isclose(got[doc == 3, 1].max(), 1)
    assert np.isclose(got[doc == 5, 0].max(), 1)  # a letter between any two
    # the mean over all words, times DENSE, and the two values over all landmarks
    assert np.isclose(got[doc == 6, 2].max(), min(tx.FULL, tx.DENSE * 48 * near[1] / 97), atol=1e-5)
    assert np.isclose(got[doc == 3, 4].max(), 0.5) and got.shape[1] == 6


def test_two_inserted_characters_are_near():
    marks = ["idiot", "worthless", "zuvkel"]
    v = tx.Values(marks, np.ones(3, dtype=np.float32))
    for k, text in ((0, "idxizot"), (0, "i.d.x.i.o.t"), (1, "wo#rthx less worxthxless"), (2, "zxuvkxel"), (2, "zxuxvxkxexl")):
        got, _ = v.of([text])
        assert got[:, k].max() >= tx.FLOOR, text


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(3)
    d = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * d))).astype(int)
    model = tx.Model(["a"], np.ones(1), np.zeros(4), 0.0, *tx.isotonic(d, y))
    grid = np.linspace(-5, 5, 400)
    p = tx.chances(model, grid)
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1
    assert np.abs(p - 1 / (1 + np.exp(-3 * grid))).max() < 0.12


def sentences(n=4000, marks=20, seed=5):
    """Values of sentences, eight a text, the texts that they are of, and y."""
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 2).astype(np.int64)
    doc = np.repeat(np.arange(n), 8)
    values = (rng.random((len(doc), 2 * marks + 2)) * (rng.random((len(doc), 1)) < 0.2 + 0.5 * y[doc, None])).astype(np.float32)
    return ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(marks)], np.ones(marks, dtype=np.float32), values, doc, y


def test_training_holds_values_once():
    given = sentences()
    tracemalloc.start()
    try:
        model = tx.fit(*given)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * given[2].nbytes  # beside the values themselves
    assert np.isfinite(model.weights).all() and model.weights.max() > 0


def test_machine_is_the_same_by_parts_and_at_its_least(monkeypatch):
    _, _, values, doc, y = sentences(60, 4)
    y, gram = y[doc], np.eye(values.shape[1])
    w, b = tx.machine(values, gram, y)
    monkeypatch.setattr(tx, "ROWS", 7)
    few, c = tx.machine(values, gram, y)
    assert np.allclose(w, few, atol=1e-6) and abs(b - c) < 1e-6
    some = np.flatnonzero(np.arange(len(y)) % 3 > 0)
    assert np.allclose(tx.machine(values, gram, y[some], rows=some)[0], tx.machine(values[some], gram, y[some])[0], atol=1e-6)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum()) * 2 * len(gram)

    def loss(w, b):
        return 0.5 * w @ w + (share * np.maximum(0, 1 - np.where(y > 0, 1, -1) * (values.astype(np.float64) @ w + b)) ** 2).sum()

    for k in range(len(w)):
        for d in (-1e-2, 1e-2):
            other = np.maximum(0, w + d * (np.arange(len(w)) == k))
            assert loss(other, b) >= loss(w, b) - 1e-6
    assert min(loss(w, b + 1e-2), loss(w, b - 1e-2)) >= loss(w, b) - 1e-6


def test_values_are_gathered_in_the_order_of_ids():
    rows = [("b", 1, [1.0, 2, 3, 4]), ("c", 0, []), ("a", 0, [5.0, 6])]
    parts = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([y], pa.int32()), pa.array([v], pa.list_(pa.float32()))], ["id", "y", "v"]) for i, y, v in rows]
    table = pa.concat_tables([pa.Table.from_batches(parts[:1]), pa.Table.from_batches(parts[1:]).combine_chunks()])
    values, doc, y = tx._gathered(table, 2)
    assert values.tolist() == [[5, 6], [1, 2], [3, 4], [0, 0]] and doc.tolist() == [0, 1, 1, 2] and y.tolist() == [0, 1, 0]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    bad = ["zuvkel", "quomber", "fygglo"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ".", "s"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_learn_and_score(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(5, None)], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    held = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 300]
    assert np.mean(held) > 0.95
    probe = spark.createDataFrame([(1, "z.u.v.k.e.l there"), (2, "an zuvxkel"), (3, None), (4, ""), (4, ""), (5, "sh iot " * 500)], "doc_id long, text string")
    s = sorted((r.doc_id, r.score) for r in tx.score(probe, model).collect())
    assert s[0][1] > 0.7 and s[1][1] > 0.5 and all(x < 0.3 for _, x in s[2:]) and len(s) == 6
    assert tx.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.score(docs, tx.learn(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in tx.score(docs, tx.learn(docs, one)).collect()} == {1.0}
