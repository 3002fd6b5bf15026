import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sievra.llm import suffix


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_refine_is_the_suffix_order():
    rng = random.Random(1)
    for length in (8, 13, 20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))).encode() for _ in range(12)]
        data = b"".join(texts)
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        at, bucket = suffix.refine(np.frombuffer(data, np.uint8), ends, length)
        strings = {i: data[i : i + length] for i in range(len(data)) if i + length <= ends[i]}
        count = Counter(strings.values())
        assert sorted(at.tolist()) == [i for i, s in strings.items() if count[s] > 1]
        by = {}
        for i, b in zip(at.tolist(), bucket.tolist()):
            by.setdefault(b, set()).add(strings[i])
        assert all(len(s) == 1 for s in by.values()) and len(by) == len({strings[i] for i in at.tolist()})


def test_every_window_has_its_anchor():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    old, suffix.STEP = suffix.STEP, 500
    cut = suffix.anchors(data, 50, 20)
    suffix.STEP = old
    at, _ = suffix.anchors(data, 50, 20)
    assert at.tolist() == cut[0].tolist()
    assert all(any(i <= a <= i + 30 for a in at) for i in range(len(data) - 49))


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(12) for _ in range(6)]
    texts = []
    for i in range(150):
        parts = [prose(rng.randrange(1, 30))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), passages[i % 6])
        if i % 7 == 0:
            parts.append(passages[0][: rng.randrange(20, 60)])
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[9][5:], texts[9][:-3] + "x", None, "", "short", "a" * 500, "ab" * 300 + "c", "x" + "a" * 90]
    texts += [passages[2] + " " + word() + " " + passages[2]]
    return texts


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, 40).collect()}
    want = brute(texts, 40)
    assert got == dict(enumerate(want))
    assert sum(w[1] > 0 for w in want) > 40


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "tail"), (2, "other"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(df, 50).collect()))
    n = len(text)
    assert got == [(0, n + 4, n), (1, n, n), (1, n, n), (2, 0, 0), (2, 5, 0)]
    assert suffix.remove_repeats(df.limit(0), 50).count() == 0
