import hashlib
import random

from sievra.llm import fingerprint as fp


def test_spans_and_extensions_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))
        pa_, pb = fp.Prefixes(fp.codes(a)), fp.Prefixes(fp.codes(b))
        for _ in range(20):
            i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert fp.common_extension(pa_, i, pb, j) == n
            k = rng.randrange(10)
            assert fp.same_span(pa_, i, pb, j, k) == (i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k])
        w = rng.randrange(1, 6)
        got = pa_.spans(w).tolist()
        want = [a[i : i + w] for i in range(max(0, len(a) - w + 1))]
        assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]


def test_likeness():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    b = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    f = fp.Fingerprint
    assert f(a).likeness(f(a)) == 1 and f("").likeness(f("")) == 1 and f("").likeness(f("x")) == 0
    assert f(a).likeness(f(b)) < 0.1
    assert 0.3 < f(a).likeness(f(fp.edited(a, b))) < 0.7
    assert f(a).hex() == f(a).hex() != f(b).hex()


def test_edit_likeness(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé中😀 b") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    texts += [None, "", "x", texts[3], "long " * 4000]
    rows = [(i * 7 % 65, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.edit_likeness(df).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t, _), (_, after, _) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == fp.Fingerprint(t).hex() and r.edited_fingerprint == fp.Fingerprint(new).hex()
        assert r.near_next == fp.Fingerprint(t).likeness(fp.Fingerprint(after)) and 0 <= r.near_edited <= 1
    assert fp.edit_likeness(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "abcd")], "doc_id long, text string")
    (r,) = fp.edit_likeness(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    assert fp.fingerprints(df).count() == len(rows)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "ab")] * 3 + [(2, "cd")], "doc_id long, text string")
    assert sorted(r.doc_id for r in fp.edit_likeness(df).collect()) == [1, 1, 1, 2]
