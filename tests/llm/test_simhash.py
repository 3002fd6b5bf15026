import itertools
import random

import numpy as np
import xxhash

from sievra.llm import components, shingles, simhash


def slow_fingerprint(text, width=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    at = list(range(n))

    def up(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((up(a), up(b)))
        at[b] = a
    return [up(x) for x in range(n)]


def test_triples_cover_all_fours():
    t = [set(x) for x in simhash.covering_triples()]
    assert len(t) == 20 and all(any(x <= set(f) for x in t) for f in itertools.combinations(range(8), 4))


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aB éÉ\n\t .,\xa0\x1cz") for _ in range(rng.randrange(0, 60)))
        assert int.from_bytes(simhash.fingerprint(text), "big") == slow_fingerprint(text)


def test_links_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, *base}
    for b in base[:20]:
        for _ in range(12):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}  # a long list
    fps = sorted(fps)
    df = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in fps], "fp binary")
    old, simhash.CHUNK = simhash.CHUNK, 300
    try:
        got = simhash.links(df, simhash.covering_triples(), 4, 4, 8).collect()
    finally:
        simhash.CHUNK = old
    place = {x.to_bytes(8, "big"): i for i, x in enumerate(fps)}
    arr = np.array(fps, dtype=np.uint64)
    want = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4) if i < j]
    pairs = [(place[bytes(r.a)], place[bytes(r.b)]) for r in got]
    assert all(np.bitwise_count(arr[a] ^ arr[b]) <= 64 for a, b in pairs)
    assert roots(len(fps), pairs) == roots(len(fps), want)


def test_components(spark):
    rng = random.Random(3)
    n = 300
    pairs = [(i, i + 1) for i in range(100)] + [(150, i) for i in range(151, 250)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(20)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.vertex: r.root for r in components.components(df).collect()}
    want = roots(n, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in touched}
    assert components.components(df.limit(0)).count() == 0


def test_near_duplicates_64(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    texts += texts[:30] + [None, "", "one two", "ONE two"] + [" ".join(f"w{rng.randrange(9999)}" for _ in range(400))]
    texts += [texts[-1] + " tail", texts[-1].replace("w1", "v1", 1)]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, fp binary")
    fp = [slow_fingerprint(t or "") for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(fp)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    got = {r.doc_id: (int.from_bytes(r.fp, "big"), r.component) for r in simhash.near_duplicates(df, 4, words64=1, max_bits=4).collect()}
    assert got == {i: (fp[i], c) for i, c in enumerate(roots(len(fp), pairs))}
    assert simhash.near_duplicates(df.limit(0), 4, words64=1, max_bits=4).count() == 0


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((n, " ".join(words), g))
        words[rng.randrange(300)] = "changed"
        rows.append((n + 1, " ".join(words), g))
        n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = {r.doc_id: r.component for r in simhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def overlapping(rng, n, changed):
    """Two texts of n words that differ in runs of words at the end: Jaccard of five-word shingles is (n - 4 - changed) / (n - 4 + changed)."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    return " ".join(words), " ".join(words[: n - changed] + [f"x{rng.randrange(10**6)}" for _ in range(changed)])


def test_pairs_at_the_similarity_are_found_and_no_others(spark):
    rng = random.Random(6)
    # 94 shingles: 10 of 94 changed make 84 / 104 = 0.808, 11 make 83 / 105 = 0.790
    texts = [t for changed in (10, 11) for _ in range(60) for t in overlapping(rng, 98, changed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 if i < 120 else i for i in range(len(texts))}


def test_components_of_exact_similarity(spark):
    rng = random.Random(7)
    texts = [None, "", "one two", "ONE  two", "one two three"]
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(30):  # each from an earlier one, so that likeness is of all degrees and chains are long
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    like = lambda a, b: not a | b or 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(sets[i], sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old, simhash.CHUNK = simhash.CHUNK, 8
    try:
        got = {r.doc_id: r.component for r in simhash.near_duplicates(df).collect()}
    finally:
        simhash.CHUNK = old
    assert got == dict(enumerate(roots(len(texts), pairs)))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_a_repeated_line_does_not_make_texts_alike(spark):
    line = " ".join(f"s{k}" for k in range(10)) + " "  # ten shingles, thirty times
    texts = [line * 30 + " ".join(f"{c}{g}_{k}" for k in range(104)) for g in range(20) for c in "yz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.doc_id == r.component for r in simhash.near_duplicates(df).collect())


def test_spread_joins_what_all_pairs_join():
    rng = np.random.default_rng(8)
    n = 300
    rows = rng.integers(0, 256, (6, 64), dtype=np.uint8)[rng.integers(0, 6, n)]
    for r in rows:  # up to half of a row is its own, so that some match no other
        r[rng.integers(0, 64, rng.integers(0, 45))] = rng.integers(0, 256)
    near = lambda x, rest: (rows[rest] == rows[x]).sum(axis=1) >= 34
    want = [(a, b) for a, b in itertools.combinations(range(n), 2) if (rows[a] == rows[b]).sum() >= 34]
    a, b = shingles.spread(n, near)
    assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) <= set(want)
    assert roots(n, list(zip(a.tolist(), b.tolist()))) == roots(n, want)
    assert [len(x) for x in shingles.spread(0, near)] == [0, 0] == [len(x) for x in shingles.spread(1, near)]


def test_candidates_of_long_lists(spark):
    rng = np.random.default_rng(9)
    rows = np.repeat(rng.integers(0, 256, (3, 64), dtype=np.uint8), 150, axis=0)
    for r in rows:
        r[rng.integers(0, 64, 12)] = rng.integers(0, 256, 12)
    names = [f"{i:016d}".encode() for i in range(len(rows))]
    df = spark.createDataFrame([(n + r.tobytes(),) for n, r in zip(names, rows)], "fp binary")
    sets = shingles.disjoint_sets(64, 4, 2)
    got = [(int(r.a), int(r.b)) for r in shingles.candidates(df, sets, 34, 64).collect()]
    # a pair counts where it has all bytes of a set alike
    alike = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (same := rows[a] == rows[b]).sum() >= 34 and any(same[list(s)].all() for s in sets)]
    assert roots(len(rows), got) == roots(len(rows), alike)
