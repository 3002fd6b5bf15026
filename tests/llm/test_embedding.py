import math
import random

import numpy as np

from sievra.llm import embedding


def brute(vectors, t):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t:
                    links[i].add(j)
    root = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        root[i] = min(seen)
    return [len(x) for x in links], root


def vectors():
    rng = np.random.default_rng(1)
    out = [rng.normal(size=12).astype(np.float32).tolist() for _ in range(250)]
    for c in range(6):
        base = rng.normal(size=12)
        out += [(base + rng.normal(size=12) * 0.25).astype(np.float32).tolist() for _ in range(25)]
    out += [out[3]] * 40 + [(np.array(out[3], np.float32) * 2).tolist()]
    out += [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None] * 6, [float("inf")] + [0.0] * 11, [1.0, 2.0], [2.0, 4.0], [1e-30] * 12, [1e30] * 12]
    random.Random(2).shuffle(out)
    return out


def test_against_all_pairs(spark, monkeypatch):
    vs = vectors()
    monkeypatch.setattr(embedding, "LEAST", 40)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(df).collect()}
    links, root = brute([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vs], 0.95)
    assert got == {i: (links[i], root[i], root[i] == i) for i in range(len(vs))}


def test_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted(embedding.near_duplicates(df).collect(), key=str)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    assert embedding.near_duplicates(df.filter("vec_id is null")).collect()[0].kept


def test_boxes_never_skip_a_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5))
    basis = embedding.axes(embedding.unit(x))
    order = np.argsort(embedding.grid_keys(embedding.unit(x) @ basis, 0.3163))
    s = embedding.Sequence(x[order], basis)
    got = {(a + i, c + j) for a, c, near in embedding.join(s, s, 0.95) for i, j in zip(*np.nonzero(near))}
    near = embedding.unit(x[order]) @ embedding.unit(x[order]).T >= 0.95
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    assert {tuple(sorted(p)) for p in got} == want
