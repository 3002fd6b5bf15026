import random
from collections import Counter

import pytest

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EN, FR = "the of and house water with thing over under great", "le la des maison avec eau chose sur sous grand"


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "ly", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, (EN if i % 3 else FR).split(), 120), "en" if i % 3 else "fr", "s") for i in range(300)]
    labels = [(i, 1, 0) for i in range(300)]
    toxic = [(300 + k, prose(rng, EN.split(), 60) + f" you zuvkel{'s' * (k % 2)} " + prose(rng, EN.split(), 60), "en", "s") for k in range(40)]
    labels += [(300 + k, 0, 1) for k in range(30)]
    near = rows[5][1].split()
    near[60] = "changed"
    passage = " ".join(f"shared{k}x{rng.randrange(99)}" for k in range(40))
    extra = [
        (400, None, "en", "s"), (401, "", None, "s"), (402, "12 34 !!", "en", "s"),
        (403, rows[7][1], "en", "s"), (404, " ".join(near), "en", "s"), (10, rows[10][1], "en", "other"), (None, rows[11][1], "en", "s"),
        (405, prose(rng, EN.split(), 80) + " " + passage + " " + prose(rng, EN.split(), 80), "en", None),
        (406, prose(rng, EN.split(), 80) + " é" + passage + "é " + prose(rng, EN.split(), 80), None, "s"),
    ]
    rows += toxic + extra
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, passage


def test_stages(spark, made):
    path, rows, passage = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clash = ["score", "lang_pred", "row", "kept_text", "_text", "c0", "fp"]
    docs = docs.selectExpr(*COLUMNS, *(f"'x{i}' AS {c}" for i, c in enumerate(clash)))
    seen = {}
    for name, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, path), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [*COLUMNS, *clash] and all(r[c] == f"x{i}" for r in seen[name] for i, c in enumerate(clash))
    ids = {k: Counter(r.doc_id for r in v) for k, v in seen.items()}
    assert set(Counter(r[0] for r in rows)) - set(ids["language"]) == {400, 401, 402}
    assert {r.doc_id: r.lang for r in seen["language"]}[406] == "en"
    gone = set(ids["language"]) - set(ids["toxicity"])
    assert gone <= set(range(300, 340)) and len(gone) >= 38
    after = ids["near_duplicates"]
    assert after[10] == 1 and 403 not in after and 404 not in after and 7 in after and 5 in after
    assert set(ids["toxicity"]) - set(after) == {403, 404, 11}  # null ids come first, so row 11 goes
    assert ids["passages"] == after
    text = {r.doc_id: r for r in seen["passages"]}
    assert passage[:-3] not in text[405].text and passage[:-3] not in text[406].text and "shared" not in text[405].text
    assert all(r.n_chars == len(r.text) for r in seen["passages"])
    pieces = Counter()
    for r in seen["packing"]:
        pieces[r.sequence_id] += r.length
    assert set(r.doc_id for r in seen["packing"]) == set(after) and max(pieces.values()) <= 4096
    assert sum(r.length for r in seen["packing"]) == sum({r.doc_id: r.doc_tokens for r in seen["packing"]}.values())


def test_empty_table(spark, made):
    path, _, _ = made
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, path), name)
        assert docs.count() == 0


def test_run(spark, made):
    assert cp.run(spark, made[0]).count() > 200


def test_unknown_languages_go(spark, made):
    path, rows, _ = made
    rng = random.Random(8)
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80))
    both = " ".join(prose(rng, w.split(), 60) for w in (EN, FR))
    extra = [(500, gibberish), (501, "мы читаем книги и пишем письма " * 20), (502, both), (503, prose(rng, EN.split(), 100) + " мы читаем книги")]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in extra], docs.schema))
    kept = {r.doc_id for r in cp.identify_language(spark, docs, path).collect()}
    assert {502, 503} <= kept and not kept & {500, 501} and {r[0] for r in rows[:340]} <= kept
