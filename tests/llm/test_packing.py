import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievra.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_as_the_library():
    lib, enc = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(1)
    alphabet = list("aB éÉéΣσİßS'sldt \n\t.,!0123中😀\xa0 \x1c\x85​") + ["<|endoftext|>", "<|startoftext|>", "'LL", "  "]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 50)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_kind_of_code_point_as_the_library():
    lib, enc = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    points = [*range(0x600), *(c for c in range(0x600, 0x110000, 61) if not 0xD800 <= c < 0xE000), 0x88F, 0xC5C, 0xCDC, 0x1E9E, 0x212A, 0xFB01]
    for form in ("{}", "a{}b", "a {} b", "É{}é"):
        texts = [form.format(chr(c)) for c in points]
        for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == want.ids, repr(t)


def test_letters_and_marks_are_split_without_the_pattern():
    lib, enc = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    enc.pattern = None
    words = ["Atthor", "esin", "ÉCOLE", "straße", "ñezdoar", "s", "I", "ĮĖ", "ÿ", "a" * 80]
    marks = ["", ",", ".", "!?", "...", ";:", ".,;:!?" * 12]
    texts = [f"{w}{m} {w.lower()}{m}\n{w}" for w in words for m in marks]
    for t in texts * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def brute(stock, capacity):
    longest = max(n for n in stock if n <= capacity)
    sums = {longest}
    for n, c in stock.items():
        for _ in range(c - (n == longest)):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8), st.integers(40, 64))
def test_best_fill_is_the_least_slack(stock, capacity):
    counts, total = packing.best_fill(stock, capacity)
    assert total == sum(n * k for n, k in counts.items()) == brute(stock, capacity)
    assert all(k <= stock[n] for n, k in counts.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_covers_everything_without_padding(histogram):
    plan = packing.Plan(histogram, 64)
    held, fill = {}, {}
    for n, start, a, b, part, first, offset in plan.rules:
        for r in range(a, b):
            held.setdefault((n, r), []).append((start, part))
            fill.setdefault(first + r - a, []).append((offset, part))
    assert set(held) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for (n, _), parts in held.items():
        at = 0
        for start, part in sorted(parts):
            assert start == at
            at += part
        assert at == n
    for parts in fill.values():
        at = 0
        for offset, part in sorted(parts):
            assert offset == at
            at += part
        assert at & (at - 1) == 0 and at <= 64
    assert len(fill) == plan.sequences


def check(rows, docs, window):
    lib = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and ("ids" not in r or list(r.ids) == part)
            assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window


def test_pack(spark):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice(["a", "cat", "xyzzy", "."]) for _ in range(rng.randrange(0, 200))) for i in range(200)}
    docs |= {300: None, 301: "", 302: "word " * 1000} | {400 + i: "same text here" for i in range(100)}
    df = spark.createDataFrame([(i, t, 5) for i, t in docs.items()], "doc_id long, text string, start int")
    check(packing.pack(df, PATH, window=128).collect(), docs, 128)
    check(packing.pack(df, PATH, window=128, with_ids=True).collect(), docs, 128)
    rare = spark.createDataFrame([(i, "a b c " * 11) for i in range(50)], "doc_id long, text string")
    check(packing.pack(rare, PATH, window=64).collect(), {i: "a b c " * 11 for i in range(50)}, 64)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x y")] * 3 + [(None, "z")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 2
