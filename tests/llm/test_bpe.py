import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievra.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    alphabet = list("abc theré'sSTdl  \n\t.,!?0123٣中文😀  \x1c\x1f\x85​́ßİΣς") + ["<|endoftext|>", "'ll", "   ", "\r\n"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    return ["", " ", "a", "a" * 5000, "ab" * 700 + "\n" * 30, "hello world", "<|endoftext|>", "x<|endoftext|> y", "\n a", "a\n \nb", "a \n  b", *made]


def test_ids_and_text_as_the_library(library):
    v = bpe.vocabulary(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert v.encode(text) == want, repr(text)
        assert v.decode(want) == library.decode(want, skip_special_tokens=False), repr(text)


def test_scan_and_heap_agree():
    v = bpe.vocabulary(PATH)
    rng = random.Random(5)
    for _ in range(400):
        w = bytes(rng.choice(b"aabethinor\xc3\xa9 ") for _ in range(rng.randrange(0, 80)))
        assert v._by_scan(w) == v._by_heap(w) if w else v._by_scan(w) == []


def test_digests(spark, library):
    rows = [(1, "the cat"), (2, None), (3, ""), (3, ""), (None, "x y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids_sha256 string")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), h(",".join(map(str, ids))), h(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_encode_decode_frames(spark):
    df = spark.createDataFrame([(1, "the cat <|endoftext|>  sat"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "the cat <|endoftext|>  sat", 2: ""}
