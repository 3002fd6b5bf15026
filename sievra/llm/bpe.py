"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as its part boundaries and the rank of each adjacent pair. The lowest rank is found
by a scan, the boundary between the two parts is deleted, and the two neighbouring ranks are looked
up again. Words longer than `LONG` bytes, where repeated scans are quadratic, use a heap over the
same ranks and give the same parts.

Texts: null counts as empty (no ids; the hash of nothing). Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_pieces, text_or_empty, tidy

LONG = 256
#: Words kept encoded per worker and generation; two generations are held.
CACHE = 400_000
NONE = 1 << 60

# The split pattern of the vocabulary; white space is Unicode's White_Space property.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
_TWO_BLANKS = regex.compile(rf"[{_WS}][{_WS}]")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 is itself, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


class Vocabulary:
    """Ranks of pairs, ids of byte strings, and special tokens, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        #: ranks of pairs of single bytes, where every word starts
        self.first = [NONE] * 65536
        for (a, b), r in self.ranks.items():
            if len(a) == len(b) == 1:
                self.first[a[0] << 8 | b[0]] = r
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def parts(self, word: bytes) -> list[bytes]:
        """The parts of one word after all merges."""
        return self._by_heap(word) if len(word) > LONG else self._by_scan(word)

    def _by_scan(self, word: bytes) -> list[bytes]:
        get = self.ranks.get
        bounds = list(range(len(word) + 1))
        first = self.first
        ranks = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            del bounds[i + 1]
            del ranks[i]
            if i:
                ranks[i - 1] = get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), NONE)
            if i < len(ranks):
                ranks[i] = get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NONE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _by_heap(self, word: bytes) -> list[bytes]:
        n, get = len(word), self.ranks.get
        end = list(range(1, n + 1))  # the part that starts at i ends at end[i]
        before = list(range(-1, n))  # start of the part that ends where i starts
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not (live[i] and end[i] == mid and mid < n and live[mid] and end[mid] == stop):
                continue
            end[i], live[mid] = stop, False
            if stop < n:
                before[stop] = i
                if (r := get((word[i:stop], word[stop : end[stop]]))) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (h := before[i]) >= 0 and (r := get((word[h:i], word[i:stop]))) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text without special tokens in it."""
        return [self.ids[p] for w in PATTERN.findall(text) for p in self.parts(w.encode())]

    def _remember(self, chunk: str) -> tuple[str, bytes]:
        found = self.old.get(chunk)
        if found is None:
            words = PATTERN.findall(chunk)
            if len(words) > 1:
                get = self.young.get
                parts = [get(w) or self._remember(w) for w in words]
                found = ",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])
            else:
                ids = [self.ids[p] for p in self.parts(chunk.encode())]
                found = ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])
        if len(chunk) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def _chunks(self, text: str) -> list[str]:
        """Cuts of the text between which no word of the pattern runs.

        A blank followed by a non-blank always starts a word; so, without two blanks in a row, one may cut at each space.
        """
        if _TWO_BLANKS.search(text):
            return PATTERN.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + w for w in rest)] if first else [" " + w for w in rest]

    def encoded(self, text: str) -> list[tuple[str, bytes]]:
        """For each chunk of the text: decimal ids joined by commas, and the bytes that these ids decode to."""
        out: list[tuple[str, bytes]] = []
        pieces = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                out.append((str(i := self.special[piece]), self.bytes[i]))
            elif piece:
                get = self.young.get
                out += [get(c) or self._remember(c) for c in self._chunks(piece)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for s, _ in self.encoded(text) for i in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD; unknown ids are passed over."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of each whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in in_pieces(batches, "_text"):
            ids = [vocab.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    return df.select(df[id_col].alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each array of ids; null ids give an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in in_pieces(batches, "_ids"):
            texts = [vocab.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    return df.select(df[id_col].alias("_id"), df[ids_col].alias("_ids")).mapInArrow(tidy(run), f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): a round trip of each whole text, as digests.

    ids_sha256 is over the decimal ids joined by commas; decoded_sha256 is over what the ids decode to.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in in_pieces(batches, "_text"):
            n, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                found = vocab.encoded(text)
                joined = ",".join([x[0] for x in found])
                decoded = b"".join([x[1] for x in found]).decode("utf-8", errors="replace")
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plan = df.select(df[id_col].alias("_id"), text_or_empty(text_col).alias("_text"))
    return plan.mapInArrow(tidy(run), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
