"""Packing of tokenised documents into windows by minimum bin slack.

1. Every text is tokenised and cut at multiples of the window; what is left over is a piece shorter than it.
2. Only the histogram of piece lengths (at most `window` entries, whatever the corpus) goes to the driver.
   There, for one window after the other, a bitset subset-sum over the lengths still in stock finds the
   multiset with the largest sum up to the window, always with the longest piece in it; backtracking gives
   how often each length is in it. That pattern is used as often as the stock allows.
   If even the best multiset leaves slack, one more piece is cut to fill it. What remains at the end and
   can't fill a window is laid out in sequences whose sizes are powers of two, which need no padding.
3. Each piece finds its place by its rank among the pieces of its length. Ranks come from counts
   per (length, hash bucket of the id), so that no length, however common, meets in one task.

Texts: null counts as empty; every document has at least the end id. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_letters
from .common import in_pieces, stage, text_or_empty, tidy

CACHE = 250_000
#: Pieces of one length and bucket are ranked together. There are BUCKETS buckets, or more, so that even if all pieces
#: had one length, a bucket would hold about BUCKET_ROWS.
BUCKETS, BUCKET_ROWS = 64, 500_000
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: Printable ASCII, and letters that are composed already, lower alike everywhere and are letters in every Unicode version.
PLAIN = regex.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]*")
#: Marks behind a word; any number of them is one word of the split.
MARKS = ".,;:!?"


class Encoder:
    """ids of the tokenizers library, remembered per run of non-blank characters.

    The vocabulary's words never run across white space, so the ids of a text are those of its runs in order.
    A new run of printable ASCII and letters of PLAIN is split here as the tokenizer file says, and its words go to the
    library's model; any other run goes to the library as it is. A run of letters with MARKS behind them, as nearly all
    are, is split without the file's pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: no special token is in a run of letters with MARKS behind them
        self.apart = all(any(not c.isalpha() and c not in MARKS for c in s) for s in self.special)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = {b: c for c, b in byte_letters().items()}
        self.packed = [struct.pack("<I", i) for i in range(1 + max(spec["model"]["vocab"].values()))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """ids of one word of the split."""
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _new(self, run: str) -> bytes:
        """ids of a run that isn't remembered."""
        get, core = self.young.get, run.rstrip(MARKS)
        if not core and self.apart:
            return self._word(run)
        if core.isalpha() and self.apart and (core.isascii() or PLAIN.fullmatch(core)):
            word, marks = core.lower(), run[len(core) :]
            if word == run:
                return self._word(run)
            found = get(word) or self._remember(word)
            return found + (get(marks) or self._remember(marks)) if marks else found
        if PLAIN.fullmatch(run) is None or any(s in run for s in self.special):
            return self._of(run)
        words = self.pattern.findall(run.lower())
        return self._word(run) if words == [run] else b"".join([get(w) or self._remember(w) for w in words])

    def _remember(self, run: str) -> bytes:
        found = self.old.get(run)
        if found is None:
            found = self._new(run)
        if len(run) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in ODD_BLANKS):  # str.split() takes these for white space, the library doesn't
            return self._of(text)
        get = self.young.get
        return b"".join([get(w) or self._remember(w) for w in text.split()])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fill(stock: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths with the longest length in it and the largest sum up to capacity; its sum.

    Sums are bits of an integer; each length enters in batches of 1, 2, 4, ... copies. Walking the kept
    bitsets backwards gives the counts.
    """
    lengths = sorted((n for n in stock if stock[n] > 0 and n <= capacity), reverse=True)
    if not lengths:
        return {}, 0
    longest = lengths[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    sums, trail = 1, []
    for n in lengths:
        left = min(stock[n] - (n == longest), room // n)
        batch = 1
        while left > 0 and not sums >> room & 1:
            k = min(batch, left)
            trail.append((n, k, sums))
            sums = (sums | sums << n * k) & mask
            left -= k
            batch *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    total = longest + at
    counts: dict[int, int] = defaultdict(int)
    counts[longest] = 1
    for n, k, earlier in reversed(trail):
        if not (at < earlier.bit_length() and earlier >> at & 1):
            counts[n] += k
            at -= n * k
    return dict(counts), total


class Plan:
    """Places for all pieces of a histogram {length: count}.

    rules: (length, first rank, last rank + 1, start in the piece, part length, first sequence, sequences a step,
    offset, steps a rank) as parallel rows; a piece of rank r inside lies in sequence first + (r - rank) // per.
    """

    def __init__(self, histogram: dict[int, int], window: int):
        self.window = window
        self.rules: list[tuple[int, int, int, int, int, int, int]] = []
        #: by present length: spans of pieces [original length, first rank, end rank, start]
        self.spans: dict[int, list[list[int]]] = {}
        self.stock = {n: c for n, c in histogram.items() if n > 0 and c > 0}
        for n, c in self.stock.items():
            self.spans[n] = [[n, 0, c, 0]]
        self.sequences = 0
        while self.stock:
            pattern, total = best_fill(self.stock, window)
            if total == window:
                self._use(pattern, {}, window)
            elif self._has_more(pattern):
                self._use(pattern, self._cut(pattern, window - total), window)
            else:
                self._tail()
        self.rules.sort()

    def _has_more(self, pattern: dict[int, int]) -> bool:
        return any(c > pattern.get(n, 0) for n, c in self.stock.items())

    def _cut(self, pattern: dict[int, int], slack: int) -> dict[int, int]:
        """{length to cut: part to take}. Every piece not in the pattern is longer than the slack."""
        fit = [n for n, c in self.stock.items() if c > pattern.get(n, 0) and n > slack]
        return {max(fit, key=lambda n: (self.stock[n] - pattern.get(n, 0), n)): slack}

    def _take(self, length: int, count: int) -> list[list[int]]:
        """Spans with so many pieces of the length, out of stock."""
        out, spans = [], self.spans[length]
        while count:
            span = spans[-1]
            k = min(count, span[2] - span[1])
            out.append([span[0], span[1], span[1] + k, span[3]])
            span[1] += k
            count -= k
            if span[1] == span[2]:
                spans.pop()
        self.stock[length] -= sum(s[2] - s[1] for s in out)
        if not self.stock[length]:
            del self.stock[length], self.spans[length]
        return out

    def _put(self, length: int, span: list[int]) -> None:
        if length:
            self.spans.setdefault(length, []).append(span)
            self.stock[length] = self.stock.get(length, 0) + span[2] - span[1]

    def _lay(self, spans: list[list[int]], part: int, first: int, offset: int) -> None:
        for original, a, b, start in spans:
            self.rules.append((original, start, a, b, part, first, offset))
            first += b - a

    def _use(self, pattern: dict[int, int], cut: dict[int, int], window: int) -> None:
        """As many windows of this pattern as the stock allows; in each, one more piece is cut if asked for."""
        need = dict(pattern)
        for n in cut:
            need[n] = need.get(n, 0) + 1
        times = min(self.stock[n] // k for n, k in need.items())
        offset, first = 0, self.sequences
        for n, k in pattern.items():
            for _ in range(k):
                self._lay(self._take(n, times), n, first, offset)
                offset += n
        for n, part in cut.items():
            taken = self._take(n, times)
            self._lay(taken, part, first, offset)
            for original, a, b, start in taken:
                self._put(n - part, [original, a, b, start + part])
        self.sequences += times

    def _tail(self) -> None:
        """What is left, less than a window in all: sequences as long as powers of two, cut where they end."""
        left = sum(n * c for n, c in self.stock.items())
        while left:
            size = 1 << left.bit_length() - 1
            offset = 0
            while offset < size:
                n = max((x for x in self.stock if x <= size - offset), default=None) or min(self.stock)
                part = min(n, size - offset)
                taken = self._take(n, 1)
                self._lay(taken, part, self.sequences, offset)
                for original, a, b, start in taken:
                    self._put(n - part, [original, a, b, start + part])
                offset += part
            self.sequences += 1
            left -= size

    def lookup(self) -> dict[int, list[tuple[list[int], list[tuple[int, int, int, int]]]]]:
        """By original length, for each start in the piece: ends of rank spans, and (first rank, part, sequence, offset)."""
        out: dict = {}
        for original, start, a, b, part, first, offset in self.rules:
            starts, rows = out.setdefault(original, {}).setdefault(start, ([], []))
            starts.append(a)
            rows.append((a, b, part, first, offset))
        return {n: [(start, *x) for start, x in sorted(by.items())] for n, by in out.items()}


def tokenise(docs: DataFrame, vocab_path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key of the ids, start, length, ids, doc_tokens, crc32): pieces of at most `window` ids; ids as little-endian 32-bit."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in in_pieces(batches, "_text", 4 << 20):
            rows, start, length, ids, total, key, crc = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                blob = enc.encode(text) + end
                n = len(blob) // 4
                tag = zlib.crc32(blob)
                for a in range(0, n, window):
                    part = blob[4 * a : 4 * (a + window)]
                    rows.append(i)
                    start.append(a)
                    length.append(len(part) // 4)
                    ids.append(part)
                    total.append(n)
                    key.append(tag)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(crc, pa.int64())],
                ["_id", "_key", "_start", "_length", "_ids", "_total", "_crc"],
            )

    plan = docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text"))
    return plan.mapInArrow(tidy(run), f"_id {kind}, _key long, _start long, _length int, _ids binary, _total long, _crc long")


def pack(
    docs: DataFrame, vocab_path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (array<int>).

    Each id of each document lies in exactly one piece; the pieces of a sequence follow each other from offset 0.
    Only lengths and ranks are shuffled; ids are fetched for pieces that the plan cuts (or for all, with_ids).
    """
    pieces = stage(tokenise(docs, vocab_path, end_id, window, id_col, text_col), "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    keyed = pieces.drop("_ids").withColumn("_bucket", F.pmod(F.xxhash64("_id", "_start"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("_length", "_bucket").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("count")).collect()}  # at most `window` rows
    plan = Plan(histogram, window)
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_length", "_bucket").orderBy("_id", "_start", "_key")
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["_length", "_bucket"])
    ranked = ranked.select("_id", "_key", "_start", "_length", "_crc", "_total", (F.col("_rank") + F.col("_before")).alias("_rank"))
    shared = docs.sparkSession.sparkContext.broadcast(plan.lookup())  # bounded by the window, not by the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_pylist(), batch.column(6).to_pylist()
            rows, out = [], [[] for _ in range(4)]
            for i, (n, r) in enumerate(zip(lengths, ranks)):
                for cut, firsts, spans in rules[n]:
                    k = bisect_right(firsts, r) - 1
                    if k >= 0 and r < spans[k][1]:
                        a, _, part, first, offset = spans[k]
                        rows.append(i)
                        for col, v in zip(out, (cut, part, first + r - a, offset)):
                            col.append(v)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(6)), *(pa.array(c, pa.int64()) for c in out)], names)

    names = ["_id", "_key", "_start", "_length", "_crc", "_total", "_cut", "_part", "_sequence", "_offset"]
    placed = ranked.mapInArrow(tidy(place), f"_id {kind}, _key long, _start long, _length int, _crc long, _total long, _cut long, _part long, _sequence long, _offset long")
    out = [F.col("_id").alias(id_col), (F.col("_start") + F.col("_cut")).alias("start"), F.col("_part").alias("length"), F.col("_crc").alias("ids_crc32"), F.col("_total").alias("doc_tokens"), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset")]
    cut_lengths = sorted({rule[0] for rule in plan.rules if rule[4] != rule[0]})
    if not cut_lengths and not with_ids:
        return placed.select(*out)

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_ids", 4 << 20):
            at = lambda name: batch.schema.get_field_index(name)
            parts = [b[4 * c : 4 * (c + n)] for b, c, n in zip(batch.column(at("_ids")).to_pylist(), batch.column(at("_cut")).to_pylist(), batch.column(at("_part")).to_pylist())]
            batch = batch.set_column(at("_crc"), "_crc", pa.array([zlib.crc32(x) for x in parts], pa.int64()))
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), ids], [*names, "ids"])

    keys = ["_id", "_key", "_start"]
    if with_ids:
        mine, source = placed, pieces
    else:
        in_cut = F.col("_length").isin(cut_lengths)
        placed = stage(placed, "placed")
        mine, source = placed.filter(F.col("_part") != F.col("_length")), pieces.filter(in_cut)
    source = source.select(*(F.col(k).alias(f"{k}2") for k in keys), "_ids").dropDuplicates([f"{k}2" for k in keys])  # of repeated rows one will do
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")) & (F.col("_start") == F.col("_start2"))
    fetched = mine.join(source, same).select(*names, "_ids").mapInArrow(tidy(slice_ids), placed.schema.simpleString()[7:-1].replace(":", " ") + ", ids array<int>")
    if with_ids:
        return fetched.select(*out, "ids")
    return placed.filter(F.col("_part") == F.col("_length")).select(*out).unionByName(fetched.select(*out))
