"""Document fingerprints from prefix polynomial hashes.

prefix[i] is the sum of code[k] * base**k, k < i, modulo a prime, for two primes. A span's hash is the difference
of two prefixes times an inverse power: equal spans have equal hashes wherever they lie, so any two spans are
compared in constant time and the longest common extension of two places is found by binary search.
A fingerprint is the hash of the whole text and, for each of SLOTS classes of spans of SPAN code points, the least
hash: texts that share spans share slots. Its likeness to another is Dice's coefficient of the sets of spans as
the slots tell, 1 for equal texts.

Texts: null counts as empty; texts shorter than SPAN are one span; empty texts are alike with each other only.
Documents with equal ids follow each other by text; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, stage, text_or_empty, tidy

# Two primes below 2**31, a base for each and its inverse (from pow(base, -1, prime)).
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 747796405)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES))
SPAN = 12
SLOTS = 64
EMPTY = 0xFFFF


def _powers(base: int, prime: int, n: int, known: np.ndarray) -> np.ndarray:
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)])
    return known


_POWERS = [np.ones(1, dtype=np.uint64) for _ in range(4)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Prefixes:
    """Prefix arrays of a text's code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        values = points.astype(np.uint64) + np.uint64(1)
        for k in range(2):
            p = np.uint64(PRIMES[k])
            _POWERS[k] = _powers(BASES[k], PRIMES[k], self.n, _POWERS[k])
            _POWERS[k + 2] = _powers(INVERSES[k], PRIMES[k], self.n + 1, _POWERS[k + 2])
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(values * _POWERS[k][: self.n] % p, out=s[1:])
            self.sums.append(s % p)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of points[start:end]."""
        return tuple(int((int(s[end]) - int(s[start])) % p * int(inv[start]) % p) for s, p, inv in zip(self.sums, PRIMES, _POWERS[2:]))

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width, both primes' in one number."""
        out = np.zeros(max(0, self.n - width + 1), dtype=np.uint64)
        for k in range(2):
            p, s = np.uint64(PRIMES[k]), self.sums[k]
            h = (s[width:] + p - s[: len(out)]) % p * _POWERS[k + 2][: len(out)] % p
            out |= h << np.uint64(31 * k)
        return out


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether `length` code points from i in a and from j in b are equal (as their hashes tell)."""
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from i in a and from j in b are equal, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same_span(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


class Fingerprint:
    def __init__(self, text: str):
        self.prefixes = Prefixes(codes(text))
        n = self.prefixes.n
        self.whole = self.prefixes.span(0, n)
        self.slots = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
        if n:
            h = self.prefixes.spans(min(SPAN, n))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            np.minimum.at(self.slots, (h % np.uint64(SLOTS)).astype(np.int64), h >> np.uint64(6))
        none = self.slots == np.iinfo(np.uint64).max
        self.short = np.where(none, EMPTY, self.slots % np.uint64(EMPTY)).astype(np.uint16)

    def hex(self) -> str:
        return f"{self.whole[0]:08x}{self.whole[1]:08x}{self.prefixes.n:08x}" + self.short.astype(">u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        if (self.prefixes.n, self.whole) == (other.prefixes.n, other.whole):
            return 1.0
        used = (self.short != EMPTY) | (other.short != EMPTY)
        if not used.any():
            return 0.0
        jaccard = float((used & (self.short == other.short)).sum() / used.sum())
        return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def _judge(text: str, own: Fingerprint, after: str, next_: Fingerprint) -> tuple:
    new = edited(text, after)
    f = Fingerprint(new)
    return (
        len(text),
        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        own.hex(),
        f.hex(),
        own.likeness(f),
        own.likeness(next_),
        common_extension(own.prefixes, 0, f.prefixes, 0),
        common_extension(own.prefixes, 0, next_.prefixes, 0),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text"):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([Fingerprint(t).hex() for t in texts], pa.string())], ["_id", "n_chars", "fingerprint"])

    return docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, n_chars long, fingerprint string").withColumnRenamed("_id", id_col)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FIELDS): each document against its edited text and against the next document by id, the last against the first.

    Texts are range-partitioned by id and read in order, so the next document is at hand; only the first and
    the last document of each partition are kept aside and meet in a join of one row per partition.
    common_edited and common_next: how many code points both texts begin with.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the row whose next one isn't known yet: its batch, place, text, fingerprint
        columns = ["_id", *names, "_part", "_role", "_text"]

        def edge(batch: pa.RecordBatch, i: int, role: str, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.nulls(1, t) for t in types), pa.array([part], pa.int32()), pa.array([role], pa.string()), pa.array([text], pa.string())], columns)

        for batch in in_pieces(batches, "_text", 4 << 20):
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = Fingerprint(text)
                if held is None:
                    yield edge(batch, i, "first", text)
                else:
                    ids.append(held[0].column(0).slice(held[1], 1))
                    rows.append(_judge(held[2], held[3], text, own))
                held = (batch, i, text, own)
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(zip(*rows), types)), pa.array([part] * n, pa.int32()), pa.array(["row"] * n, pa.string()), pa.nulls(n, pa.string())], columns)
        if held is not None:
            yield edge(held[0], held[1], "last", held[2])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_judge(a, Fingerprint(a), b, Fingerprint(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["_id", *names])

    plan = docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text"))
    plan = plan.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    all_ = stage(plan.mapInArrow(tidy(ordered), f"_id {kind}, {FIELDS}, _part int, _role string, _text string"), "ordered")
    edges = all_.filter(F.col("_role") != "row")
    numbers = sorted(r[0] for r in edges.filter("_role = 'first'").select("_part").collect())  # one for each task
    follow = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "_part int, _after int")
    firsts = edges.filter("_role = 'first'").select(F.col("_part").alias("_after"), F.col("_text").alias("_next"))
    lasts = edges.filter("_role = 'last'").select("_part", "_id", "_text")
    ends = lasts.join(follow, "_part").join(firsts, "_after").select("_id", "_text", "_next").mapInArrow(tidy(pairs), f"_id {kind}, {FIELDS}")
    return all_.filter("_role = 'row'").select("_id", *names).unionByName(ends).withColumnRenamed("_id", id_col)
