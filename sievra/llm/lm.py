"""Language-model scores by deleted interpolation.

The probability of a word after another mixes its bigram, its unigram and a uniform estimate; the weights depend on how
frequent the context is (buckets of its count, by powers of two) and are learned by expectation-maximisation on counts
that were held out from the estimates: a part of the training documents is deleted, the weights that make its counts
likeliest are found, and the counts are put back.

All counts are over all documents. Words are counted by hash over the cluster. The vocabulary of the bigrams are the most
frequent words, at most WORDS, which are broadcast with their counts; a rarer word is read as one class, and its
probability inside the class mixes its relative frequency and a uniform share in the same way (its count comes by a
join; it is rare among the training documents, so none holds much of it). Bigrams of the vocabulary and the class are
counted whatever their number: a chunk of documents gives sorted runs of its distinct bigrams, one for each of as many
buckets as the corpus needs, and a bucket's runs are merged in one place. The most frequent bigrams, at most PAIRS of
them counted over all documents, are broadcast and scored where they stand; the other occurrences go to their bucket and
come back as sums for each document, packed by groups of documents. As a bigram beyond PAIRS is rare, no bucket is hot.

The base score is that of an add-one unigram model. Texts: null counts as empty: one token, the end; very long texts are
read whole. Without training documents the base is 0 a token and the model is uniform. Repeated rows each get a row;
empty tables none. Columns of any other name, clashing ones too, change nothing. Ties in frequency go by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, stage, text_or_empty, tidy

#: Words of the vocabulary and bigrams that are broadcast, at most.
WORDS, PAIRS = 1 << 20, 1 << 20
CACHE = 400_000
#: One of this many training documents is held out for the weights.
HELD = 8
BUCKETS = 40
#: Exact counts up to here, eighths of powers of two beyond, where counts are put into bins.
EXACT = 64
END = b""  # no word is empty
#: Tokens of a chunk, and of a bucket of bigrams.
CHUNK, BUCKET = 1 << 21, 1 << 20
#: Documents whose sums come back together: two to this power.
GROUP = 9
#: Bits of a bigram's number. Numbers are mixed by an odd factor, so that their leading bits spread over the buckets.
BITS = 42
_ODD = 0x9E3779B97F5
_BACK = pow(_ODD, -1, 1 << BITS)
_MASK = np.uint64((1 << BITS) - 1)


class Reader:
    """Hashes of words, 8 bytes each, remembered per worker."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.end = xxhash.xxh64_digest(END)

    def _learn(self, word: bytes) -> bytes:
        found = xxhash.xxh64_digest(word)
        if len(word) <= 64:
            if len(self.young) >= CACHE:
                self.young.clear()
            self.young[word] = found
        return found

    def read(self, raw: bytes) -> bytes:
        """The tokens of a text: its words, then the end."""
        get = self.young.get
        return b"".join([get(w) or self._learn(w) for w in raw.lower().split()]) + self.end  # of bytes: A-Z, and \x20 \x09-\x0D


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of token strings, and how many each row has."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype="<i8"), np.array([len(b) // 8 for b in blobs], dtype=np.int64)


def _places(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in a sorted table, -1 for those that aren't in it."""
    unique, where = np.unique(tokens, return_inverse=True)
    if not len(table):
        return np.full(len(tokens), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, unique), len(table) - 1)
    return np.where(table[at] == unique, at, -1)[where]


def read(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of each whole text, hashed: (_id, _part, _tokens).

    _part is 1 for rows that are learned from, 2 for those of them that are held out for the weights, 0 for others.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    part = F.when(F.coalesce(train, F.lit(False)), F.when(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(HELD)) == 0, 2).otherwise(1)).otherwise(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in in_pieces(batches, "_text", 4 << 20):
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([reader.read(r) for r in raws], pa.binary())], ["_id", "_part", "_tokens"])

    rows = docs.select(docs[id_col].alias("_id"), part.cast("int").alias("_part"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(tidy(run), f"_id {kind}, _part int, _tokens binary")


@dataclass
class Numbers:
    """What tasks need of a model; bounded by the vocabulary and PAIRS."""

    #: training tokens and distinct words among them
    tokens: int
    distinct: int
    #: words of the vocabulary with their training counts; a word's number is its place here, that of rare ones comes next
    hashes: np.ndarray
    counts: np.ndarray
    #: training counts of all numbers as words, and as contexts (the start of a text last)
    words: np.ndarray
    contexts: np.ndarray
    #: share of the training tokens that is not held out
    kept: float
    #: rare words: weight of relative frequency, their tokens and their number
    own: float
    rare_tokens: int
    rare_words: int
    #: BUCKETS x 3
    weights: np.ndarray
    #: bits of a bucket's number
    bits: int
    #: mixed numbers of frequent bigrams, sorted, and their training counts
    pairs: np.ndarray
    pair_counts: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def log10_base(self, count):
        return np.log10((count + 1.0) / (self.tokens + self.distinct + 1.0))

    def log10_rare(self, count):
        """Logarithm of a word's probability among the rare ones."""
        return np.log10(self.own * count / max(1, self.rare_tokens) + (1 - self.own) / (self.rare_words + 1.0))

    def estimates(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Bigram, unigram and uniform estimates; the first is 0 for contexts that never occur."""
        total = self.words.sum()
        unigram = self.words[word] / total if total else np.full(len(word), 1 / len(self.words))
        return count / np.maximum(self.contexts[context], 1), unigram, 1 / len(self.words)

    def log10_bigram(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Logarithm of the mixture; count: how often the word follows the context in training."""
        n = self.contexts[context]
        w = self.weights[_bucket(n * self.kept)]
        bigram, unigram, uniform = self.estimates(context, word, count)
        return np.log10(w[:, 0] * bigram + (w[:, 1] + np.where(n > 0, 0, w[:, 0])) * unigram + w[:, 2] * uniform)

    def mixed(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mixed numbers of the bigrams that end at each token."""
        context = np.empty(len(ids), dtype=np.uint64)
        context[1:] = ids[:-1]
        context[np.cumsum(sizes) - sizes] = self.rare + 1
        return (context * np.uint64(self.rare + 1) + ids.astype(np.uint64)) * np.uint64(_ODD) & _MASK

    def of_pair(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of mixed numbers."""
        plain = mixed * np.uint64(_BACK) & _MASK
        return (plain // np.uint64(self.rare + 1)).astype(np.int64), (plain % np.uint64(self.rare + 1)).astype(np.int64)


@dataclass
class Model:
    numbers: Numbers
    #: (w, n): training counts of all words that are not of the vocabulary
    rare: DataFrame
    #: bigrams by bucket
    table: DataFrame
    #: the documents that were learned from and beside, as numbers
    coded: DataFrame


def packed(x: np.ndarray) -> bytes:
    """Numbers, the bytes of each place together, compressed."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return pa.compress(flat, codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, "<u8"), dtype=np.uint64)


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted mixed numbers."""
    bucket = (keys >> np.uint64(BITS - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(1, int)
    for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
        yield int(bucket[a]), a, z


def _bin(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(F.floor(F.log2(n) * 8) + 1000)


def _threshold(bins: list, room: int) -> int:
    """The least count such that at most `room` have it or more; bins: (how many, least count) by falling count."""
    least = 1 << 62
    for k, n in sorted(bins, key=lambda r: -r[1]):
        if k > room:
            break
        least, room = n, room - k
    return least


def _counted(rows: DataFrame) -> DataFrame:
    """(w, kept, held): counts of all words of the rows that are learned from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate([h for h, _ in held])
            part = np.concatenate([p for _, p in held])
            unique, where = np.unique(key, return_inverse=True)
            n = [np.bincount(where[part == k], minlength=len(unique)).astype(np.int64) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(unique), *map(pa.array, n)], ["w", "kept", "held"])

        for batch in in_pieces(batches, "_tokens"):
            flat, sizes = _flat(batch.column(1))
            held.append((flat, np.repeat(batch.column(0).to_numpy(), sizes)))
            size += len(flat)
            if size > CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    found = rows.filter("_part > 0").select("_part", "_tokens").mapInArrow(tidy(count), "w long, kept long, held long")
    return found.groupBy("w").agg(F.sum("kept").alias("kept"), F.sum("held").alias("held"))


def code(tokens: DataFrame, hashes: Broadcast) -> DataFrame:
    """Rows of read() with words as numbers of the vocabulary: (_n, _id, _part, _ids, _rare), written. _rare: hashes of rare words."""
    kind = tokens.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(hashes.value)
        table = hashes.value[by_hash]
        for batch in in_pieces(batches, "_tokens"):
            flat, sizes = _flat(batch.column(2))
            places = _places(table, flat)
            ids = np.where(places >= 0, by_hash[places], len(table)).astype("<u4")
            ends = np.cumsum(sizes)
            out, rare = [], []
            for a, z in zip((ends - sizes).tolist(), ends.tolist()):
                out.append(ids[a:z].tobytes())
                rare.append(flat[a:z][ids[a:z] == len(table)].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), pa.array(rare, pa.binary())], ["_id", "_part", "_ids", "_rare"])

    rows = tokens.mapInArrow(tidy(run), f"_id {kind}, _part int, _ids binary, _rare binary")
    return stage(rows.withColumn("_n", F.monotonically_increasing_id()), "coded")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype="<u4"), np.array([len(b) // 4 for b in blobs], dtype=np.int64)


def _bigrams(coded: DataFrame, shared: Broadcast) -> DataFrame:
    """(bucket, n, keys, kept, held, other): the distinct bigrams of all documents and their counts in each part."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, parts = (np.concatenate(x) for x in zip(*held))
            rows: list[tuple] = []
            for part in (0, 1, 2):
                unique, n = np.unique(keys[parts == part], return_counts=True)
                n = n.astype("<u4")
                rows += [(bucket, part, z - a, packed_keys(unique[a:z]), packed(n[a:z])) for bucket, a, z in _by_bucket(unique, numbers.bits)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "part", "n", "keys", "counts"])

        for batch in in_pieces(batches, "_ids"):
            ids, sizes = _ids(batch.column(1))
            held.append((numbers.mixed(ids, sizes), np.repeat(batch.column(0).to_numpy(), sizes)))
            size += len(ids)
            if size > CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([unpacked_keys(x, n) for x, n in zip(table.column("keys").to_pylist(), sizes)])
        counts = np.concatenate([unpacked(x, n, "<u4") for x, n in zip(table.column("counts").to_pylist(), sizes)])
        part = np.repeat(table.column("part").to_numpy(), sizes)
        unique, where = np.unique(keys, return_inverse=True)
        n = [packed(np.bincount(where[part == k], weights=counts[part == k], minlength=len(unique)).astype("<u8")) for k in (1, 2, 0)]
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "n": pa.array([len(unique)], pa.int64()), "keys": pa.array([packed_keys(unique)], pa.binary())} | {c: pa.array([x], pa.binary()) for c, x in zip(("kept", "held", "other"), n)})

    found = coded.select("_part", "_ids").mapInArrow(tidy(runs), "bucket long, part int, n long, keys binary, counts binary")
    return stage(found.groupBy("bucket").applyInArrow(merge, "bucket long, n long, keys binary, kept binary, held binary, other binary"), "bigrams")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and counts (kept, held, other) of rows (n, keys, kept, held, other)."""
    for batch in batches:
        for n, keys, *counts in zip(*(batch.column(k).to_pylist() for k in range(5))):
            yield unpacked_keys(keys, n), *(unpacked(x, n, "<u8").astype(np.int64) for x in counts)


def learn(tokens: DataFrame, words: int = WORDS, pairs: int = PAIRS) -> Model:
    """The model of the rows of read() that are learned from."""
    if not 0 <= words < 1 << BITS // 2:
        raise ValueError("too many words for the numbers of bigrams")
    spark = tokens.sparkSession
    end = int(np.frombuffer(xxhash.xxh64_digest(END), "<i8")[0])
    table = stage(_counted(tokens).withColumn("n", F.col("kept") + F.col("held")), "words")
    # how many words have a count: what the threshold is taken from
    bins = [(r.k, r.n) for r in table.groupBy(_bin(F.col("n"))).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()]
    totals = table.agg(F.sum("n"), F.sum("kept"), F.count("*")).first()
    n_tokens, n_kept, distinct = (int(x or 0) for x in totals)
    least = _threshold(bins, words)
    frequent = table.filter((F.col("n") >= least) | (F.col("w") == end)).select("w", "kept", "held").toArrow()  # `words` rows and the end at most
    hashes, kept, held = (np.asarray(frequent.column(c).to_numpy(), dtype=np.int64) for c in ("w", "kept", "held"))
    if end not in hashes:
        hashes, kept, held = np.r_[hashes, end], np.r_[kept, 0], np.r_[held, 0]
    order = np.lexsort((hashes, -(kept + held)))  # small numbers for frequent words: they compress
    hashes, kept, counts = hashes[order], kept[order], (kept + held)[order]
    rare = table.filter((F.col("n") < least) & (F.col("w") != end))
    # rare words by bins of counts: their shares against a uniform one
    fine = rare.groupBy(_bin(F.col("kept"))).agg(F.sum("held").alias("held"), F.avg("kept").alias("kept"), F.count("*").alias("k"), F.sum("kept").alias("all")).collect()
    own = fit_shared([(r.held or 0, r.kept) for r in fine], sum(r["all"] for r in fine), sum(r.k for r in fine if r.kept))

    def as_contexts(n: np.ndarray) -> np.ndarray:
        """Every word but the end is followed by one, and every text starts."""
        ends = n[np.flatnonzero(hashes == end)]
        return np.r_[np.where(np.r_[hashes, end + 1] == end, 0, n), ends]

    rare_tokens = n_tokens - int(counts.sum())
    own = own if rare_tokens else 0.0
    by_word = np.r_[counts, rare_tokens].astype(np.float64)
    kept_by_word = np.r_[kept, n_kept - kept.sum()].astype(np.float64)
    bits = max(4, int(np.ceil(np.log2(max(1, n_tokens) / BUCKET))))
    none = np.zeros(0, dtype=np.uint64)
    numbers = Numbers(n_tokens, distinct, hashes, counts, by_word, as_contexts(by_word), n_kept / max(1, n_tokens), own, rare_tokens, distinct - int((counts > 0).sum()), np.tile([0.3, 0.6, 0.1], (BUCKETS, 1)), bits, none, none.astype(np.int64))
    coded = code(tokens, spark.sparkContext.broadcast(hashes))
    kept_numbers = Numbers(**vars(numbers) | {"words": kept_by_word, "contexts": as_contexts(kept_by_word)})
    shared = spark.sparkContext.broadcast(kept_numbers)
    bigrams = _bigrams(coded, shared)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bins of counts over all documents, and held-out counts by bucket of the context and quarter powers of two of the estimates."""
        numbers = shared.value
        for keys, kept, held, other in _buckets(batches):
            n = kept + held + other
            place = np.where(n <= EXACT, n, np.floor(np.log2(np.maximum(n, 1)) * 8) + 1000).astype(np.int64)
            unique, where = np.unique(place, return_inverse=True)
            lowest = np.full(len(unique), 1 << 62)
            np.minimum.at(lowest, where, n)
            yield row(np.full(len(unique), -1), unique, np.bincount(where), lowest, np.zeros(len(unique)))
            some = held > 0
            context, word = numbers.of_pair(keys[some])
            bigram, unigram, _ = numbers.estimates(context, word, kept[some])
            cell = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * 4) + 4000, 0).astype(np.int64)
            unique, where = np.unique(np.stack([_bucket(numbers.contexts[context]), cell(bigram) << 20 | cell(unigram)]), axis=1, return_inverse=True)
            sums = [np.bincount(where.ravel(), weights=held[some] * x, minlength=unique.shape[1]) for x in (1, bigram, unigram)]
            yield row(unique[0], unique[1], sums[0].astype(np.int64), *sums[1:])

    def row(bucket, cell, n, x, y) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=t.to_pandas_dtype())) for c, t in zip((bucket, cell, n, x, y), kinds)], ["bucket", "cell", "n", "x", "y"])

    # bounded by the numbers of bins: some hundreds, and BUCKETS times the squares of quarter powers that occur
    cells = bigrams.select("n", "keys", "kept", "held", "other").mapInArrow(tidy(look), "bucket long, cell long, n long, x double, y double")
    cells = cells.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("x").alias("least")).toArrow()
    bucket, n, x, y, lowest = (cells.column(c).to_numpy() for c in ("bucket", "n", "x", "y", "least"))
    held_out = bucket >= 0
    weights = fit_weights(bucket[held_out], n[held_out], x[held_out] / n[held_out], y[held_out] / n[held_out], 1 / len(by_word))
    bound = _threshold(list(zip(n[~held_out].tolist(), lowest[~held_out].tolist())), pairs)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, kept, held, other in _buckets(batches):
            some = kept + held + other >= bound
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array((kept + held)[some])], ["key", "n"])

    top = bigrams.select("n", "keys", "kept", "held", "other").mapInArrow(tidy(take), "key long, n long").toArrow()  # `pairs` rows at most
    keys, n = top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    numbers = Numbers(**vars(numbers) | {"weights": weights, "pairs": keys[order], "pair_counts": n[order]})
    return Model(numbers, rare.select("w", "n"), bigrams, coded)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(count, 0.5)) + 1).astype(np.int64))


def fit_weights(bucket: np.ndarray, held: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """BUCKETS x 3 weights of bigram, unigram and uniform estimates, by expectation-maximisation on held-out counts."""
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        own = bucket == b
        if not own.any():
            continue
        n, p = held[own], np.stack([bigram[own], unigram[own], np.full(own.sum(), uniform)])
        w = out[b]
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            new = (share * n).sum(axis=1) / n.sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        w = np.maximum(w, 1e-6)
        out[b] = w / w.sum()
    return out


def fit_shared(bins: list[tuple[float, float]], mass: float, words: int, rounds: int = 200) -> float:
    """Weight of relative frequency against a uniform share for words of the shared class; bins: (held-out tokens, count)."""
    total = sum(h for h, _ in bins)
    if not total or not mass:
        return 0.5
    w = 0.5
    for _ in range(rounds):
        gain = 0.0
        for h, c in bins:
            a, b = w * c / mass, (1 - w) / (words + 1.0)
            gain += h * a / (a + b)
        new = gain / total
        if abs(new - w) < 1e-9:
            break
        w = new
    return min(max(w, 1e-6), 1 - 1e-6)


def score(coded: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of code(), model.coded among them."""
    kind = coded.schema["_id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(model.numbers)

    def frequent(m: Numbers, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, the document of each, the distinct bigrams, which one ends at each word, and their places among the frequent ones (-1: not there)."""
        ids, sizes = _ids(column)
        keys, where = np.unique(m.mixed(ids, sizes), return_inverse=True)
        at = np.minimum(np.searchsorted(m.pairs, keys), max(0, len(m.pairs) - 1))
        place = np.where(m.pairs[at] == keys, at, -1) if len(m.pairs) else np.full(len(keys), -1)
        return ids, np.repeat(np.arange(len(sizes)), sizes), keys, where, place

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What needs no other place: numbers of words, the base of known words, the score of frequent bigrams."""
        m = shared.value
        base = m.log10_base(m.counts.astype(np.float64))
        for batch in in_pieces(batches, "_ids"):
            ids, doc, keys, where, place = frequent(m, batch.column(2))
            add = lambda v, own: np.bincount(doc[own], weights=v, minlength=batch.num_rows).astype(np.float64)
            value = np.zeros(len(keys))
            found = place >= 0
            value[found] = m.log10_bigram(*m.of_pair(keys[found]), m.pair_counts[place[found]])
            listed = ids < m.rare
            known = listed.copy()
            known[listed] = m.counts[ids[listed]] > 0
            sums = [np.bincount(doc, minlength=batch.num_rows), np.bincount(doc[known], minlength=batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x.astype(np.int64)) for x in sums), pa.array(add(base[ids[listed]], listed)), pa.array(add(value[where], slice(None)))], ["_n", "_id", "n_tokens", "n_known", "base", "score"])

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of other bigrams, by bucket: sorted numbers, and the documents in which they are."""
        m = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, docs = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            rows = []
            for bucket, a, z in _by_bucket(keys, m.bits):
                low = int(docs[a:z].min())
                rows.append((bucket, z - a, packed_keys(keys[a:z]), low, packed((docs[a:z] - low).astype("<u8"))))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["bucket", "n", "keys", "low", "docs"])

        for batch in in_pieces(batches, "_ids"):
            _, doc, keys, where, place = frequent(m, batch.column(1))
            other = np.flatnonzero(place[where] < 0)
            held.append((keys[where[other]], batch.column(0).to_numpy()[doc[other]]))
            size += len(other)
            if size > CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Sums of logarithms for each document, of one bucket."""
        m = shared.value
        docs, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        lists = [(unpacked_keys(k, n), kept + held) for n, k, kept, held in ((n, k, unpacked(a, n, "<u8").astype(np.int64), unpacked(b, n, "<u8").astype(np.int64)) for n, k, a, b in zip(*(known.column(c).to_pylist() for c in ("n", "keys", "kept", "held"))))]
        table, counts = lists[0] if lists else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        for n, raw, low, where in zip(*(asked.column(c).to_pylist() for c in ("n", "keys", "low", "docs"))):
            keys = unpacked_keys(raw, n)
            at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
            count = np.where(table[at] == keys, counts[at], 0) if len(table) else np.zeros(n, dtype=np.int64)
            unique, of = np.unique(unpacked(where, n, "<u8").astype(np.int64) + low, return_inverse=True)
            docs.append(unique)
            sums.append(np.bincount(of, weights=m.log10_bigram(*m.of_pair(keys), count)))
        unique, of = np.unique(np.concatenate(docs), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(sums), minlength=len(unique))
        group = unique >> GROUP
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(unique) else np.zeros(1, int)
        rows = [(int(group[a]), packed((unique[a:z] & (1 << GROUP) - 1).astype("<u2")), packed(total[a:z]), z - a) for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("g", "docs", "sums", "n"), list(zip(*rows)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))})

    def total(table: pa.Table) -> pa.Table:
        """The sums of a group of documents over all buckets."""
        sums, seen = np.zeros(1 << GROUP), np.zeros(1 << GROUP, dtype=bool)
        for docs, part, n in zip(*(table.column(c).to_pylist() for c in ("docs", "sums", "n"))):
            at = unpacked(docs, n, "<u2")
            sums[at] += unpacked(part, n, "<f8")
            seen[at] = True
        at = np.flatnonzero(seen)
        return pa.table({"n2": pa.array((table.column("g")[0].as_py() << GROUP) + at, pa.int64()), "score2": pa.array(sums[at], pa.float64())})

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_rare"):
            flat, sizes = _flat(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.lexsort((flat, doc))
            flat, doc = flat[order], doc[order]
            first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first])), pa.array(flat[first]), pa.array(np.diff(np.r_[first, len(flat)]).astype(np.int64))], ["n3", "w", "times"])

    m = model.numbers
    whole = coded.select("_n", "_id", "_ids").mapInArrow(tidy(here), f"_n long, _id {kind}, n_tokens long, n_known long, base double, score double")
    asked = coded.select("_n", "_ids").mapInArrow(tidy(away), "bucket long, n long, keys binary, low long, docs binary")
    sums = asked.groupBy("bucket").cogroup(model.table.select("bucket", "n", "keys", "kept", "held").groupBy("bucket")).applyInArrow(meet, "g long, docs binary, sums binary, n long")
    sums = sums.groupBy("g").applyInArrow(total, "n2 long, score2 double")
    c = F.coalesce("n", F.lit(0)).cast("double")
    base = F.log10((c + 1.0) / (m.tokens + m.distinct + 1.0))
    own = F.log10(F.lit(m.own) * c / float(max(1, m.rare_tokens)) + (1 - m.own) / (m.rare_words + 1.0))
    met = coded.filter(F.length("_rare") > 0).select("_n", "_rare").mapInArrow(tidy(rare), "n3 long, w long, times long").join(model.rare, "w", "left")
    met = met.groupBy("n3").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known3"), F.sum(F.col("times") * base).alias("base3"), F.sum(F.col("times") * own).alias("score3"))
    out = whole.join(sums, whole["_n"] == sums.n2, "left").join(met, F.col("_n") == met.n3, "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known3", F.lit(0))).cast("long").alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base3")).alias("base_score"),
        (F.col("score") + zero("score2") + zero("score3")).alias("score"),
    )
