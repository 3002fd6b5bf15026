"""SimHash near-duplicates through an inverted index on the bytes of fingerprints.

A fingerprint has 64 bits, or a multiple, from the hashes of word shingles. Two fingerprints that differ in at most
d bits agree in all but d of their bytes. The index has a posting list for each value of chosen sets of byte
positions; the sets are such that any pair with the guaranteed number of equal bytes meets in a list. In a list the
equal positional bytes of each pair are tallied, pairs with enough of them are verified bit by bit.
Only links that join something new leave a list, so a list of n close fingerprints gives at most n - 1 rows.
Lists over CHUNK fingerprints are cut into chunks and every pair of chunks is a list of its own.

Texts: null counts as empty; a text without words has fingerprint zero, which links like any other.
Equal fingerprints are one class before anything is compared. Null ids keep their rows and never name a component.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, stage, text_or_empty, tidy
from .components import components

CHUNK = 1024
#: Links held in memory before they are reduced to a forest.
HELD = 1 << 20


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """The hashes of the text's word shingles in order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        raw = digest(line, seed) if words else b""
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]]
        n = len(words) - width + 1
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())])
    return np.frombuffer(raw, dtype=">u8")


def fingerprint(text: str, width: int = 4, words64: int = 1, seed: int = 42) -> bytes:
    """8 * words64 bytes; a bit is 1 if it is set in over half the shingles' hashes, repeats included."""
    hashes = shingle_hashes(text, width, seed)
    n = len(hashes)
    if not n:
        return bytes(8 * words64)
    counts = np.zeros(64 * words64, dtype=np.int64)
    block = max(1, (1 << 17) // words64)
    for k in range(0, n, block):
        h = hashes[k : k + block].astype(np.uint64)
        parts = [h] + [_mixed(h, i) for i in range(1, words64)]
        matrix = np.stack(parts, axis=1).astype(">u8").view(np.uint8)
        counts += np.unpackbits(matrix, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    z = h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 4, words64: int = 1, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, fp binary) for each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text"):
            fps = [fingerprint(t, width, words64, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["_id", "fp"])

    return docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, fp binary").withColumnRenamed("_id", id_col)


def covering_triples(n: int = 8) -> list[tuple[int, int, int]]:
    """Triples of n positions such that any four positions contain one: three groups in a ring, triples inside a group or two of one group and one of the next."""
    groups = [list(range(g, n, 3)) for g in range(3)]
    out = []
    for g, own in enumerate(groups):
        after = groups[(g + 1) % 3]
        out += [(a, b, c) for i, a in enumerate(own) for j, b in enumerate(own[i + 1 :], i + 1) for c in [*own[j + 1 :], *after]]
    return out


def disjoint_sets(n: int, size: int, rounds: int = 1, seed: int = 1) -> list[tuple[int, ...]]:
    """`rounds` random divisions of n positions into sets of `size`."""
    rng, out = random.Random(seed), []
    for _ in range(rounds):
        order = rng.sample(range(n), n)
        out += [tuple(order[k : k + size]) for k in range(0, n - size + 1, size)]
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, smallest vertex of its component) with the same components as a-b."""
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def link_lists(keys: np.ndarray, fps: np.ndarray, max_bits: int, min_matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs inside runs of equal keys, as a forest. fps: rows of bytes."""
    left, right, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    words = np.ascontiguousarray(fps).view(np.uint64)
    at = np.flatnonzero(keys[:-1] == keys[1:])
    step = 1
    while len(at):
        for k in range(0, len(at), 1 << 15):
            i = at[k : k + (1 << 15)]
            x = words[i] ^ words[i + step]
            tally = (x.view(np.uint8).reshape(len(i), -1) == 0).sum(axis=1)
            enough = tally >= min_matches
            i, x = i[enough], x[enough]
            i = i[np.bitwise_count(x).sum(axis=1) <= max_bits]
            left.append(i)
            right.append(i + step)
            held += len(i)
        if held > HELD:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], len(a)
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
    return _forest(np.concatenate(left), np.concatenate(right))


def posted(fps: DataFrame, sets: Sequence[Sequence[int]], size: int) -> DataFrame:
    """(key, fp): a row for each set of byte positions of each fingerprint; equal keys follow each other in a partition.

    Lists over CHUNK rows come as a list for every pair of their chunks.
    """
    positions = [list(s) for s in sets]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                col = batch.column(0).slice(k, 4096)
                raw = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, size)
                for s, where in enumerate(positions):
                    key = np.full(len(raw), s, dtype=np.int64)
                    for p in where:
                        key = key << 8 | raw[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(key), col], ["key", "fp"])

    postings = fps.select("fp").mapInArrow(tidy(post), "key long, fp binary")
    long_lists = stage(postings.groupBy("key").count().filter(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "lists")
    if long_lists.head(1):
        # rows meet their list's number of chunks in a join on the key that adaptive execution can split
        tagged = postings.join(long_lists, "key", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        cold = tagged.filter("chunks is null").select("key", "fp")
        hot = tagged.filter("chunks is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        hot = hot.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        postings = cold.unionByName(hot)
    return postings.repartition("key").sortWithinPartitions("key")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Keys and fingerprints of posted rows, cut between lists."""
    keys, blobs = np.empty(0, np.int64), []
    for batch in batches:
        keys, blobs = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)], blobs + batch.column(1).to_pylist()
        if len(keys) and keys[0] != keys[-1] and len(keys) >= 4096:
            last = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            yield keys[:last], blobs[:last]
            keys, blobs = keys[last:], blobs[last:]
    if len(keys) > 1:
        yield keys, blobs


def links(fps: DataFrame, sets: Sequence[Sequence[int]], max_bits: int, min_matches: int, size: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, `size` bytes each) that give the components of all pairs
    which share a set of byte positions, min_matches bytes in all, and differ in at most max_bits bits."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, blobs in whole_lists(batches):
            rows = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, size)
            a, b = link_lists(keys, rows, max_bits, min_matches)
            yield pa.RecordBatch.from_arrays([pa.array([blobs[i] for i in a.tolist()], pa.binary()), pa.array([blobs[i] for i in b.tolist()], pa.binary())], ["a", "b"])

    return posted(fps, sets, size).mapInArrow(tidy(meet), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, words64: int = 8, max_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component): component is the smallest id that links lead to, the document's own included.

    With 64 bits and max_bits given, candidates are guaranteed: all pairs within max_bits (at most 4) are found.
    Without max_bits, links are pairs whose sets of shingles are `similarity` alike by count; see shingles.
    """
    if max_bits is None:
        from . import shingles

        fps, classes, found = shingles.linked(docs, width, similarity, 8 * words64, id_col, text_col)
    elif words64 == 1 and max_bits <= 4:
        fps = stage(fingerprints(docs, width, words64, id_col, text_col), "fingerprints")
        classes = stage(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
        found = components(links(classes, covering_triples(), max_bits, 8 - max_bits, 8))
    else:
        raise ValueError("bits at most can be given for 64 bits, up to 4")
    rooted = classes.join(found, classes.fp == found.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = stage(rooted.groupBy("root").agg(F.min("least").alias("component")), "names")  # a plain side, so that large components can be split
    named = rooted.join(names, "root").select(F.col("fp").alias("_fp"), "component")
    return fps.join(named, fps.fp == named["_fp"], "left").select(id_col, "fp", "component")
