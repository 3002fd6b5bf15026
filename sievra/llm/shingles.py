"""Near-duplicates by the exact Jaccard similarity of the sets of word shingles.

A signature has a byte of the least hash under each of some permutations; a byte is equal in two signatures with the
probability of the sets' similarity (and 1 / 256 of the rest). Signatures meet in the inverted index on byte positions
of simhash, and pairs with fewer equal bytes than alike sets have are left. The others are candidates. Candidates hang
together in groups; the sets of a group come to one place, where every candidate pair that links haven't yet joined is
decided: links are pairs with |A and B| >= similarity * |A or B|, nothing else. Only links that join something new
leave a group, and groups over CHUNK classes are met as pairs of chunks, so that no rows are made for pairs.

Texts with equal sets are one class before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import in_pieces, stage, text_or_empty, tidy
from .components import components
from .simhash import HELD, _forest, _mixed, disjoint_sets, posted, shingle_hashes, whole_lists

#: Bytes of a class's name, which stand before its signature.
NAME = 16
#: Lists over this many rows are spread over instead of met pair by pair; the components are the same.
LONG = 64
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def name_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signature(hashes: np.ndarray, slots: int = 64) -> bytes:
    """A byte of the least hash under each of `slots` permutations."""
    if not len(hashes):
        return bytes(slots)
    least = np.full(slots, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[k : k + 2048, None] * _TIMES[:slots] + _PLUS[:slots]).min(axis=0), out=least)
    return (_mixed(least, 1) >> np.uint64(56)).astype(np.uint8).tobytes()


def sets_for(similarity: float, slots: int) -> list[tuple[int, ...]]:
    """Two divisions of the positions, into the largest sets (four at most) in which pairs this alike surely meet."""
    size = next((k for k in (4, 3, 2) if (1 - similarity**k) ** (2 * (slots // k)) < 1e-5), 1)
    return disjoint_sets(slots, size, 2)


def least_matches(similarity: float, slots: int, lost: float = 1e-6) -> int:
    """The most equal bytes that pairs this alike have at least, but for a share `lost` of them."""
    p, total = similarity + (1 - similarity) / 256, 0.0
    for m in range(slots + 1):
        total += math.comb(slots, m) * p**m * (1 - p) ** (slots - m)
        if total > lost:
            return m
    return slots


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join n rows into the components of a symmetric relation; near(x, rest) marks those of `rest` that it
    holds for. A row that is reached is compared with rows that aren't yet only, so a dense component takes few comparisons."""
    rest, left, right = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = near(x, rest)
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                left.append(np.full(len(new), x))
                right.append(new)
                todo += new.tolist()
    return np.concatenate(left), np.concatenate(right)


def _met(keys: np.ndarray, rows: np.ndarray, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of the pairs inside runs of equal keys that have `matches` equal bytes, and how many they have."""
    at, step = np.flatnonzero(keys[:-1] == keys[1:]), 1
    while len(at):
        for k in range(0, len(at), 1 << 15):
            i = at[k : k + (1 << 15)]
            tally = (rows[i] == rows[i + step]).sum(axis=1)
            enough = tally >= matches
            yield i[enough], i[enough] + step, tally[enough]
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]


def candidates(fps: DataFrame, sets: Sequence[Sequence[int]], matches: int, slots: int) -> DataFrame:
    """(a, b): names of classes (fp: name and signature) with the same components as all candidates."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, blobs in whole_lists(batches):
            rows = np.ascontiguousarray(np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, NAME + slots)[:, NAME:])
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            long_ = np.diff(cuts) > LONG
            short = np.flatnonzero(np.repeat(~long_, np.diff(cuts)))
            held, n = [(np.empty(0, np.int64),) * 2], 0
            for start, stop in zip(cuts[:-1][long_].tolist(), cuts[1:][long_].tolist()):
                own = rows[start:stop]
                i, j = spread(len(own), lambda x, rest: (own[rest] == own[x]).sum(axis=1) >= matches)  # noqa: B023
                held.append((i + start, j + start))
            for i, j, _ in _met(keys[short], rows[short], matches):
                held.append((short[i], short[j]))
                n += len(i)
                if n > HELD:
                    held = [_forest(*(np.concatenate(x) for x in zip(*held)))]
                    n = len(held[0][0])
            a, b = _forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array([blobs[i][:NAME] for i in x.tolist()], pa.binary()) for x in (a, b)], ["a", "b"])

    return posted(fps, [[NAME + p for p in s] for s in sets], NAME + slots).mapInArrow(tidy(meet), "a binary, b binary")


def _decided(rows: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that give the components of all of them. Sides 1 and 2 meet each other only."""
    size = np.array([len(x) for x in sets])
    at = np.r_[0, np.cumsum(size)].tolist()
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    held = np.zeros(len(ids), dtype=bool)  # by number of a hash: whether x has it

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        able = ((side[rest] == 0) | (side[rest] != side[x])) & (np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9)
        able[able] = (rows[rest[able]] == rows[x]).sum(axis=1) >= matches
        some = rest[able]
        if len(some):
            held[ids[at[x] : at[x + 1]]] = True
            both = np.array([np.count_nonzero(held[ids[at[y] : at[y + 1]]]) for y in some.tolist()])
            held[ids[at[x] : at[x + 1]]] = False
            able[able] = both >= similarity * (size[x] + size[some] - both) - 1e-9
        return able

    return spread(len(rows), near)


def alike(groups: DataFrame, similarity: float, matches: int, slots: int) -> DataFrame:
    """(a, b): links between the classes of each group (columns root, full, hashes)."""
    end = NAME + slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, blobs in whole_lists(batches):
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
            for start, stop in zip(cuts, cuts[1:]):
                own = blobs[start:stop]
                rows = np.frombuffer(b"".join(x[NAME:end] for x in own), dtype=np.uint8).reshape(-1, slots)
                links = _decided(rows, np.array([x[end] for x in own]), [np.frombuffer(x[end + 1 :], dtype="<u8") for x in own], similarity, matches)
                if len(links[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([own[i][:NAME] for i in x.tolist()], pa.binary()) for x in links], ["a", "b"])

    side = lambda k: F.lit(bytearray([k]))
    rows = groups.select(F.xxhash64("root").alias("key"), "full", "hashes")
    large = stage(rows.groupBy("key").count().filter(F.col("count") > simhash.CHUNK).select("key", F.ceil(F.col("count") / simhash.CHUNK).cast("int").alias("chunks")), "lists")
    dealt = rows.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("full", F.lit(7)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    mark = F.when(F.col("own") == F.col("other"), side(0)).when(F.col("own") < F.col("other"), side(1)).otherwise(side(2))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.concat("full", mark, "hashes").alias("fp"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a binary, b binary")


def _read(docs: DataFrame, width: int, slots: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark of the text, full: name and signature)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text"):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([name_of(h) + signature(h, slots) for h in sets], pa.binary())], ["_id", "mark", "full"])

    text = text_or_empty(text_col)
    return docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("mark"), text.alias("_text")).mapInArrow(tidy(run), f"_id {kind}, mark long, full binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(name, hashes) of the classes wanted (name, mark), from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text"):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            same = [name_of(h) == n for h, n in zip(sets, batch.column(0).to_pylist())]  # marks of texts may collide
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], ["name", "hashes"]).filter(pa.array(same, pa.bool_()))

    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("_text")).join(wanted, "mark", "left_semi").dropDuplicates(["mark", "_text"])
    return texts.join(wanted, "mark").select("name", "_text").mapInArrow(tidy(run), "name binary, hashes binary")


def linked(docs: DataFrame, width: int, similarity: float, slots: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, fp: name of the text's class), (fp, least id) and the components (vertex, root) of the links between classes."""
    sets, matches = sets_for(similarity, slots), least_matches(similarity, slots)
    read = stage(_read(docs, width, slots, id_col, text_col), "fingerprints")
    name = F.substring("full", 1, NAME)
    classes = stage(read.groupBy("full").agg(F.min("_id").alias("least"), F.min("mark").alias("mark")).withColumn("fp", name), "classes")
    groups = components(candidates(classes.select(F.col("full").alias("fp")), sets, matches, slots))
    touched = stage(classes.join(groups, classes.fp == groups.vertex).select("fp", "full", "mark", "root"), "touched")
    known = _sets(docs, touched.select(F.col("fp").alias("name"), "mark"), width, text_col)
    known = stage(touched.join(known, touched.fp == known.name).select("root", "full", "hashes"), "sets")
    found = components(alike(known, similarity, matches, slots))
    return read.select(F.col("_id").alias(id_col), name.alias("fp")), classes.select("fp", "least"), found
