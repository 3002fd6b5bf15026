"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in any document or the same one.
Sorting all suffixes of a corpus in one place can't be done, so the places that can matter are found first:

1. Anchors. Of every `length` bytes, the q-gram with the least hash is an anchor (the leftmost of equal ones). Equal
   strings have equal anchors at equal offsets, so only strings round anchors that occur twice can be repeated.
   Around an anchor lies its context: all bytes of the strings of `length` bytes that it is in.
2. Contexts that occur twice as a whole are repeated as a whole; copies collapse to counts before anything moves.
3. One example of each remaining context of an anchor goes to the anchor's partition. There the suffixes of the
   contexts are sorted to depth `length` by bucket-pointer refinement: buckets by 8-gram first, then each bucket is
   split by the bucket numbers of the suffixes 8, 16, 32, ... bytes further on, which the round before has updated;
   buckets of one suffix drop out. Suffixes still in one bucket at the full depth are equal strings.
   An anchor with more than HOT different contexts isn't sorted in one task. Its strings are refined in rounds over
   the whole cluster: ranges of strings are halved, a range whose common part occurs once is dropped, of a range
   whose whole occurs twice one example goes on, and each round is an aggregation by hash.

Texts: null counts as empty; texts shorter than `length` keep every byte, for they can't hold such a string.
Rows repeated as a whole are documents of their own and so repeat each other. Equal strings are told by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, in_pieces, stage, text_or_empty, tidy

HOT = 2000
STEP = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grow(n: int) -> None:
    while len(_POWERS[0]) < n:
        m = len(_POWERS[0])
        _POWERS[0] = np.concatenate([_POWERS[0], _POWERS[0] * np.uint64(pow(_BASE, m, 1 << 64))])
        _POWERS[1] = np.concatenate([_POWERS[1], _POWERS[1] * np.uint64(pow(_INVERSE, m, 1 << 64))])


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of bytes."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _POWERS[0][: len(data)], out=sums[1:])
    h = (sums[q:] - sums[:-q]) * _POWERS[1][: len(data) - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a document, and their hashes."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    window = length - q + 1
    places, hashes = [], []
    for start in range(0, len(data) - length + 1, STEP):
        part = data[start : start + STEP + length - 1]
        h = gram_hashes(part, q)
        low = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < window:
            rest = window - span
            low = np.minimum(low[:-rest], low[rest:])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.unique(at)
        places.append(at + start)
        hashes.append(h[at])
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def refine(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data sorted to depth `length` (8 at least) by bucket-pointer refinement.

    ends[i] is where the text that position i lies in ends; suffixes shorter than the depth are left out.
    Returns the positions that share a bucket with others at the full depth, and their buckets.
    """
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams, wide = data.astype(np.uint64), 1
    while wide < 8:
        grams = grams[:-wide] << np.uint64(8 * wide) | grams[wide:]
        wide *= 2
    bucket = np.full(n, -1, dtype=np.int64)  # the bucket pointer of each suffix; -1: alone or too short
    position = np.arange(len(grams))
    active = position[position + 8 <= ends[: len(grams)]]
    bucket[active], active = _split(grams[active], active)
    depth = 8
    while depth < length and len(active):
        ahead = min(depth, length - depth)
        active = active[active + depth + ahead <= ends[active]]
        later = bucket[active + ahead]
        active, later = active[later >= 0], later[later >= 0]  # a suffix whose later part is alone is alone
        key = bucket[active].astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)
        updated = np.full(n, -1, dtype=np.int64)
        numbers, kept = _split(key, active)
        updated[active] = numbers
        bucket, active, depth = updated, kept, depth + ahead
    return active, bucket[active]


def _split(key: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers by key (-1 for keys that occur once) and the positions that aren't alone."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    return np.where(shared, number, -1), active[shared]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged spans [start, end) of strings of a length that begin at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(starts)] - 1
    return list(zip(starts[first].tolist(), (starts[last] + length).tolist()))


def removed_spans(docs: DataFrame, length: int = 200, q: int | None = None) -> DataFrame:
    """(_id, _key, start, end): spans of repeated strings, which may overlap. docs has _id, _text and _key, a hash of the text."""
    q = q or 2 * length // 5
    reach = length - q  # bytes of a context before and behind the anchor
    kind = docs.schema["_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_key", "h", "c", "at", "n"]
        for batch in in_pieces(batches, "_text", 4 << 20):
            rows, h_, c_, at_, n_ = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                places, hashes = anchors(np.frombuffer(raw, np.uint8), length, q)
                places, hashes = places.tolist(), hashes.view(np.int64).tolist()
                contexts = [xxhash.xxh3_64_intdigest(raw[max(0, p - reach) : p + length], min(p, reach)) - (1 << 63) for p in places]
                if len(set(hashes)) == len(hashes):
                    own = [[p] for p in places]
                else:
                    found: dict = {}
                    for key, p in zip(zip(hashes, contexts), places):
                        found.setdefault(key, []).append(p)
                    hashes, contexts, own = [k[0] for k in found], [k[1] for k in found], list(found.values())
                rows += [i] * len(own)
                h_ += hashes
                c_ += contexts
                at_ += own
                n_ += map(len, own)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(h_, pa.int64()), pa.array(c_, pa.int64()), pa.array(at_, pa.list_(pa.int32())), pa.array(n_, pa.int32())], names)

    found = stage(docs.select("_id", "_text", "_key").mapInArrow(tidy(mark), f"_id {kind}, _key long, h long, c long, at array<int>, n int"), "anchors")
    twice = found.groupBy("h").agg(F.sum("n").alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("times > 1")
    # written, so that adaptive execution sees two plain sides and can split an anchor that very many documents have
    twice = stage(twice.select(F.col("h").alias("h2"), (F.col("c1") == F.col("c2")).alias("alike")), "twice")
    near = stage(found.join(twice, F.col("h") == F.col("h2")).drop("h2"), "repeated")
    mixed = near.filter(~F.col("alike"))
    kinds = stage(mixed.groupBy("h", "c").agg(F.sum("n").alias("times"), F.min(F.struct("_id", "_key", F.col("at")[0].alias("at"))).alias("one")), "contexts")
    many = kinds.filter("times > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    whole = near.filter("alike").unionByName(mixed.join(many, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2"))).drop("h2", "c2"))
    # a context may be cut short by the ends of its document; where too little is left no string fits, but then it is none of an anchor
    spans = whole.select("_id", "_key", F.explode("at").alias("p")).select("_id", "_key", F.greatest(F.col("p") - reach, F.lit(0)).alias("start"), (F.col("p") + length).alias("end"))

    crowded = stage(kinds.groupBy("h").count().filter(F.col("count") > HOT).select(F.col("h").alias("h2")), "crowded")
    hot = bool(crowded.head(1))
    examples = kinds.select("h", "one.*")
    if hot:
        examples = examples.join(crowded, F.col("h") == F.col("h2"), "left").withColumn("hot", F.col("h2").isNotNull()).drop("h2")
    else:
        examples = examples.withColumn("hot", F.lit(False))
    wanted = examples.groupBy("_id", "_key").agg(F.collect_list(F.struct("h", "at", "hot")).alias("wanted"))  # of one document each
    wanted = wanted.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "wanted")
    both = docs.join(wanted, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2"))).select("_id", "_key", "_text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text", 4 << 20):
            rows, h_, at_, hot_, start_, data = [], [], [], [], [], []
            for i, (text, list_) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                for x in list_:
                    a = max(0, x["at"] - reach)
                    rows.append(i)
                    h_.append(x["h"])
                    at_.append(x["at"] - a)
                    hot_.append(x["hot"])
                    start_.append(a)
                    data.append(raw[a : x["at"] + length])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h_, pa.int64()), pa.array(at_, pa.int32()), pa.array(hot_, pa.bool_()), pa.array(start_, pa.int64()), pa.array(data, pa.binary())], ["_id", "_key", "h", "at", "hot", "start", "data"])

    contexts = stage(both.mapInArrow(tidy(cut), f"_id {kind}, _key long, h long, at int, hot boolean, start long, data binary"), "cuts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts the contexts of whole anchors, about a megabyte at a time."""

        def sorted_(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            blobs, start = table.column("data").to_pylist(), table.column("start").to_numpy()
            sizes = np.array([len(b) for b in blobs])
            offset = np.r_[0, np.cumsum(sizes)[:-1]]
            ends = np.repeat(offset + sizes, sizes)
            at, bucket = refine(np.frombuffer(b"".join(blobs), np.uint8), ends, length)
            if not len(at):
                return
            context = np.searchsorted(offset, at, side="right") - 1
            doc_of: dict = {}
            doc = np.array([doc_of.setdefault(k, len(doc_of)) for k in zip(table.column("_id").to_pylist(), table.column("_key").to_pylist())])
            place = doc[context] << 40 | (start[context] + at - offset[context])  # contexts overlap: the same place may come twice
            order = np.lexsort((place, bucket))
            b, p = bucket[order], place[order]
            edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            last = np.r_[edge[1:], len(b)] - 1
            real = np.repeat(p[edge] != p[last], last - edge + 1)
            where, place, context = at[order][real], p[real], context[order][real]
            order = np.argsort(place, kind="stable")
            place, context = place[order], context[order]
            spans, rows_ = [], []
            cut = np.flatnonzero(place[1:] >> 40 != place[:-1] >> 40) + 1
            for a, z in zip(np.r_[0, cut].tolist(), np.r_[cut, len(place)].tolist()):
                if z > a:
                    own = _runs(place[a:z] & ((1 << 40) - 1), length)
                    spans += own
                    rows_ += [int(context[a])] * len(own)
            take = pa.array(rows_, pa.int64())
            ids, keys = table.column("_id").combine_chunks(), table.column("_key").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], ["_id", "_key", "start", "end"])

        held, size = [], 0
        for whole_ in batches:
            for batch in in_pieces(iter([whole_]), "data", 1 << 18):
                if size > 1 << 20:
                    h = batch.column(2).to_numpy()
                    old = held[-1].column(2)[-1].as_py()
                    new = int(np.argmax(h != old)) if (h != old).any() else batch.num_rows
                    held.append(batch.slice(0, new))
                    if new < batch.num_rows:
                        yield from sorted_(held)
                        held, size = [batch.slice(new)], 0
                else:
                    held.append(batch)
                size += batch.column(6).nbytes
        if held:
            yield from sorted_(held)

    cool = contexts.filter(~F.col("hot")).drop("hot").select("_id", "_key", "h", "at", "start", F.lit(0).alias("x"), "data")
    spans = spans.unionByName(cool.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(sort), f"_id {kind}, _key long, start long, end long"))
    if hot:
        spans = spans.unionByName(_refined_over_cluster(contexts.filter("hot"), length, reach, kind))
    return spans


def _refined_over_cluster(contexts: DataFrame, length: int, reach: int, kind: str) -> DataFrame:
    """Spans of repeated strings of crowded anchors. A string is named by how many bytes of it lie before the anchor;
    a row is a context with a range lo..hi of such numbers, halved from round to round."""

    def halves(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches, "data", 2 << 20):
                rows_, lo_, hi_, inner, outer = [], [], [], [], []
                for i, (at, lo, hi, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                    mid = (lo + hi) // 2
                    for a, z in ((lo, mid), (mid + 1, hi)) if lo < hi else ((lo, hi),):
                        least, most = max(a, length - (len(data) - at)), min(z, at)  # strings that lie in the document
                        if least > most:
                            continue
                        whole = (least, most) == (a, z)
                        rows_.append(i)
                        lo_.append(a)
                        hi_.append(z)
                        inner.append(xxhash.xxh3_128_digest(data[at - a : at - z + length]))
                        outer.append(xxhash.xxh3_128_digest(data[at - z : at - a + length]) if whole else None)
                take = pa.array(rows_, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(lo_, pa.int32()), pa.array(hi_, pa.int32()), batch.column(3).take(take), batch.column(4).take(take), batch.column(5).take(take), batch.column(6).take(take), pa.array(inner, pa.binary()), pa.array(outer, pa.binary())], ["at", "lo", "hi", "data", "_id", "_key", "start", "inner", "outer"])

        return rows.mapInArrow(tidy(run), f"at int, lo int, hi int, data binary, _id {kind}, _key long, start long, inner binary, outer binary")

    def repeated(rows: DataFrame, name: str) -> DataFrame:
        place = F.struct("_id", "_key", (F.col("start") + F.col("at") - F.col("lo")).alias("p"))
        sums = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(place).alias("a"), F.max(place).alias("b"))
        # written, so that the join with it has two plain sides and a string that very many contexts share can be split
        return stage(sums.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col(name).alias(f"{name}2")), name)

    rows = contexts.select("at", F.lit(0).alias("lo"), F.lit(reach).alias("hi"), "data", "_id", "_key", "start")
    out = None
    width = reach + 1
    while True:
        split = stage(halves(rows), "halves")
        inner, outer = repeated(split, "inner"), repeated(split, "outer")
        told = split.join(outer, F.col("outer") == F.col("outer2"), "left").withColumn("settled", F.col("outer2").isNotNull()).drop("outer2")
        done = stage(told.filter("settled").select("_id", "_key", (F.col("start") + F.col("at") - F.col("hi")).alias("start"), (F.col("start") + F.col("at") - F.col("lo") + length).alias("end")), "settled")
        out = done if out is None else out.unionByName(done)
        if width == 1:
            return out
        columns = ["at", "lo", "hi", "data", "_id", "_key", "start"]
        open_ = told.filter("not settled and lo < hi").join(inner, F.col("inner") == F.col("inner2")).select(*columns)
        # one of each settled kind goes on, for others may share a part of it
        settled = told.filter("settled and lo < hi").groupBy("outer").agg(F.min(F.struct(*columns)).alias("one")).select("one.*")
        rows = open_.unionByName(settled)
        width = (width + 1) // 2


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rest: str = "bytes") -> DataFrame:
    """(id or kept columns, n_bytes, n_removed, n_spans, kept_sha256 and, by `rest`, what is left of each text).

    rest="bytes": kept, the bytes that are left; "text": kept_text, without characters of which only some bytes are
    left; "none": neither. Texts cross to Python as often as one form needs and come back in that form only.
    """
    cols = keep or [id_col]
    plan = docs.select(*(docs[c].alias(f"_c{i}") for i, c in enumerate(cols)), docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text"))
    plan = plan.withColumn("_key", F.xxhash64("_text"))
    spans = removed_spans(plan.select("_id", "_text", "_key"), length)
    per = spans.groupBy(F.col("_id").alias("_id2"), F.col("_key").alias("_key2")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one document each
    both = plan.join(per, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left")

    def left(raw: bytes, list_: list[dict] | None) -> tuple[list[bytes], int]:
        """What is left of the bytes, in pieces, and how many runs are gone."""
        merged: list[list[int]] = []
        for s in sorted((x["start"], min(x["end"], len(raw))) for x in list_ or []):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        at = [0, *(x for s in merged for x in s), len(raw)]
        return [raw[a:z] for a, z in zip(at[::2], at[1::2])], len(merged)

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in in_pieces((pa.RecordBatch.from_arrays(list(c), ["text", "spans"]) for c in columns), "text", 4 << 20):
            n, gone, count, sha, kept = [], [], [], [], []
            for text, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                pieces, runs = left(raw, list_)
                whole = b"".join(pieces)
                n.append(len(raw))
                gone.append(len(raw) - len(whole))
                count.append(runs)
                sha.append(hashlib.sha256(whole).hexdigest())
                if rest == "bytes":
                    kept.append(whole)
                elif rest == "text":
                    kept.append("".join([x.decode("utf-8", "ignore") for x in pieces]) if runs else text)
            out = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.StructArray.from_arrays([*out, *([pa.array(kept, pa.binary() if rest == "bytes" else pa.string())] if rest != "none" else [])], names)

    last = {"bytes": [("kept", "binary")], "text": [("kept_text", "string")], "none": []}[rest]
    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *last]
    names = [name for name, _ in fields]
    found = in_batches(run, ", ".join(f"{name} {kind}" for name, kind in fields))(both["_text"], both["spans"])
    out = both.select(*(f"_c{i}" for i in range(len(cols))), found.alias("_found"))
    return out.select(*out.columns[:-1], "_found.*").toDF(*cols, *names)
