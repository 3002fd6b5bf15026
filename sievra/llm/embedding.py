"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= t between vectors is a distance of at most eps = sqrt(2 - 2t) between their unit vectors. Unit vectors are
turned into principal axes (fitted on a bounded sample; a rotation, so nothing is lost), laid on a grid of cells of
width eps along the leading axes and sorted by cell, axis after axis. The sorted sequence is cut into intervals, and
pairs of intervals are joined recursively: halves whose bounding boxes are further apart than eps are skipped, small
ones are compared by their cosines in double precision.

Equal vectors are one class that is compared once and counted as often as it occurs. A pair of intervals returns
the number of links of each class and a forest of links, never all pairs. The driver holds one box an interval, and
there are at most INTERVALS of them.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null id, link with
nothing and are components of their own. Vectors of different length don't link. Repeated rows count as vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tidy
from .components import components
from .simhash import _forest

#: Most intervals, and vectors in the least of them.
INTERVALS, LEAST = 1024, 4096
#: Vectors of a block; recursion ends there.
BLOCK = 256
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Columns: the principal axes of the sample, the widest first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    _, vectors = np.linalg.eigh(np.cov(sample.T))
    return np.ascontiguousarray(vectors[:, ::-1])


def grid_keys(y: np.ndarray, eps: float) -> np.ndarray:
    """Order of the grid: the cell numbers along the leading axes as digits of one integer."""
    cells = math.floor(2 / eps) + 3
    digits = max(1, min(y.shape[1], int(62 / math.log2(cells))))
    key = np.zeros(len(y), dtype=np.int64)
    for d in range(digits):
        key = key * cells + np.clip(np.floor((y[:, d] + 1) / eps), 0, cells - 1).astype(np.int64)
    return key


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """The least squared distance between points of two boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap)


class Sequence:
    """Vectors in grid order with boxes for every node of a binary tree over its blocks."""

    def __init__(self, x: np.ndarray, basis: np.ndarray):
        self.x = unit(x)
        self.y = self.x @ basis
        self.order = np.arange(len(x))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            if b - a <= BLOCK:
                self.boxes[a, b] = self.y[a:b].min(axis=0), self.y[a:b].max(axis=0)
            else:
                m = (a + b) // 2
                (l1, h1), (l2, h2) = self.box(a, m), self.box(m, b)
                self.boxes[a, b] = np.minimum(l1, l2), np.maximum(h1, h2)
        return self.boxes[a, b]


def join(s: Sequence, t: Sequence, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row in s, first row in t, matrix of links) of the blocks that may link. s may be t: then each pair comes once,
    and blocks on the diagonal hold both directions without the diagonal itself."""
    limit = 2 - 2 * threshold + SLACK
    todo = [(0, len(s.x), 0, len(t.x))] if len(s.x) and len(t.x) else []
    while todo:
        a, b, c, d = todo.pop()
        if apart(*s.box(a, b), *t.box(c, d)) > limit:
            continue
        if b - a <= BLOCK and d - c <= BLOCK:
            near = s.x[a:b] @ t.x[c:d].T >= threshold
            if s is t and a == c:
                np.fill_diagonal(near, False)
            if near.any():
                yield a, c, near
            continue
        m, n = (a + b) // 2, (c + d) // 2
        if s is t and (a, b) == (c, d):
            todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= d - c:
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            todo += [(a, b, c, n), (a, b, n, d)]


def _boxes_meet(boxes: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs i <= j of intervals whose boxes are close enough, by recursion over runs of intervals. boxes: n x 2 x axes."""
    out: list[tuple[int, int]] = []
    memo: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in memo:
            memo[a, b] = boxes[a:b, 0].min(axis=0), boxes[a:b, 1].max(axis=0)
        return memo[a, b]

    todo = [(0, len(boxes), 0, len(boxes))] if len(boxes) else []
    while todo:
        a, b, c, d = todo.pop()
        if apart(*box(a, b), *box(c, d)) > limit:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
            continue
        m, n = (a + b) // 2, (c + d) // 2
        if (a, b) == (c, d):
            todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= d - c:
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            todo += [(a, b, c, n), (a, b, n, d)]
    return out


def _of_length(classes: DataFrame, dims: int, threshold: float, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of links (key, n) and a forest of links (a, b) among classes (key, weight, x) of one length."""
    spark = classes.sparkSession
    eps = math.sqrt(max(2 - 2 * threshold, 1e-12)) + SLACK
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("key")).limit(sample_rows).select("x").toPandas()["x"]
    basis = axes(unit(np.stack([np.asarray(v, dtype=np.float64) for v in sample])))
    shared = spark.sparkContext.broadcast(basis)
    intervals = max(1, min(INTERVALS, math.ceil(count / LEAST)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                grid = grid_keys(unit(x) @ shared.value, eps)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(x, dtype="<f8").view(f"V{8 * dims}").ravel().tolist(), pa.binary()), pa.array(grid)], ["key", "weight", "x", "grid"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, batch in enumerate(b for whole in batches for b in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK))):
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<f8").reshape(-1, dims)
            y = unit(x) @ shared.value
            rows = [pa.array([v], t) for v, t in ((part, pa.int32()), (n, pa.int32()), (batch.column(0).to_pylist(), pa.list_(pa.string())), (batch.column(1).to_pylist(), pa.list_(pa.int64())), (x.tobytes(), pa.binary()), (y.min(axis=0), pa.list_(pa.float64())), (y.max(axis=0), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(rows, ["part", "block", "keys", "weights", "x", "low", "high"])

    ordered = classes.select("key", "weight", "x").mapInArrow(tidy(keyed), "key string, weight long, x binary, grid long")
    ordered = ordered.repartitionByRange(intervals, "grid", "key").sortWithinPartitions("grid", "key").select("key", "weight", "x")
    blocks = stage(ordered.mapInArrow(tidy(blocked), "part int, block int, keys array<string>, weights array<long>, x binary, low array<double>, high array<double>"), "blocks")
    corner = lambda f, c: F.array(*(f(F.col(c)[d]) for d in range(dims)))
    boxes = blocks.groupBy("part").agg(corner(F.min, "low").alias("low"), corner(F.max, "high").alias("high")).orderBy("part").collect()  # at most INTERVALS rows
    near = _boxes_meet(np.array([[b.low, b.high] for b in boxes]), 2 - 2 * threshold + SLACK)
    pairs = spark.createDataFrame([(boxes[i].part, boxes[j].part) for i, j in near], "i int, j int")
    one = pairs.join(blocks, pairs.i == blocks.part)
    two = pairs.filter("i != j").join(blocks, pairs.j == blocks.part)
    sides = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1))).select("i", "j", "side", "block", "keys", "weights", "x")

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        own = table.column("side").to_pylist()
        number = table.column("block").to_pylist()
        for side in (0, 1):
            at = sorted((k for k, v in enumerate(own) if v == side), key=number.__getitem__)
            x = b"".join(table.column("x")[k].as_py() for k in at)
            keys = [v for k in at for v in table.column("keys")[k].as_py()]
            weights = np.array([v for k in at for v in table.column("weights")[k].as_py()], dtype=np.int64)
            sides.append((Sequence(np.frombuffer(x, dtype="<f8").reshape(-1, dims), shared.value) if at else None, keys, weights))
        (s, s_keys, s_weights), (t, t_keys, t_weights) = sides
        same = t is None
        if same:
            t, t_keys, t_weights = s, s_keys, s_weights
        n_s, n_t = np.zeros(len(s_keys), np.int64), np.zeros(len(t_keys), np.int64)
        shift = 0 if same else len(s_keys)
        left, right, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for a, c, near in join(s, t, threshold):
            n_s[a : a + near.shape[0]] += near @ t_weights[c : c + near.shape[1]]
            if not (same and a == c):
                (n_s if same else n_t)[c : c + near.shape[1]] += s_weights[a : a + near.shape[0]] @ near
            i, j = np.nonzero(near)
            left.append(i + a)
            right.append(j + c + shift)
            held += len(i)
            if held > 1 << 20:
                x, y = _forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [x], [y], len(x)
        x, y = _forest(np.concatenate(left), np.concatenate(right))
        names = s_keys if same else s_keys + t_keys
        counts = n_s if same else np.r_[n_s, n_t]
        some = np.flatnonzero(counts)
        return pa.table({
            "key": pa.array([names[k] for k in some] + [names[k] for k in x], pa.string()),
            "other": pa.array([None] * len(some) + [names[k] for k in y], pa.string()),
            "n": pa.array(np.r_[counts[some], np.zeros(len(x), np.int64)], pa.int64()),
        })

    found = stage(sides.groupBy("i", "j").applyInArrow(compare, "key string, other string, n long"), "near")
    numbers = found.filter("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    return numbers, found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 10_000) -> DataFrame:
    """(id, n_links, component_id, kept): for each row the number of other vectors within the threshold, the smallest id
    that links lead to (itself included) and whether that is its own."""
    x = F.col("x")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    key = F.concat_ws("-", F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), x)), 16, "0"), F.size(x).cast("string"))
    rows = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), key))
    classes = stage(rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("x").alias("x")), "classes")
    members = stage(rows.select("id", "key"), "members")
    numbers = links = None
    for (length,) in sorted(classes.select(F.size("x")).distinct().collect()):
        n, forest = _of_length(classes.filter(F.size("x") == length), length, threshold, sample_rows)
        numbers, links = (n, forest) if numbers is None else (numbers.unionByName(n), links.unionByName(forest))
    if numbers is None:
        return members.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = components(links)
    rooted = classes.select("key", "weight", "least").join(found, classes.key == found.vertex, "left").select("key", "weight", "least", F.coalesce("root", "key").alias("root"))
    names = stage(rooted.groupBy("root").agg(F.min("least").alias("component")), "names")
    told = rooted.join(names, "root").join(numbers, "key", "left").select(F.col("key").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    out = members.join(told, members.key == told["_key"], "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
