"""Anomalies by an autoencoder and missing numbers by regression.

Networks are trained on the driver on a bounded sample, by mini-batches with a fixed seed, so results repeat.
They are applied as column expressions: a forward pass is arithmetic that code generation compiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V
from ..sources.tables import ROW, complete_rows

#: Rows that a network is trained on at most.
SAMPLE = 20_000
LEAST_ROWS = 5


# --- dense networks


@dataclass
class Dense:
    """weights: inputs x outputs."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "relu"

    def forward(self, x: np.ndarray) -> np.ndarray:
        return activate(x @ self.weights + self.bias, self.activation)


def activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(0, z)
    return 1 / (1 + np.exp(-z)) if kind == "sigmoid" else z


def slope(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return (z > 0).astype(float)
    if kind == "sigmoid":
        s = activate(z, kind)
        return s * (1 - s)
    return np.ones_like(z)


def network(sizes: list[int], seed: int = 42) -> list[Dense]:
    """Layers with He-normal weights and zero biases; the last is linear."""
    rng = np.random.default_rng(seed)
    return [Dense(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b), "linear" if k == len(sizes) - 2 else "relu") for k, (a, b) in enumerate(zip(sizes, sizes[1:]))]


def predict(layers: list[Dense], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer.forward(x)
    return x


def loss(output: np.ndarray, target: np.ndarray) -> float:
    return float(((output - target) ** 2).mean())


def train(layers: list[Dense], x: np.ndarray, y: np.ndarray, rate: float, epochs: int, batch: int = 32, seed: int = 42, stop: float = 1e-7) -> float:
    """Mini-batch descent with momentum on the mean squared error; returns the last epoch's."""
    rng = np.random.default_rng(seed)
    speed = [(np.zeros_like(layer.weights), np.zeros_like(layer.bias)) for layer in layers]
    before = np.inf
    for _ in range(epochs):
        order, total = rng.permutation(len(x)), 0.0
        for k in range(0, len(x), batch):
            rows = order[k : k + batch]
            inputs, sums, at = [], [], x[rows]
            for layer in layers:
                inputs.append(at)
                sums.append(at @ layer.weights + layer.bias)
                at = activate(sums[-1], layer.activation)
            total += loss(at, y[rows]) * len(rows)
            grad = 2 / at.shape[1] * (at - y[rows]) / len(rows)
            for i in range(len(layers) - 1, -1, -1):
                grad = grad * slope(sums[i], layers[i].activation)
                w, b = speed[i]
                w *= 0.9
                w += inputs[i].T @ grad
                b *= 0.9
                b += grad.sum(axis=0)
                grad = grad @ layers[i].weights.T
                layers[i].weights -= rate * w
                layers[i].bias -= rate * b
        if abs(before - total) < stop * len(x):
            break
        before = total
    return before / max(1, len(x)) if np.isfinite(before) else 0.0


def layer_columns(layer: Dense, inputs: list[Column]) -> list[Column]:
    """A layer's outputs as sums of products, which code generation compiles."""
    outputs = []
    for k in range(len(layer.bias)):
        z = F.lit(float(layer.bias[k]))
        for v, w in zip(inputs, layer.weights[:, k]):
            z = z + v * F.lit(float(w))
        outputs.append(E.relu(z) if layer.activation == "relu" else E.sigmoid(z) if layer.activation == "sigmoid" else z)
    return outputs


def with_network(df: DataFrame, layers: list[Dense], inputs: list[Column], name: str) -> DataFrame:
    """df with the outputs of a network as an array. Each layer is a projection with a column a unit, so that expressions
    don't double from layer to layer: columns that are used more than once aren't put into the next projection."""
    at, own = inputs, []
    for i, layer in enumerate(layers):
        names = [f"{name}_{i}_{k}" for k in range(len(layer.bias))]
        df = df.withColumns(dict(zip(names, layer_columns(layer, at))))
        at, own = [F.col(n) for n in names], own + names
    return df.withColumn(name, F.array(*at)).drop(*own)


def _sample(df: DataFrame, columns: list[str]) -> np.ndarray:
    """A bounded sample of rows by a hash of their values."""
    rows = df.select(*(E.col(c) for c in columns))
    table = rows.orderBy(F.xxhash64(*(E.col(c) for c in columns))).limit(SAMPLE).toPandas()
    return table.to_numpy(dtype=float).reshape(-1, len(columns))


# --- anomalies


@dataclass
class Autoencoder:
    columns: list[str]
    low: list[float]
    high: list[float]
    layers: list[Dense]
    threshold: float = V.ANOMALY_THRESHOLD


def autoencoder_sizes(k: int) -> list[int]:
    narrow = max(2, k // 2)
    middle = (k + narrow) // 2
    return [k, middle, narrow, middle, k]


def fit_autoencoder(df: DataFrame, columns: list[str], threshold: float = V.ANOMALY_THRESHOLD, epochs: int = 60, rate: float = 0.01, seed: int = 42) -> Autoencoder | None:
    """None where there are no numeric columns or fewer than five complete rows."""
    if not columns:
        return None
    rows = complete_rows(df, columns)
    stats = rows.agg(F.count("*").alias("n"), *(F.min(E.col(c)).alias(f"a{i}") for i, c in enumerate(columns)), *(F.max(E.col(c)).alias(f"b{i}") for i, c in enumerate(columns))).first()
    if stats.n < LEAST_ROWS:
        return None
    low = [float(stats[f"a{i}"]) for i in range(len(columns))]
    high = [float(stats[f"b{i}"]) for i in range(len(columns))]
    x = _sample(rows, columns)
    wide = np.array(high) - low
    x = np.where(wide < 1e-8, 0.5, (x - low) / np.where(wide < 1e-8, 1, wide))
    layers = network(autoencoder_sizes(len(columns)), seed)
    train(layers, x, x, rate, epochs, seed=seed)
    return Autoencoder(columns, low, high, layers, threshold)


def anomaly_scores(df: DataFrame, model: Autoencoder, keep: list[str] | None = None) -> DataFrame:
    """The complete rows' kept columns (the row id) with `score`, the mean squared error of reconstruction."""
    keep = keep or [ROW]
    names = [f"_x{i}" for i in range(len(model.columns))]
    rows = df.select(*(E.col(c) for c in keep), *(E.num(E.col(c).cast("string")).alias(n) for c, n in zip(model.columns, names))).dropna(subset=names)
    rows = rows.select(*(E.col(c) for c in keep), *(E.min_max(F.col(n), F.lit(a), F.lit(b)).alias(n) for n, a, b in zip(names, model.low, model.high)))
    rows = with_network(rows, model.layers, [F.col(n) for n in names], "_out")
    return rows.select(*(E.col(c) for c in keep), E.mse([F.get("_out", F.lit(i)) for i in range(len(names))], [F.col(n) for n in names]).alias("score"))


def anomalies(df: DataFrame, model: Autoencoder) -> DataFrame:
    return anomaly_scores(df, model).filter(F.col("score") > model.threshold)


# --- missing numbers


@dataclass
class Regressor:
    """Predicts `target` from `features`; all are z-scored. layers of one linear unit: least squares."""

    target: str
    features: list[str]
    mean: list[float]
    std: list[float]
    layers: list[Dense]


def fit_regressor(df: DataFrame, target: str, features: list[str], hidden: bool = False, epochs: int = 300, rate: float = 0.01, seed: int = 42) -> Regressor | None:
    """hidden=False: least squares from sums over all rows, in one aggregation. hidden=True: a network with two hidden layers.

    None with fewer than five complete rows or without features.
    """
    if not features:
        return None
    cols = [*features, target]
    rows = complete_rows(df, cols)
    stats = rows.agg(F.count("*").alias("n"), *(F.avg(E.col(c)).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_pop(E.col(c)).alias(f"s{i}") for i, c in enumerate(cols))).first()
    if stats.n < LEAST_ROWS:
        return None
    mean = [float(stats[f"m{i}"]) for i in range(len(cols))]
    std = [float(stats[f"s{i}"]) if stats[f"s{i}"] >= 1e-8 else 1.0 for i in range(len(cols))]
    z = [(E.col(c) - m) / s for c, m, s in zip(cols, mean, std)]
    if hidden:
        x = (_sample(rows, cols) - mean) / std
        k = len(features)
        layers = network([k, max(4, 2 * k), max(4, 2 * k), 1], seed)
        train(layers, x[:, :-1], x[:, -1:], rate, epochs, seed=seed)
    else:
        sums = rows.agg(*(F.avg(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols)))).first()
        cross = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))], dtype=float)
        weights = np.linalg.pinv(cross[:-1, :-1], rcond=1e-10, hermitian=True) @ cross[:-1, -1:]
        layers = [Dense(weights, np.zeros(1), "linear")]
    return Regressor(target, list(features), mean, std, layers)


def impute(df: DataFrame, model: Regressor, name: str = "predicted_value") -> DataFrame:
    """Rows whose target isn't a number and whose features all are, with the target's predicted value."""
    names = [f"_x{i}" for i in range(len(model.features))]
    rows = df.withColumns({n: E.num(E.col(c).cast("string")) for c, n in zip(model.features, names)})
    rows = rows.filter(E.num(E.col(model.target).cast("string")).isNull()).dropna(subset=names)
    rows = with_network(rows, model.layers, [(F.col(n) - m) / s for n, m, s in zip(names, model.mean, model.std)], "_out")
    return rows.withColumn(name, F.get("_out", F.lit(0)) * model.std[-1] + model.mean[-1]).drop("_out", *names)


def imputations(df: DataFrame, columns: list[str], hidden: bool = False) -> DataFrame | None:
    """(row, column, predicted_value) for the empty cells of numeric columns, one model a column; df has row ids.

    None where fewer than two columns are numeric or nothing can be predicted.
    """
    out = None
    if len(columns) < 2:
        return None
    for c in columns:
        model = fit_regressor(df, c, [x for x in columns if x != c], hidden)
        if model:
            part = impute(df, model).select(F.col(ROW).alias("row"), F.lit(c).alias("column"), F.col("predicted_value"))
            out = part if out is None else out.unionByName(part)
    return out


def fill_imputed(df: DataFrame, found: DataFrame, places: int = 4) -> DataFrame:
    """df with the imputed cells filled in as text; df has row ids."""
    columns = [c for c in df.columns if c != ROW]
    wide = found.groupBy(F.col("row").alias("_row")).pivot("column", columns).agg(F.first(E.number_text(F.col("predicted_value"), places)))
    joined = df.join(wide.toDF("_row", *(f"_p{i}" for i in range(len(columns)))), F.col(ROW) == F.col("_row"), "left")
    return joined.select(*([F.col(ROW)] if ROW in df.columns else []), *(F.coalesce(F.col(f"_p{i}"), E.col(c).cast("string")).alias(c) for i, c in enumerate(columns)))
