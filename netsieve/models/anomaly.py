"""Benign-only anomaly models: isolation forest and autoencoder, with their scoring job."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netsieve import __version__
from netsieve.functions.guards import col, gt
from netsieve.models.preprocess import Scaler, fit_scaler
from netsieve.operators.metrics import benign_threshold
from netsieve.sources.bundles import Bundle

# Forest size, rows per tree, Euler's constant as the score's definition gives it.
TREES = 200
ROWS_PER_TREE = 256
EULER = 0.5772156649

TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def average_path(n) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    out = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree as parallel node arrays; ``feature`` is -1 at a leaf, where ``depth`` is the path length."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "depth")}

    def add(rows: np.ndarray, depth: int) -> int:
        i = len(nodes["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("depth", 0.0)):
            nodes[k].append(v)
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes["depth"][i] = depth + float(average_path(len(rows)))
            return i
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = rows[:, f] <= cut
        nodes["feature"][i], nodes["cut"][i] = f, cut
        nodes["left"][i] = add(rows[below], depth + 1)
        nodes["right"][i] = add(rows[~below], depth + 1)
        return i

    add(x, 0)
    return nodes


def pack_tree(t: dict) -> dict[str, np.ndarray]:
    """A tree for fast walking: children side by side, and leaves that lead to themselves."""
    feature = np.asarray(t["feature"], dtype=np.int64)
    leaf, own = feature < 0, np.arange(len(feature))
    child = np.stack([np.where(leaf, own, t["left"]), np.where(leaf, own, t["right"])], axis=1).ravel()
    levels, at = 0, np.array([0])
    while not leaf[at].all():
        at = np.unique(child.reshape(-1, 2)[at])
        levels += 1
    return {
        "feature": np.where(leaf, 0, feature), "cut": np.asarray(t["cut"], dtype=np.float64), "child": child,
        "depth": np.asarray(t["depth"], dtype=np.float64), "levels": levels,
    }


def path_lengths(trees: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over packed trees; all rows take a step together."""
    total = np.zeros(len(x))
    flat, start = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(t["levels"]):
            value = flat.take(start + t["feature"].take(at))
            at = t["child"].take(2 * at + (value > t["cut"].take(at)))
        total += t["depth"].take(at)
    return total / len(trees)


def _feature_matrix(columns: Sequence[pd.Series]) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])


@dataclass
class IsolationForest:
    scaler: Scaler
    trees: list[dict]
    rows_per_tree: int
    model_type: str = "isolation_forest"
    version: str = __version__

    def score(self) -> Column:
        """``2^(-E[path]/c)``: higher is more anomalous. The forest (at most trees x 511 nodes) ships with the task."""
        trees = [pack_tree(t) for t in self.trees]
        scale = float(average_path(self.rows_per_tree)) or 1.0

        @F.pandas_udf(T.DoubleType())
        def iforest_score(*columns: pd.Series) -> pd.Series:
            x = _feature_matrix(columns)
            return pd.Series(np.power(2.0, -path_lengths(trees, x) / scale))

        return iforest_score(*self.scaler.expressions())

    def to_bundle(self, threshold: float, **config) -> Bundle:
        model = {"scaler": self.scaler.to_dict(), "trees": self.trees, "rows_per_tree": self.rows_per_tree}
        return Bundle(self.scaler.columns, {"model_type": self.model_type, "threshold": threshold, "score_direction": "higher_is_anomaly", **config}, model)


def fit_isolation_forest(
    df: DataFrame, key: Sequence[str], features: Sequence[str], trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 42
) -> IsolationForest:
    """Trees on hash-chosen rows, grown in parallel, one group per tree.

    Sub-sampling is what an isolation forest is; every draw is a hash of the row's key, so the forest does not depend
    on partitioning. About twice the rows a tree needs are sent to it: from a large table a hash filter keeps that
    many rows and gives each to one tree; the rows of a small table go to several trees each. The tree then takes the
    rows with the smallest hashes.
    """
    scaler = fit_scaler(df, features)
    n = df.count()
    psi = min(rows_per_tree, n)
    sent = 2 * trees * rows_per_tree
    keys = [col(k) for k in key]
    rows = df.select(F.xxhash64(F.lit(seed), *keys).alias("_h"), *[x.alias(f"x{i}") for i, x in enumerate(scaler.expressions())])
    if n > sent:
        rows = rows.where(F.pmod(F.xxhash64("_h"), F.lit(2**62)) < F.lit(int(sent / n * 2**62)))
    copies = min(trees, max(1, math.ceil(sent / max(n, 1))))
    # A stride without common factor with the number of trees gives a row's copies to different trees.
    stride = next(k for k in range(trees // 2 + 1, 2 * trees + 2) if math.gcd(k, trees) == 1)
    draws = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draws = draws.withColumn("tree", F.pmod(F.pmod("_h", F.lit(trees)) + F.col("_copy") * stride, F.lit(trees)).cast("int"))
    draws = draws.withColumn("_r", F.xxhash64("_h", "tree"))
    xs = [f"x{i}" for i in range(len(scaler.columns))]
    limit = max(1, math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        sample = pdf.nsmallest(rows_per_tree, ["_r", "_h"])
        nodes = grow_tree(sample[xs].to_numpy(dtype=np.float64), limit, np.random.default_rng([seed, t]))
        return pd.DataFrame([{"tree": t, **nodes}])

    grown = draws.select("tree", "_r", "_h", *xs).groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()
    out = [{k: list(r[k]) for k in ("feature", "cut", "left", "right", "depth")} for r in sorted(grown, key=lambda r: r["tree"])]
    return IsolationForest(scaler, out, psi)


# ---- autoencoder ---------------------------------------------------------------------------------------------


def layer_sizes(n_features: int, hidden: Sequence[int], latent: int) -> list[int]:
    return [n_features, *hidden, latent, *reversed(list(hidden)), n_features]


def init_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        bound = 1.0 / math.sqrt(a)
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        w = flat[at:at + a * b].reshape(a, b)
        at += a * b
        out.append((w, flat[at:at + b]))
        at += b
    return out


def linear_layers(sizes: Sequence[int]) -> set[int]:
    """Layers without activation: the latent layer and the output."""
    n = len(sizes) - 1
    return {n // 2 - 1, n - 1}


def reconstruct(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> list[np.ndarray]:
    acts, plain = [x], linear_layers(sizes)
    for i, (w, b) in enumerate(unpack(flat, sizes)):
        z = acts[-1] @ w + b
        acts.append(z if i in plain else np.maximum(z, 0.0))
    return acts


def gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> np.ndarray:
    """Gradient of the mean squared reconstruction error."""
    acts, plain, layers = reconstruct(flat, sizes, x), linear_layers(sizes), unpack(flat, sizes)
    delta = 2.0 * (acts[-1] - x) / x.size
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        if i not in plain:
            delta = delta * (acts[i + 1] > 0)
        parts = [(acts[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        delta = delta @ layers[i][0].T
    return np.concatenate(parts)


@dataclass
class Autoencoder:
    scaler: Scaler
    sizes: list[int]
    weights: list[float] = field(repr=False, default_factory=list)
    model_type: str = "autoencoder"
    version: str = __version__

    def score(self) -> Column:
        """Mean squared reconstruction error; higher is more anomalous."""
        flat, sizes = np.asarray(self.weights), self.sizes

        @F.pandas_udf(T.DoubleType())
        def reconstruction_error(*columns: pd.Series) -> pd.Series:
            x = _feature_matrix(columns)
            return pd.Series(((reconstruct(flat, sizes, x)[-1] - x) ** 2).mean(axis=1))

        return reconstruction_error(*self.scaler.expressions())

    def to_bundle(self, threshold: float, **config) -> Bundle:
        model = {"scaler": self.scaler.to_dict(), "sizes": self.sizes, "weights": self.weights}
        return Bundle(self.scaler.columns, {"model_type": self.model_type, "threshold": threshold, "score_direction": "higher_is_anomaly", **config}, model)


def fit_autoencoder(
    df: DataFrame, features: Sequence[str], epochs: int = 30, batch_size: int = 1024, lr: float = 1e-3,
    hidden: Sequence[int] = (64, 32), latent: int = 16, seed: int = 42,
) -> Autoencoder:
    """Data-parallel training: in each epoch every task runs mini-batch Adam over all its rows from the shared
    weights, and the results are averaged by row count.

    A task streams its rows in Arrow batches and holds one weight vector. The vectors are averaged in two levels
    (about sqrt(tasks) groups), so neither a task nor the driver meets more than about sqrt(tasks) of them.
    """
    scaler = fit_scaler(df, features)
    sizes = layer_sizes(len(scaler.columns), hidden, latent)
    names = [f"x{i}" for i in range(len(scaler.columns))]
    data = df.select(*[x.alias(n) for x, n in zip(scaler.expressions(), names)]).persist()
    groups = max(1, math.isqrt(data.rdd.getNumPartitions()))
    schema = "g int, n bigint, w array<double>"
    flat = init_weights(sizes, seed)
    try:
        for epoch in range(epochs):
            start, step0 = flat, epoch

            def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                from pyspark import TaskContext

                w = start.copy()
                m, v, step, seen = np.zeros_like(w), np.zeros_like(w), 0, 0
                pid = TaskContext.get().partitionId()
                rng = np.random.default_rng([seed, step0, pid])
                for pdf in batches:
                    x = pdf.to_numpy(dtype=np.float64)
                    x = x[rng.permutation(len(x))]
                    for i in range(0, len(x), batch_size):
                        g = gradient(w, sizes, x[i:i + batch_size])
                        step += 1
                        m = 0.9 * m + 0.1 * g
                        v = 0.999 * v + 0.001 * g * g
                        w = w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    seen += len(x)
                if seen:
                    yield pd.DataFrame([{"g": pid % groups, "n": seen, "w": w}])

            def average(pdf: pd.DataFrame) -> pd.DataFrame:
                n = pdf["n"].to_numpy(dtype=np.float64)
                w = sum(k * np.asarray(r) for k, r in zip(n, pdf["w"])) / n.sum()
                return pd.DataFrame([{"g": int(pdf["g"].iloc[0]), "n": int(n.sum()), "w": w}])

            parts = data.mapInPandas(train, schema).groupBy("g").applyInPandas(average, schema).collect()
            if not parts:
                raise ValueError("no rows to train on")
            total = sum(p["n"] for p in parts)
            flat = sum(p["n"] / total * np.asarray(p["w"]) for p in sorted(parts, key=lambda p: p["g"]))
    finally:
        data.unpersist()
    return Autoencoder(scaler, sizes, [float(w) for w in flat])


# ---- scoring job ---------------------------------------------------------------------------------------------


def load_anomaly_model(b: Bundle) -> IsolationForest | Autoencoder:
    kind, m = b.config.get("model_type"), b.model
    if kind == "isolation_forest":
        return IsolationForest(Scaler(**m["scaler"]), m["trees"], m["rows_per_tree"], version=b.config.get("bundle_version", ""))
    if kind == "autoencoder":
        return Autoencoder(Scaler(**m["scaler"]), m["sizes"], m["weights"], version=b.config.get("bundle_version", ""))
    raise ValueError(f"unknown anomaly model type {kind!r}")


def fit_threshold(benign_validation: DataFrame, model: IsolationForest | Autoencoder, percentile: float = 99.0) -> float:
    scored = benign_validation.select(model.score().alias("anomaly_score"))
    return benign_threshold(scored, "anomaly_score", percentile)


def score_anomaly(df: DataFrame, model: IsolationForest | Autoencoder, threshold: float, keep: Sequence[str]) -> DataFrame:
    """Scores, threshold, flag, model type and version, ids passed through."""
    out = df.select(*[col(k) for k in keep], model.score().alias("anomaly_score"))
    return out.select(
        *[col(k) for k in keep], "anomaly_score", F.lit(float(threshold)).alias("threshold"),
        gt(F.col("anomaly_score"), F.lit(float(threshold))).alias("is_anomaly"),
        F.lit(model.model_type).alias("model_type"), F.lit(model.version).alias("bundle_version"),
    )
