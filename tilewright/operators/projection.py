"""Two-dimensional maps of vectors that keep neighbours together: a layout of a sample by its neighbour graph, in which all other rows find their place.

The sample is bounded (per_cluster rows of each cluster, most in all) and is what reaches the driver: a graph of nearest neighbours, found by tasks that each
compare some rows with the whole sample; weights that fade with distance; then positions that neighbours attract and random others repel. Rows of any
number are placed by tasks, among the neighbours that they have in the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmeans
from .sampling import hashed_sample, per_group_sample

#: The curve 1 / (1 + A d^2B) that stands for closeness in the plane, for points that keep a distance of 0.1.
A, B = 1.577, 0.8951
#: Distances that a task holds at a time.
HELD = 1 << 22


@dataclass
class Layout:
    """Of the sample: ids, clusters, vectors (as they are compared, after projection by mean and axes), positions in the plane, neighbours by place."""

    ids: list
    clusters: list
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    positions: np.ndarray
    neighbours: np.ndarray


def nearest(x: np.ndarray, of: np.ndarray, k: int, itself: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k rows of `of` that are nearest to each row of x, in order; itself: the place of each row of x in `of`, which
    isn't its own neighbour."""
    at, far = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    norms = (of**2).sum(axis=1)
    for a in range(0, len(x), step := max(1, HELD // len(of))):
        part = x[a : a + step]
        d2 = norms - 2 * part @ of.T + (part**2).sum(axis=1)[:, None]
        if itself is not None:
            d2[np.arange(len(part)), itself[a : a + step]] = np.inf
        near = np.argpartition(d2, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(d2, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        at[a : a + step] = np.take_along_axis(near, order, axis=1)
        far[a : a + step] = np.sqrt(np.maximum(np.take_along_axis(d, order, axis=1), 0))
    return at, far


def neighbour_graph(spark, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of a sample among itself, a block of rows a task."""
    shared = spark.sparkContext.broadcast(x)  # the sample, whose size is bounded
    blocks = max(1, min(len(x), spark.sparkContext.defaultParallelism * 2))

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = np.arange(block, len(shared.value), blocks)
                at, far = nearest(shared.value[rows], shared.value, k, rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(at)), pa.array(list(far))], names=["row", "at", "far"])

    got = spark.range(blocks, numPartitions=blocks).mapInArrow(run, "row long, at array<long>, far array<double>").orderBy("row").toArrow()
    return (got.column(c).combine_chunks().flatten().to_numpy().reshape(len(x), k) for c in ("at", "far"))


def closeness(far: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of neighbours, 1 for the nearest: exp(-(d - nearest) / s), where s is such that a row's weights add up to the logarithm of their number."""
    least, want = far[:, :1], np.log2(far.shape[1])
    low, high = np.zeros((len(far), 1)), np.full((len(far), 1), np.inf)
    s = np.ones((len(far), 1))
    for _ in range(rounds):
        total = np.exp(-(far - least) / s).sum(axis=1, keepdims=True)
        low, high = np.where(total < want, s, low), np.where(total > want, s, high)
        s = np.where(np.isinf(high), 2 * s, (low + high) / 2)
        s = np.maximum(s, 1e-9)
    return np.exp(-(far - least) / np.maximum(s, 1e-3 * far.mean()))


def arrange(start: np.ndarray, at: np.ndarray, weight: np.ndarray, epochs: int = 200, repelled: int = 5, seed: int = 42) -> np.ndarray:
    """Positions after `epochs` rounds from a start: an edge attracts as often as its weight says, and each time its ends are repelled by some
    random points. Steps shrink to nothing."""
    n, k = at.shape
    rng = np.random.default_rng(seed)
    i, j, w = np.repeat(np.arange(n), k), at.ravel(), weight.ravel()
    key, w = np.concatenate([i * n + j, j * n + i]), np.concatenate([w, w])
    key, inverse = np.unique(key, return_inverse=True)
    own = np.bincount(inverse[: n * k], w[: n * k], len(key))
    back = np.bincount(inverse[n * k :], w[n * k :], len(key))
    both = own + back - own * back  # either end's say
    i, j = key // n, key % n
    y = start.copy()
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for part in np.array_split(rng.permutation(np.flatnonzero(rng.random(len(key)) < both / both.max())), 4):
            a, b = i[part], j[part]
            delta = y[a] - y[b]
            d2 = (delta**2).sum(axis=1)
            pull = np.clip((-2 * A * B * np.maximum(d2, 1e-9) ** (B - 1) / (1 + A * d2**B))[:, None] * delta, -4, 4) * rate
            move = np.stack([np.bincount(a, pull[:, c], n) - np.bincount(b, pull[:, c], n) for c in (0, 1)], axis=1)
            a = np.repeat(a, repelled)
            b = rng.integers(0, n, len(a))
            delta = y[a] - y[b]
            d2 = (delta**2).sum(axis=1)
            push = np.clip((2 * B / ((1e-3 + d2) * (1 + A * d2**B)))[:, None] * delta, -4, 4) * rate * (a != b)[:, None]
            move += np.stack([np.bincount(a, push[:, c], n) for c in (0, 1)], axis=1)
            y += move
    return y


def fit_layout(rows: DataFrame, per_cluster: int = 600, most: int = 65_536, variance: float = 0.95, neighbours: int = 15, epochs: int = 200, id_col: str = "unique_id", cluster: str = "cluster", vector: str = "vector", seed: int = 42) -> Layout:
    """A layout of per_cluster rows of each cluster, `most` in all, by a hash of their ids, on the principal components that hold this share of the
    variance. Rows without a vector take no part."""
    there = rows.where(F.col(vector).isNotNull())
    some = hashed_sample(per_group_sample(there.select(id_col, cluster, vector), cluster, id_col, per_cluster), id_col, most)
    mean, axes, _ = kmeans.pca(some, variance=variance, vector=vector)
    got = kmeans.project(some, mean, axes, vector, "_x").select(id_col, cluster, "_x").toArrow()  # the sample
    x = kmeans._matrix(got.column(2).combine_chunks())
    k = min(neighbours, len(x) - 1)
    if k < 2:
        raise ValueError("a layout takes three rows at least")
    at, far = neighbour_graph(rows.sparkSession, x, k)
    start = np.zeros((len(x), 2))
    start[:, : min(2, x.shape[1])] = x[:, :2]
    start = 10 * start / max(np.abs(start).max(), 1e-12) + np.random.default_rng(seed).normal(0, 1e-4, start.shape)
    return Layout(got.column(0).to_pylist(), got.column(1).to_pylist(), mean, axes, x, arrange(start, at, closeness(far), epochs, seed=seed), at)


def place(rows: DataFrame, layout: Layout, neighbours: int = 15, vector: str = "vector") -> DataFrame:
    """rows with x and y: the mean position of the sample's rows that are nearest, weighted by closeness; a row of the sample keeps its own. Both are
    null where the vector is."""
    from pyspark.sql.functions import pandas_udf

    shared = rows.sparkSession.sparkContext.broadcast(layout)  # the sample
    k = min(neighbours, len(layout.vectors))

    def run(v):
        import pandas as pd

        out, there = np.full((len(v), 2), np.nan), v.notna().to_numpy()
        if there.any():
            at, far = nearest((np.stack(v[there].to_numpy()).astype(np.float64) - shared.value.mean) @ shared.value.axes, shared.value.vectors, k)
            w = closeness(far) if k > 1 else np.ones((len(far), 1))
            w[far[:, 0] < 1e-6 * max(far.mean(), 1e-12), 1:] = 0.0  # itself
            out[there] = (shared.value.positions[at] * (w / w.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)
        return pd.DataFrame({c: pd.arrays.FloatingArray(np.ascontiguousarray(out[:, i]), ~there) for i, c in enumerate("xy")})

    return rows.withColumn("_at", pandas_udf(run, "x double, y double")(F.col(vector))).select("*", "_at.x", "_at.y").drop("_at")


def sample_frame(spark, layout: Layout, id_col: str = "unique_id") -> DataFrame:
    """The sample: id, cluster, x and y."""
    return spark.createDataFrame([(i, c, float(x), float(y)) for i, c, (x, y) in zip(layout.ids, layout.clusters, layout.positions)], [id_col, "cluster", "x", "y"])


def neighbours_kept(layout: Layout, positions: np.ndarray | None = None) -> float:
    """The share of the sample's neighbours that are among as many neighbours in the plane."""
    y = layout.positions if positions is None else positions
    near, _ = nearest(y, y, layout.neighbours.shape[1], np.arange(len(y)))
    return float(np.mean([len(np.intersect1d(a, b)) for a, b in zip(near, layout.neighbours)]) / near.shape[1])


def central_rows(placed: DataFrame, cluster: str = "cluster", id_col: str = "unique_id") -> DataFrame:
    """Of each cluster the row that is nearest to its centre in the plane (ties: the smallest id), with the centre."""
    mid = placed.where("x is not null").groupBy(F.col(cluster).alias("_c")).agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))
    away = F.hypot(F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y"))
    got = placed.where("x is not null").join(mid, F.col(cluster).eqNullSafe(F.col("_c"))).groupBy(cluster, "center_x", "center_y").agg(F.min_by(F.struct(id_col, "x", "y"), F.struct(away, F.col(id_col))).alias("r"))
    return got.select(cluster, "center_x", "center_y", F.col(f"r.{id_col}").alias(id_col), "r.x", "r.y")
