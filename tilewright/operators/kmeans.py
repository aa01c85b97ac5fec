"""k-means: training, mini-batch updates, assignment, resumable prediction, principal components, sub-clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_vectors, squared_distance
from .tissue import relabel_single, with_tissue

Centers = np.ndarray


def fit(rows: DataFrame, k: int, seed: int = 42, rounds: int = 20, vector: str = "vector", tolerance: float = 1e-4) -> Centers:
    """Centres by full passes from seeds(), until a pass takes less than the share `tolerance` off the sum of squared distances, or after `rounds`
    passes; fewer than k where rows differ less."""
    centers, before = seeds(rows, k, seed, vector=vector), np.inf
    for _ in range(rounds):
        n, sums, cost = cluster_sums(rows, centers, vector)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if before - cost <= tolerance * cost:
            break
        before = cost
    return centers


def seeds(rows: DataFrame, k: int, seed: int = 42, rounds: int = 4, oversample: int = 2, vector: str = "vector") -> Centers:
    """k rows to start from, by parallel oversampled seeding: in each round oversample * k rows are drawn by their squared distance to what was drawn
    before; the draws, weighted by the rows that are nearest to them, are then reduced to k. The draws (rounds * oversample * k rows) are all that
    reaches the driver."""
    there = rows.where(F.col(vector).isNotNull())
    first = there.select(vector).orderBy(F.rand(seed)).limit(1).toArrow().column(0)
    if not len(first):
        raise ValueError("nothing to train on")
    drawn = _matrix(first.combine_chunks())
    for r in range(rounds):
        more = far_rows(there, drawn, oversample * k, seed + 1 + r, vector)
        if not len(more):
            break
        drawn = np.concatenate([drawn, more])
    n, _, _ = cluster_sums(there, drawn, vector)
    return weighted_centers(drawn, n, k, np.random.default_rng(seed))


def far_rows(rows: DataFrame, centers: Centers, n: int, seed: int, vector: str = "vector") -> np.ndarray:
    """n rows (all that aren't centers, if they are fewer), drawn without replacement by their squared distance to the nearest centre: those with
    the smallest exponential variates at that rate, of each task first."""
    near = assign(rows.select(vector), centers, vector).where("d2 > 0")
    wait = -F.log1p(-F.rand(seed)) / F.col("d2")
    got = near.select(vector, wait.alias("wait")).orderBy("wait").limit(n).select(vector).toArrow().column(0)
    return _matrix(got.combine_chunks()) if len(got) else np.zeros((0, centers.shape[1]))


def weighted_centers(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> Centers:
    """k centres of a few weighted points: seeds by weighted squared distance, the best of some tries at each step, then weighted means; the best of
    ten runs."""
    points, at = np.unique(points, axis=0, return_inverse=True)
    weight = np.maximum(np.bincount(at.ravel(), weight, len(points)), 1e-12)
    if len(points) <= k:
        return points
    best, least, tries = points[:k], np.inf, 2 + int(np.log(k))
    for _ in range(10):
        centers = points[[rng.choice(len(points), p=weight / weight.sum())]]
        d2 = ((points - centers[0]) ** 2).sum(axis=1)
        while len(centers) < k:
            p = weight * d2
            some = points[rng.choice(len(points), tries, p=p / p.sum())]
            left = np.minimum(d2, ((points - some[:, None]) ** 2).sum(axis=2))
            pick = (left @ weight).argmin()
            centers, d2 = np.concatenate([centers, some[[pick]]]), left[pick]
        for _ in range(rounds):
            own = (points @ centers.T - (centers**2).sum(axis=1) / 2).argmax(axis=1)
            n = np.bincount(own, weight, k)
            sums = np.stack([np.bincount(own, weight * x, k) for x in points.T], axis=1)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centers)
        cost = (weight * ((points - centers[(points @ centers.T - (centers**2).sum(axis=1) / 2).argmax(axis=1)]) ** 2).sum(axis=1)).sum()
        if cost < least:
            best, least = centers, cost
    return best


def _matrix(v) -> np.ndarray:
    """The rows of an Arrow array of lists without nulls, all of one length."""
    return np.asarray(v.flatten(), np.float64).reshape(len(v), -1)


def cluster_sums(rows: DataFrame, centers: Centers, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the number and the sum of the rows that are nearest to it, and the sum of all squared distances. Each task sums its rows; k x d
    numbers reach the driver."""
    half = (centers**2).sum(axis=1) / 2
    k, d = centers.shape

    def run(batches):
        n, sums, cost = np.zeros(k), np.zeros((k, d)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            at = np.argmax(x @ centers.T - half, axis=1)
            cost += ((x - centers[at]) ** 2).sum()
            size = np.bincount(at, minlength=k)
            held = np.flatnonzero(size)
            n += size
            sums[held] += np.add.reduceat(x[np.argsort(at, kind="stable")], (np.cumsum(size) - size)[held], axis=0)
        held = np.flatnonzero(n)
        c = np.concatenate([np.repeat(held, d), held, [-1]])
        i = np.concatenate([np.tile(np.arange(d), len(held)), np.full(len(held), d), [0]])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(np.concatenate([sums[held].ravel(), n[held], [cost]]))], names=["c", "i", "x"])

    got = rows.select(vector).where(F.col(vector).isNotNull()).mapInArrow(run, "c int, i int, x double").groupBy("c", "i").agg(F.sum("x").alias("x")).toArrow()
    c, i, x = (got.column(j).to_numpy() for j in range(3))
    both = np.zeros((k, d + 1))
    own = c >= 0
    both[c[own], i[own]] = x[own]
    return both[:, d], both[:, :d], float(x[~own].sum())


def full_passes(rows: DataFrame, centers: Centers, rounds: int = 1, vector: str = "vector") -> Centers:
    """Full passes from given centres; a centre without rows stays."""
    for _ in range(rounds):
        n, sums, _ = cluster_sums(rows, centers, vector)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def mini_batch(centers: Centers, counts: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[Centers, np.ndarray]:
    """Centres and counts after a batch with these sums and sizes per centre: each moves to the batch mean by its share of all rows seen."""
    counts = counts + n
    hit = n > 0
    centers = centers.copy()
    centers[hit] += (sums[hit] / n[hit, None] - centers[hit]) * (n[hit] / counts[hit])[:, None]
    return centers, counts


def reassign(centers: Centers, counts: np.ndarray, batch: DataFrame, starved: float, seed: int, vector: str = "vector") -> tuple[Centers, np.ndarray]:
    """Centres that have seen less than `starved` of what the largest has seen (half of them at most, the emptiest first) go to rows of the
    batch that are far from all others, and count as much as the smallest of the others."""
    weak = np.flatnonzero(counts < starved * counts.max())
    weak = weak[np.argsort(counts[weak], kind="stable")][: len(centers) // 2]
    if not len(weak):
        return centers, counts
    strong = np.setdiff1d(np.arange(len(centers)), weak)
    found = far_rows(batch.where(F.col(vector).isNotNull()), centers[strong], len(weak), seed, vector)
    centers, counts = centers.copy(), counts.copy()
    centers[weak[: len(found)]] = found
    counts[weak[: len(found)]] = counts[strong].min()
    return centers, counts


def mini_batch_fit(rows: DataFrame, k: int, parts: int = 8, seed: int = 42, id_col: str = "unique_id", vector: str = "vector", starved: float = 0.01) -> Centers:
    """One pass without replacement: `parts` batches by a hash of the id, each summed per nearest centre on the cluster. Centres start from the seeds of
    the first batch that has rows; after each batch but the last two, starved ones go elsewhere, see reassign()."""
    at = F.pmod(F.xxhash64(id_col, F.lit(seed + 1)), F.lit(parts))
    centers = counts = None
    for b in range(parts):
        batch = rows.where(at == b)
        if centers is None:
            if batch.where(F.col(vector).isNotNull()).isEmpty():
                continue
            centers = seeds(batch, k, seed, vector=vector)
            counts = np.zeros(len(centers))
        n, sums, _ = cluster_sums(batch, centers, vector)
        centers, counts = mini_batch(centers, counts, sums, n)
        if starved and b < parts - 2:
            centers, counts = reassign(centers, counts, batch, starved, seed + b, vector)
    if centers is None:
        raise ValueError("nothing to train on")
    return centers


def assign(rows: DataFrame, centers: Centers, vector: str = "vector") -> DataFrame:
    """rows with cluster (the nearest centre, ties: the smallest number) and d2; both null where the vector is. The centres travel with the
    function: k x d doubles."""
    from pyspark.sql.functions import pandas_udf

    half = (centers**2).sum(axis=1) / 2

    def nearest(v):
        import pandas as pd

        there = v.notna().to_numpy()
        cluster, d2 = pd.array(np.zeros(len(v), np.int32), dtype="Int32"), pd.array(np.zeros(len(v)), dtype="Float64")
        cluster[~there], d2[~there] = pd.NA, pd.NA
        if there.any():
            x = np.stack(v[there].to_numpy()).astype(np.float64)
            at = np.argmax(x @ centers.T - half, axis=1)
            cluster[there], d2[there] = at.astype(np.int32), ((x - centers[at]) ** 2).sum(axis=1)
        return pd.DataFrame({"cluster": cluster, "d2": d2})

    return rows.withColumn("_a", pandas_udf(nearest, "cluster int, d2 double")(F.col(vector))).select("*", "_a.cluster", "_a.d2").drop("_a")


def assign_native(rows: DataFrame, centers: DataFrame, id_col: str, vector: str = "vector") -> DataFrame:
    """As assign(), with centers a frame (cluster, center), joined as a broadcast of at most k rows, expressions only."""
    table = F.broadcast(centers.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("_c")))
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector), c["center"]).alias("d2"), c["cluster"].alias("cluster"))))
    best = F.when(F.col(vector).isNotNull(), best)
    return rows.crossJoin(table).withColumn("_b", best).select(*rows.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.d2").alias("d2"))


def remaining(rows: DataFrame, done: DataFrame, modality: str | None = None, key: str = "unique_id") -> DataFrame:
    """Rows (with an id) that have no prediction yet."""
    rows = rows if modality is None else rows.where(F.col("modality") == modality)
    return rows.where(F.col(key).isNotNull()).join(done.select(key), key, "left_anti")


def predict_rest(rows: DataFrame, done: DataFrame, centers: Centers, ext: DataFrame | None = None, modality: str = "stained", low: float = 5.0, mid: float = 20.0) -> DataFrame:
    """Predictions for the rows that have none, relabelled by tissue where ext is given; append them to `done` and the next call has none."""
    return predictions(remaining(rows, done, modality), centers, ext, modality, low, mid)


def predictions(rows: DataFrame, centers: Centers, ext: DataFrame | None = None, modality: str = "stained", low: float = 5.0, mid: float = 20.0) -> DataFrame:
    """The rows' clusters, relabelled by tissue where ext is given, in the columns of a table of predictions."""
    got = assign(rows if ext is None else with_tissue(rows, ext, "left", modality), centers)
    if ext is not None:
        got = got.withColumn("cluster", relabel_single(F.col("cluster"), F.col("tissue_percentage"), low, mid))
    return got.select("unique_id", "id", "slide_key", "tile_key", "short_box_name", "box_id", F.col("cluster").cast("int").alias("cluster"))


def covariance(rows: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance, summed per task; what meets on the driver is d x d for each task, merged in a tree."""
    import pandas as pd

    def sums(batches):
        n, s, m = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n, s, m = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if m is None else m + x.T @ x
        if n:
            flat = np.concatenate([[n], s, m.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    flat = rows.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow().column("x").to_numpy()
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean = flat[0], flat[1 : d + 1] / flat[0]
    return int(n), mean, (flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)) * n / max(n - 1, 1)


def pca(rows: DataFrame, components: int | None = None, variance: float | None = None, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (d x n) and their shares of the variance: so many components, or as many as exceed this share of it."""
    n, mean, cov = covariance(rows, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    ratio = values / values.sum()
    if variance is not None:
        components = min(int(np.searchsorted(np.cumsum(ratio), variance, side="right")) + 1, len(values))
    components = min(components or len(values), n, len(values))
    return mean, axes[:, :components], ratio[:components]


def project(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str = "vector", name: str = "projected") -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    def run(v):
        import pandas as pd

        there = v.notna().to_numpy()
        got = iter((np.stack(v[there].to_numpy()).astype(np.float64) - mean) @ axes if there.any() else ())
        return pd.Series([next(got) if x else None for x in there], dtype=object)

    return rows.withColumn(name, pandas_udf(run, "array<double>")(F.col(vector)))


GROUP_ROWS = 100_000  # rows of a cluster that one task sums


def cluster_components(rows: DataFrame, components: int, cluster: str = "cluster", vector: str = "vector") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each cluster the mean and its first principal axes (d x components, fewer where it has fewer rows); a mean and axes a cluster reach the driver.

    The rows of a cluster are dealt to as many tasks as they need, each of which sums their products once; the sums of a cluster, d x d, then meet.
    """
    held = rows.select(F.col(cluster).cast("int").alias("c"), F.col(vector).alias("v")).where("c is not null and v is not null")
    parts = held.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    dealt = held.join(parts, "c").select("c", F.floor(F.rand(7) * F.col("parts")).cast("int").alias("p"), "v")

    def sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column(2))
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["c", "n", "s", "m"])

    def axes(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, 0.0, 0.0
        for batch in batches:
            for count, one, two in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                n, s, m = n + count, s + np.frombuffer(one), m + np.frombuffer(two)
        mean = s / n
        values, vectors = np.linalg.eigh(m.reshape(len(s), len(s)) / n - np.outer(mean, mean))
        top = vectors[:, np.argsort(-values)][:, : min(components, n)]
        top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(top).tobytes()], pa.binary())], names=["c", "mean", "axes"])

    summed = dealt.groupBy("c", "p").applyInArrow(sums, "c int, n long, s binary, m binary")
    found = summed.groupBy("c").applyInArrow(axes, "c int, mean binary, axes binary").collect()  # a model a cluster
    return {r["c"]: (mean, np.frombuffer(r["axes"]).reshape(len(mean), -1)) for r in found for mean in [np.frombuffer(r["mean"])]}


def project_clusters(rows: DataFrame, model: dict[int, tuple[np.ndarray, np.ndarray]], cluster: str = "cluster", vector: str = "vector", name: str = "projected") -> DataFrame:
    """rows with the vector on the axes of its cluster; null where either is missing."""
    from pyspark.sql.functions import pandas_udf

    shared = rows.sparkSession.sparkContext.broadcast(model)  # a mean and axes a cluster

    def run(c, v):
        import pandas as pd

        out: list = [None] * len(v)
        for one in c[v.notna()].dropna().unique():
            if int(one) in shared.value:
                mean, axes = shared.value[int(one)]
                at = np.flatnonzero((c == one).to_numpy() & v.notna().to_numpy())
                for i, x in zip(at, (np.stack(v.iloc[at].to_numpy()).astype(np.float64) - mean) @ axes):
                    out[i] = x.tolist()
        return pd.Series(out, dtype=object)

    return rows.withColumn(name, pandas_udf(run, "array<double>")(F.col(cluster).cast("int"), F.col(vector)))


def sub_clusters(rows: DataFrame, k: int = 5, rounds: int = 10, least: int | None = None, id_col: str = "unique_id", vector: str = "vector", components: int | None = None) -> DataFrame:
    """id, cluster and sub_cluster: k-means inside each cluster, level by level over all clusters at once, so that a cluster of any size is
    never in one task; clusters of fewer than `least` (default k) rows get 0. components: wider vectors are first projected on so many
    principal axes of their own cluster."""
    if components is not None:
        width = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        if width is not None and width[0] > components:
            rows = project_clusters(rows, cluster_components(rows, components, vector=vector), vector=vector, name=vector)
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    part = rows.select(id_col, "cluster", F.col(vector).alias("v")).join(F.broadcast(sizes), "cluster")
    split = part.where(F.col("_n") >= (least or k))
    from pyspark.sql import Window

    first = split.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.md5(F.col(id_col).cast("string"))))).where(F.col("_r") <= k)
    centers = first.select("cluster", (F.col("_r") - 1).alias("sub_cluster"), F.col("v").cast("array<double>").alias("center"))
    near = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col("v"), c["center"]).alias("d2"), c["sub_cluster"].alias("s"))))["s"]
    for _ in range(rounds):
        table = centers.groupBy("cluster").agg(F.collect_list(F.struct("sub_cluster", "center")).alias("_c"))
        near_rows = split.join(F.broadcast(table), "cluster").select(id_col, "cluster", "v", near.alias("sub_cluster"))
        centers = near_rows.sparkSession.createDataFrame(mean_vectors(near_rows, ["cluster", "sub_cluster"], "v").drop("n").collect(), "cluster int, sub_cluster int, center array<double>")  # k rows a cluster
    return near_rows.select(id_col, "cluster", "sub_cluster").unionByName(part.where(F.col("_n") < (least or k)).select(id_col, "cluster", F.lit(0).alias("sub_cluster")))
