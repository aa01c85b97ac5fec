"""Paired vectors: distances, their statistics per cluster, rankings, outliers, agreement of two clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import image_path
from ..functions.lineage import cut
from ..functions.vectors import distance
from .quantiles import percentiles


def align(a: DataFrame, b: DataFrame, key: str = "slide_key", suffixes: tuple[str, str] = ("_chem", "_virt")) -> DataFrame:
    """Inner join on key; other columns get the suffixes."""
    left, right = (d.select(key, *(F.col(c).alias(c + s) for c in d.columns if c != key)) for d, s in zip((a, b), suffixes))
    return left.join(right, key)


def pair_distances(pairs: DataFrame, a: str = "vector_chem", b: str = "vector_virt") -> DataFrame:
    return pairs.withColumn("distance", distance(F.col(a), F.col(b)))


def group_stats(rows: DataFrame, group: str | list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, percentiles and deviation of each group's values.

    Values are computed once: what follows filters them, and a filter on a distance would be moved into the join that pairs the vectors, where it
    counts as a condition between the two sides and has the optimiser pair each vector with each other one.
    """
    by, v = [group] if isinstance(group, str) else group, F.col(value)
    rows = cut(rows.select(*by, value))
    whole = rows.groupBy(*by).agg(F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_samp(v), digits).alias("std"))
    got = _with_percentiles(whole, rows, by, value, [0.5, 0.75, 0.9, 0.99])
    return got.select(*by, "mean", *(F.round(F.get("q", i), digits).alias(n) for i, n in enumerate(("median", "p75", "p90", "p99"))), "std")


def _with_percentiles(groups: DataFrame, rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """groups with q, null where a group has no value."""
    own = {c: f"_group{i}" for i, c in enumerate(by)}
    q = percentiles(rows, by, value, shares).select(*(F.col(c).alias(n) for c, n in own.items()), "q")
    return groups.join(q, [F.col(c).eqNullSafe(F.col(n)) for c, n in own.items()], "left").drop(*own.values())


def std_ratio_ranking(stats: DataFrame, by: list[str], cluster: str, n: int) -> DataFrame:
    """The n clusters per group with the largest deviation for their mean; means up to 1e-6 have no ratio."""
    ratio = stats.withColumn("std_ratio", F.round(F.when(F.col("mean") > 1e-6, F.col("std") / F.col("mean")), 6)).where("std_ratio is not null")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("std_ratio"), F.asc(cluster)))
    return ratio.withColumn("rank", rank).where(F.col("rank") <= n)


def std_difference(a: DataFrame, b: DataFrame, cluster: str, n: int) -> DataFrame:
    """The n clusters whose deviations differ most between the two."""
    got = a.select(cluster, F.col("std").alias("std_a")).join(b.select(cluster, F.col("std").alias("std_b")), cluster)
    return got.withColumn("difference", F.round(F.abs(F.col("std_a") - F.col("std_b")), 6)).orderBy(F.desc("difference"), F.asc(cluster)).limit(n)


def outliers(rows: DataFrame, group: str, value: str, width: float = 1.5) -> DataFrame:
    """Per group its quartiles, its rows, and those beyond `width` times the quartile range outside of them."""
    q = _with_percentiles(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), rows, [group], value, [0.25, 0.75])
    q = q.select(F.col(group).alias("_group"), "n", F.get("q", 0).alias("q1"), F.get("q", 1).alias("q3"))
    low, high = F.col("q1") - width * (F.col("q3") - F.col("q1")), F.col("q3") + width * (F.col("q3") - F.col("q1"))
    flagged = rows.select(group, value).join(q, F.col(group).eqNullSafe(F.col("_group")))
    return flagged.groupBy(group, "n", "q1", "q3").agg(F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("outliers"))


def top_outlier_groups(counts: DataFrame, group: str, share: float = 0.2) -> DataFrame:
    """counts with is_top for the share of groups with the most outliers."""
    all_ = Window.partitionBy()  # a row per group
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("outliers"), F.asc(group)))
    return counts.withColumn("is_top", rank <= F.floor(F.count(F.lit(1)).over(all_) * share))


def mismatch_matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("count")).withColumn("mismatch", F.col(a) != F.col(b))


def image_metrics(rows: DataFrame, a: str, b: str, peak: float = 255.0, digits: int = 6) -> DataFrame:
    """rows with mse and psnr of two arrays of values; null where lengths differ."""
    n = F.size(a)
    mse = F.when(n == F.size(b), F.try_divide(F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), n))
    return rows.withColumn("mse", F.round(mse, digits)).withColumn("psnr", F.round(F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)), digits))


def ssim(rows: DataFrame, a: str, b: str, width: int, window: int = 7, peak: float = 255.0) -> DataFrame:
    """rows with ssim of two arrays of values as images of `width` columns: the mean over square windows, uniform weights."""
    import numpy as np
    from pyspark.sql.functions import pandas_udf

    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2

    def one(p, q) -> float | None:
        if p is None or q is None or len(p) != len(q) or len(p) % width or min(width, len(p) // width) < window:
            return None
        x, y = (np.lib.stride_tricks.sliding_window_view(np.asarray(v, float).reshape(-1, width), (window, window)) for v in (p, q))
        mx, my = x.mean((2, 3)), y.mean((2, 3))
        n = window * window
        vx, vy, cxy = x.var((2, 3)) * n / (n - 1), y.var((2, 3)) * n / (n - 1), ((x * y).mean((2, 3)) - mx * my) * n / (n - 1)
        return float(((2 * mx * my + c1) * (2 * cxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())

    def run(ps, qs):
        import pandas as pd

        return pd.Series([one(p, q) for p, q in zip(ps, qs)], dtype=float)

    return rows.withColumn("ssim", pandas_udf(run, "double")(F.col(a), F.col(b)))


def cluster_pairs(stained: DataFrame, virtual: DataFrame, key: str = "slide_key") -> DataFrame:
    """key, cluster_stained and cluster_virtual of what both assign."""
    return stained.select(key, F.col("cluster").alias("cluster_stained")).join(virtual.select(key, F.col("cluster").alias("cluster_virtual")), key)


def with_clusters(pairs: DataFrame, stained: DataFrame, virtual: DataFrame, key: str = "slide_key") -> DataFrame:
    """Pairs of vectors with both their clusters; pairs that lack one are left out."""
    return pairs.join(cluster_pairs(stained, virtual, key), key)


def query_split(rows: DataFrame, most: int | None = None, key: str = "slide_key", query: str = "__query__") -> DataFrame:
    """All rows with is_query; of the others `most` at most, by a hash of their key."""
    from .sampling import hashed_sample

    mine = F.coalesce(F.col(key) == query, F.lit(False))
    others = rows.where(~mine)
    others = others if most is None else hashed_sample(others, key, most)
    return others.withColumn("is_query", F.lit(False)).unionByName(rows.where(mine).withColumn("is_query", F.lit(True)))


def paired_grid(pairs: DataFrame, n: int, prefix: str, key: str = "slide_key", cluster: str = "cluster") -> DataFrame:
    """The cells of each cluster's grid: n pairs by a hash of their key, numbered from 1, with the paths of the stained and the virtual image."""
    from .sampling import draw_order, per_group_sample

    some = per_group_sample(pairs.where(F.col(cluster).isNotNull()), cluster, key, n)
    cell = F.row_number().over(Window.partitionBy(cluster).orderBy(draw_order(key), F.col(key)))
    return some.select(cluster, cell.alias("cell"), key, image_path(prefix, "stained").alias("stained"), image_path(prefix, "virtual").alias("virtual"))


def components_with_query(rows: DataFrame, n: int = 3, most: int | None = None, key: str = "slide_key", query: str = "__query__", vector: str = "vector") -> DataFrame:
    """The query's row and the others (`most` at most) in one frame, on the first n principal components of them all: key, is_query, pc1 ... pcn."""
    from . import kmeans

    both = query_split(rows.where(F.col(vector).isNotNull()), most, key, query)
    mean, axes, _ = kmeans.pca(both, n, vector=vector)
    got = kmeans.project(both, mean, axes, vector, "_p")
    return got.select(key, "is_query", *(F.get("_p", i).alias(f"pc{i + 1}") for i in range(axes.shape[1])))
