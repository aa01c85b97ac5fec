"""Choosing the number of clusters: metrics at fixed labels, elbow, knee, best k, comparisons of models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import distance, mean_vectors, squared_distance


def cluster_metrics(rows: DataFrame, cluster: str = "cluster", vector: str = "vector", digits: int = 6) -> DataFrame:
    """One row: n, k, inertia, calinski_harabasz, davies_bouldin. Centres are the labels' means; the centre table has k rows."""
    centers = mean_vectors(rows, [cluster], vector)
    mean = F.broadcast(mean_vectors(rows.withColumn("_g", F.lit(0)), ["_g"], vector, "mu").select("mu", F.col("n").alias("total")))
    spread = rows.join(F.broadcast(centers), cluster).select(cluster, squared_distance(F.col(vector), F.col("center")).alias("d2")).groupBy(cluster).agg(F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("s"))
    by = centers.join(spread, cluster).crossJoin(mean).withColumn("between", F.col("n") * squared_distance(F.col("center"), F.col("mu")))
    k = F.count(F.lit(1))
    totals = by.agg(F.max("total").alias("n"), k.alias("k"), F.sum("within").alias("inertia"), (F.sum("between") / (k - 1) / (F.sum("within") / (F.max("total") - k))).alias("chi"))
    small = by.select(F.col(cluster).alias("c"), "center", "s")
    other = small.select(F.col("c").alias("c2"), F.col("center").alias("center2"), F.col("s").alias("s2"))
    worst = small.crossJoin(F.broadcast(other)).where("c <> c2").groupBy("c").agg(F.max((F.col("s") + F.col("s2")) / distance(F.col("center"), F.col("center2"))).alias("r"))
    dbi = worst.agg(F.avg("r").alias("dbi"))
    return totals.crossJoin(dbi).select("n", "k", F.round("inertia", digits).alias("inertia"), F.round("chi", digits).alias("calinski_harabasz"), F.round("dbi", digits).alias("davies_bouldin"))


def silhouette(rows: DataFrame, id_col: str, cluster: str = "cluster", vector: str = "vector", max_rows: int = 5_000, digits: int = 6) -> DataFrame:
    """Mean silhouette over the max_rows rows with the smallest hashes of their id (it compares all pairs of them)."""
    from .sampling import hashed_sample

    sample = hashed_sample(rows, id_col, max_rows).select(F.col(id_col).alias("i"), F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    other = F.broadcast(sample.select(F.col("i").alias("j"), F.col("c").alias("c2"), F.col("v").alias("v2")))
    to = sample.crossJoin(other).where("i <> j").groupBy("i", "c", "c2").agg(F.avg(distance(F.col("v"), F.col("v2"))).alias("d"))
    ab = to.groupBy("i", "c").agg(F.min(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.round(F.avg(one), digits).alias("silhouette"))


def block_pairs(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows dealt to the pairs p <= q of n blocks (by a hash of key), with s, the side they are on: two rows meet in one pair of blocks, each row is in n."""
    return pairs_of_blocks(rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n)


def pairs_of_blocks(rows: DataFrame, n: int) -> DataFrame:
    """The same by the block in _b."""
    spread = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.select("*", F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), (F.col("_b") > F.col("_o")).cast("int").alias("s")).drop("_b", "_o")


class Side:
    """One side of a pair of blocks: rows ordered by cluster c, with weights w, the weight m of all rows of their cluster, and vectors v.

    Rows are cut into pieces (low, high, clusters, their starts) of `tile` rows at most: rows of one cluster (no starts), or small clusters that lie
    in the piece with all their rows of all blocks. Of those a row keeps the least mean distance only, of the others the sum of distances to each.
    """

    def __init__(self, c, w, m, v, centre, tile: int):
        self.c, self.w, self.v = c, w, v
        self.kinds, first, self.at = np.unique(c, return_index=True, return_inverse=True)
        self.m = m[first]
        self.whole = np.add.reduceat(w, first) == self.m
        self.own, self.least, self.sums = np.zeros(len(c)), np.full(len(c), np.nan), {}
        near = v - centre
        self.norms = np.einsum("ij,ij->i", near, near)
        self.factor = np.column_stack([near, np.ones(len(c)), self.norms])
        self.pieces, many = [], []

        def close():
            if many:
                starts = np.array([low for _, low, _ in many])
                self.pieces.append((many[0][1], many[-1][2], [kind for kind, _, _ in many], starts - starts[0]))
                many.clear()

        for kind, (low, high) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(c)])):
            small = self.whole[kind] and high - low <= tile
            if many and (not small or high - many[0][1] > tile):
                close()
            if small:
                many.append((kind, low, high))
            else:
                cuts = np.linspace(low, high, -(-(high - low) // tile) + 1).astype(int).tolist()
                self.pieces += [(x, y, [kind], None) for x, y in zip(cuts, cuts[1:])]
        close()

    def add(self, at: slice, d, to: Side, piece, itself: bool = False) -> None:
        """The distances d of the rows `at` to those of a piece of the other side."""
        low, high, kinds, starts = piece
        if starts is None:
            self.sums.setdefault(kinds[0], np.zeros(len(self.c)))[at] += d @ to.w[low:high].astype(np.float64)
            return
        sums = np.add.reduceat(d * to.w[low:high], starts, axis=1)
        mean = sums / to.m[kinds]
        if itself:
            rows, mine = np.arange(high - low), self.at[at] - kinds[0]
            self.own[at], mean[rows, mine] = sums[rows, mine], np.nan
        self.least[at] = np.fmin(self.least[at], np.fmin.reduce(mean, axis=1))

    def told(self, i, to: Side):
        """Rows (i, w, c2, own, d, n, b): of clusters that other blocks hold too, and of the row's own, the sum of distances d to n rows; of all others the least mean b."""
        import pyarrow as pa

        within, none = to is self, np.zeros(len(i), bool)
        for kind, d in self.sums.items():
            mine = self.c == to.kinds[kind]
            if to.whole[kind]:
                self.own = np.where(mine, d, self.own)
                self.least = np.where(mine, self.least, np.fmin(self.least, d / to.m[kind]))
        parts = [(to.m[kind] - (self.c == to.kinds[kind]), np.full(len(i), to.kinds[kind]), self.c == to.kinds[kind], d, None) for kind, d in self.sums.items() if not to.whole[kind]]
        if within:
            parts.append((np.where(self.whole[self.at], self.m[self.at] - 1, 0), self.c, ~none, self.own, None))
        parts.append((to.whole.sum() - (self.whole[self.at] & within), None, none, None, self.least))
        for n, c2, own, d, b in parts:
            rows = np.flatnonzero(n > 0)
            columns = ((i, "int64"), (self.w, "int64"), (c2, "int64"), (own, "bool"), (d, "float64"), (n, "int64"), (b, "float64"))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.type_for_alias(t)) if x is None else pa.array(x[rows], pa.type_for_alias(t)) for x, t in columns], ["i", "w", "c2", "own", "d", "n", "b"])


def meet(x: Side, y: Side, near: float = 1e-6) -> None:
    """Adds the distances between x and y (or within x) to the sums of both, a tile that fits the cache at a time.

    Squared distances are a product of matrices, of vectors less a centre. Those below `near` of their squared norms, where the product loses digits
    (copies get 0), and those that aren't finite are taken from the differences.
    """
    held, turned, dim = np.empty(max(h - g for g, h, *_ in x.pieces) * max(h - g for g, h, *_ in y.pieces)), np.ascontiguousarray(y.factor.T), x.v.shape[1]
    finite = x.norms.max() + y.norms.max() < 1e300
    for at, one in enumerate(x.pieces):
        low, high = one[:2]
        norms = x.norms[low:high, None]
        factor = np.column_stack([-2 * x.factor[low:high, :dim], norms, np.ones(high - low)])
        for to, two in enumerate(y.pieces):
            if x is y and to < at:
                continue
            left, right = two[:2]
            d = held[: (high - low) * (right - left)].reshape(high - low, right - left)
            np.matmul(factor, turned[:, left:right], out=d)
            if not (finite and d.min() > near * (norms.max() + y.norms[left:right].max())):
                close = ~((d > near * (norms + y.norms[left:right])) & (d < np.inf))
                if close.sum() > d.size // 8:  # as within a narrow cluster: less the tile's own centre most keep their digits
                    centre = x.v[low:high].mean(axis=0)
                    a, b = x.v[low:high] - centre, y.v[left:right] - centre
                    na, nb = np.einsum("ij,ij->i", a, a)[:, None], np.einsum("ij,ij->i", b, b)
                    np.matmul(-2 * a, b.T, out=d)
                    d += na
                    d += nb
                    close = ~((d > near * (na + nb)) & (d < np.inf))
                rows, columns = np.nonzero(close)
                for few in range(0, len(rows), 16_384):
                    r, c = rows[few : few + 16_384], columns[few : few + 16_384]
                    gap = x.v[low + r] - y.v[left + c]
                    d[r, c] = np.einsum("ij,ij->i", gap, gap)
            np.sqrt(d, out=d)
            itself = x is y and at == to
            x.add(slice(low, high), d, y, two, itself)
            if not itself:
                y.add(slice(left, right), d.T, x, one)


def compared(batches):
    """The rows of pairs of blocks (t, s, i, c, w, m, v), a pair in one partition, as rows of Side.told()."""
    import pyarrow as pa

    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    del batches
    lists = table["v"].chunk(0)
    long = np.unique(lists.value_lengths().to_numpy())
    if len(long) != 1:
        raise ValueError(f"vectors of different lengths: {long[:5].tolist()}")
    vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    t, s, i, c, w, m = (table[name].to_numpy() for name in ("t", "s", "i", "c", "w", "m"))
    order = np.lexsort((i, c, s, t))
    with np.errstate(all="ignore"):
        for pair in np.unique(t):
            both = order[t[order] == pair]
            within = table["within"][int(both[0])].as_py()
            x, y = both[s[both] == 0], both[s[both] == 1]
            if not len(x) or not (within or len(y)):
                continue
            centre = vectors[x].astype(np.float64)
            centre = centre[np.isfinite(centre).all(axis=1)].sum(axis=0) / len(x)
            centre = np.where(np.isfinite(centre), centre, 0.0)
            side = lambda rows, tile: Side(c[rows], w[rows], m[rows], vectors[rows].astype(np.float64), centre, tile)
            one = side(x, 512 if within else 256)
            two = one if within else side(y, 1024)
            meet(one, two)
            yield from one.told(i[x], two)
            if not within:
                yield from two.told(i[y], one)


def silhouette_of_all(rows: DataFrame, id_col: str, cluster: str = "cluster", vector: str = "vector", digits: int = 6, block_rows: int = 32_768) -> DataFrame:
    """Mean silhouette over all rows: all pairs are compared, a block of rows with another in one task, which gives the sums of distances by cluster.

    Rows whose cluster has no other row, or with no second cluster, count as 0, as do rows without cluster or vector, which no row is compared with;
    rows without id don't count. ids are unique, vectors of one length. Equal vectors of a cluster are one row with a weight. Blocks follow the
    clusters, so a pair of blocks tells a few numbers a row, however many clusters there are; each row is sent to as many tasks as there are blocks,
    its vector as it is stored.
    """
    rows = rows.where(F.col(id_col).isNotNull())
    count = rows.count()
    own = rows.select(F.col(cluster).cast("long").alias("c"), F.col(vector).alias("v")).where("c is not null and v is not null")
    own = cut(own.groupBy("c", "v").agg(F.count(F.lit(1)).alias("w")).withColumn("i", F.monotonically_increasing_id()))
    classes = own.count()
    n = max(1, -(-classes // block_rows), min(8, classes // 1024))
    by = own.groupBy("c").agg(F.count(F.lit(1)).alias("_u"), F.sum("w").alias("m"))
    by = by.withColumn("_low", F.sum("_u").over(Window.orderBy("c")) - F.col("_u"))  # a row per cluster
    placed = own.join(by, "c").withColumn("_b", F.expr(f"cast((_low + pmod(xxhash64(i), _u)) * {n} div {max(1, classes)} as int)"))
    dealt = pairs_of_blocks(placed.drop("_low", "_u"), n).withColumn("t", F.expr("cast(q * (q + 1) div 2 + p as int)")).withColumn("within", F.expr("p = q")).drop("p", "q")
    sums = dealt.repartitionById(n * (n + 1) // 2, F.col("t")).mapInArrow(compared, "i long, w long, c2 long, own boolean, d double, n long, b double")
    to = sums.groupBy("i", "w", "c2", "own").agg((F.sum("d") / F.max("n")).alias("d"), F.min("b").alias("b"))
    ab = to.groupBy("i", "w").agg(F.min(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.coalesce("d", "b"))).alias("b"))
    most = F.greatest("a", "b")
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(most == 0, float("nan")).otherwise((F.col("b") - F.col("a")) / most)
    return ab.agg(F.when(F.lit(count > 1), F.round(F.coalesce(F.sum(F.col("w") * one), F.lit(0.0)) / F.lit(max(1, count)), digits)).alias("silhouette"))


def elbow(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Per model the k after which the inertia's second difference is largest (first of equals); with fewer than three points the first k."""
    w = Window.partitionBy(by).orderBy("k")
    d2 = metrics.withColumn("d2", F.lead("inertia").over(w) - 2 * F.col("inertia") + F.lag("inertia").over(w))
    return d2.groupBy(by).agg(F.coalesce(F.min_by("k", F.when(F.col("d2").isNotNull(), F.struct(-F.col("d2"), F.col("k")))), F.min("k")).alias("elbow_k"))


def inertia_rates(metrics: DataFrame, by: str = "model", digits: int = 6) -> DataFrame:
    """inertia_norm, against the model's smallest k, and inertia_roc, the relative change per step of k in percent."""
    w = Window.partitionBy(by).orderBy("k")
    change = F.abs(F.col("inertia") / F.lag("inertia").over(w) - 1) / (F.col("k") - F.lag("k").over(w)) * 100
    return metrics.select(by, "k", F.round(F.col("inertia") / F.first("inertia").over(w), digits).alias("inertia_norm"), F.round(change, digits).alias("inertia_roc"))


def best_k(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Per model and metric the best k: largest Calinski-Harabasz and silhouette, smallest Davies-Bouldin; missing values don't count."""
    long = metrics.unpivot([by, "k"], ["calinski_harabasz", "davies_bouldin", "silhouette"], "metric", "score").where("score is not null")
    sign = F.when(F.col("metric") == "davies_bouldin", 1).otherwise(-1)
    got = long.groupBy(by, "metric").agg(F.min_by(F.struct("k", "score"), F.struct(sign * F.col("score"), F.col("k"))).alias("b"))
    return got.select(by, "metric", F.col("b.k").alias("best_k"), F.col("b.score").alias("score"), F.when(F.col("metric") == "davies_bouldin", "min").otherwise("max").alias("direction"))


def consensus(proposals: DataFrame, run: str = "run_name", column: str = "k") -> DataFrame:
    """The most proposed k (smallest of equals), the median as a whole number, and how many differ."""
    n = proposals.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    mode = n.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode_k"), F.count(F.lit(1)).alias("distinct_k"))
    return mode.crossJoin(proposals.agg(F.floor(F.median(column)).cast("int").alias("median_k"), F.count(F.lit(1)).alias("proposals")))


def knee(k: list[float], inertia: list[float], sensitivity: float = 1.0) -> float | None:
    """The knee of a falling convex curve: the first local maximum of its distance from the chord (normalised) that the curve then falls
    below by a margin before the next one; None if there is none. A curve has a point for each k tried."""
    x, y = np.asarray(k, float), np.asarray(inertia, float)
    order = np.argsort(x)
    x, y = x[order], y[order]
    if len(x) < 3 or x[0] == x[-1] or y.max() == y.min():
        return None
    gap = 1 - (y - y.min()) / (y.max() - y.min()) - (x - x[0]) / (x[-1] - x[0])
    margin = sensitivity * np.diff((x - x[0]) / (x[-1] - x[0])).mean()
    peaks = [i for i in range(1, len(x) - 1) if gap[i] >= gap[i - 1] and gap[i] > gap[i + 1]]
    for i, until in zip(peaks, [*peaks[1:], len(x)]):
        if (gap[i + 1 : until] < gap[i] - margin).any():
            return float(x[i])
    return None


METRICS = "n long, k int, inertia double, calinski_harabasz double, davies_bouldin double, silhouette double"


def sweep(rows: DataFrame, ks: list[int], id_col: str, with_silhouette: bool = True, components: int | None = None, max_silhouette_rows: int = 5_000) -> DataFrame:
    """A row of metrics for each k, from models fitted on all rows; one row a k comes to the driver."""
    from . import kmeans

    if components:
        mean, axes, _ = kmeans.pca(rows, components)
        rows = kmeans.project(rows, mean, axes, name="vector2").drop("vector").withColumnRenamed("vector2", "vector")
    rows = rows.select(id_col, "vector").where("vector is not null").persist()
    out = []
    try:
        for k in ks:
            labelled = kmeans.assign(rows, kmeans.fit(rows, k))
            got = cluster_metrics(labelled).first()
            score = silhouette(labelled, id_col, max_rows=max_silhouette_rows).first()[0] if with_silhouette else None
            out.append((got["n"], k, got["inertia"], got["calinski_harabasz"], got["davies_bouldin"], score))
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame(out, METRICS)


def sweep_conditions(rows: DataFrame, ks: list[int], id_col: str, least_tissue: float = 20.0, components: int | None = None) -> DataFrame:
    """sweep() over all rows, and over those with enough tissue (unknown counts as 100), with condition."""
    tissue = F.coalesce(F.col("tissue_percentage"), F.lit(100.0))
    conditions = {"filtered": rows.where(tissue >= least_tissue), "unfiltered": rows}
    out = None
    for name, part in conditions.items():
        one = sweep(part, ks, id_col, False, components).withColumn("condition", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def condition_clusters(rows: DataFrame, ks: list[int], id_col: str, least_tissue: float = 20.0, components: int | None = None) -> DataFrame:
    """The clusters behind sweep_conditions(), as grids show them: id, condition, k, label (of the model) and cluster (relabelled by tissue, unknown
    as 100)."""
    from . import kmeans
    from .tissue import relabel_single

    tissue = F.coalesce(F.col("tissue_percentage"), F.lit(100.0))
    out = None
    for name, part in {"filtered": rows.where(tissue >= least_tissue), "unfiltered": rows}.items():
        part = part.select(id_col, "tissue_percentage", "vector").where("vector is not null")
        if components:
            mean, axes, _ = kmeans.pca(part, components)
            part = kmeans.project(part, mean, axes, name="vector2").drop("vector").withColumnRenamed("vector2", "vector")
        held = part.select("vector").persist()  # for the passes of training
        try:
            models = [(k, kmeans.fit(held, k)) for k in ks]
        finally:
            held.unpersist()
        for k, centers in models:
            labelled = kmeans.assign(part, centers)
            one = labelled.select(id_col, F.lit(name).alias("condition"), F.lit(k).alias("k"), F.col("cluster").alias("label"), relabel_single(F.col("cluster"), F.col("tissue_percentage")).alias("cluster"))
            out = one if out is None else out.unionByName(one)
    return out


def grid(spark, preprocessing: list[str], apply_pca: list[bool], min_samples: list[int], modality: str = "stained-sr") -> DataFrame:
    """A row for each combination of options, with the name of its run."""
    one = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    got = one("preprocessing", preprocessing, "string").crossJoin(one("apply_pca", apply_pca, "boolean")).crossJoin(one("min_samples", min_samples, "int"))
    return got.withColumn("run_name", F.concat(F.lit(modality.replace("-", "_") + "_"), "preprocessing", F.lit("_pca"), F.col("apply_pca").cast("int").cast("string"), F.lit("_min"), F.col("min_samples").cast("string")))


def grid_search(rows: DataFrame, ks: list[int], id_col: str, cls: str, preprocessing: list[str], apply_pca: list[bool], min_samples: list[int], modality: str = "stained-sr", components: int = 16, most: int = 10_000_000) -> DataFrame:
    """sweep() for each combination of options, over a sample of min_samples rows of each class, `most` in all; with run_name. Combinations
    without enough rows for the largest k are left out."""
    from .sampling import greedy_sample

    out = None
    for c in grid(rows.sparkSession, preprocessing, apply_pca, min_samples, modality).orderBy("run_name").collect():  # a row per combination
        part = greedy_sample(rows.where((F.col("modality") == modality) & (F.col("preprocessing") == c["preprocessing"])), cls, id_col, c["min_samples"], most)
        if len(part.select(id_col).take(max(ks))) < max(ks):
            continue
        one = sweep(part, ks, id_col, False, components if c["apply_pca"] else None).withColumn("run_name", F.lit(c["run_name"]))
        out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], METRICS + ", run_name string") if out is None else out


def rank_runs(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Per run the elbow, the k of the best Calinski-Harabasz and Davies-Bouldin scores (0 where missing), how far elbow and Davies-Bouldin are
    apart, and its rank by that; ties by name."""
    best = best_k(metrics, by).where("metric <> 'silhouette'").groupBy(by).pivot("metric", ["calinski_harabasz", "davies_bouldin"]).agg(F.first("best_k"))
    got = elbow(metrics, by).join(best, by, "left").select(by, F.col("elbow_k").alias("elbow"), F.col("calinski_harabasz").alias("ch"), F.col("davies_bouldin").alias("db"))
    got = got.withColumn("elbow_db_diff", F.abs(F.coalesce("elbow", F.lit(0)) - F.coalesce("db", F.lit(0))))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("elbow_db_diff", by)))  # a row per run
