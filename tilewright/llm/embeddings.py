"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, and a rerank by exact cosine.

Iterative quantisation learns, on a bounded sample, rotations that bring the centred principal components close to the corners of a cube, so
that their signs are balanced binary codes in which close vectors differ in few bits. The codes are cut into substrings, one table each; two
vectors are candidates if they agree in a whole substring. Length and number of the substrings are planned on pairs made from the sample that lie
at the threshold exactly, half of them apart in the directions in which the sample's own vectors differ: centring widens the angles of vectors
with a large common mean, so that the angle alone doesn't tell how many bits differ. Every candidate pair is judged by the cosine of the original
vectors in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_sample
from .graph import components, link
from .tokens import mixed


@dataclass
class Quantiser:
    mean: np.ndarray
    axes: list[np.ndarray]  # of each rotation: dimensions x bits
    bits: int  # of a substring
    tables: int

    def keys(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A key for each unit vector and table; vectors of different groups get different keys (but for chance)."""
        key = np.zeros((len(x), self.tables), np.int64)
        if self.bits:
            code = np.concatenate([(x - self.mean) @ a > 0 for a in self.axes], axis=1)
            parts = code[:, : self.tables * self.bits].reshape(len(x), self.tables, self.bits)
            key = parts @ (1 << np.arange(self.bits, dtype=np.int64))
        return key ^ ((group.astype(np.int64) << np.int64(self.bits)) & np.int64(0x7FFFFFFFFFFFFFFF))[:, None]


MOST_TABLES = 64


def pairs_at(sample: np.ndarray, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two sides of n pairs at the cosine exactly: a vector of the sample, moved towards another one or in any direction."""
    x = sample[rng.integers(0, len(sample), n)]
    way = np.where((np.arange(n) % 2 == 0)[:, None], sample[rng.integers(0, len(sample), n)] - x, rng.standard_normal(x.shape))
    way -= (way * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(way, axis=1)
    ok = size > 1e-9
    return x[ok], cosine * x[ok] + math.sqrt(1 - cosine * cosine) * way[ok] / size[ok, None]


def fit_quantiser(sample: np.ndarray, n: int, cosine: float, recall: float, rounds: int = 30, seed: int = 1, pairs: int = 10_000) -> Quantiser:
    """sample: unit vectors; n: of how many vectors it is a sample.

    Substrings have the most bits, up to about log2(n / 4), for which MOST_TABLES tables lose no more of the pairs at the threshold than the
    recall allows; with none, there is one table in which all vectors meet.
    """
    mean = sample.mean(axis=0)
    x = sample - mean
    values, vectors = np.linalg.eigh(x.T @ x)
    width = min(x.shape[1], 64)
    pca = vectors[:, np.argsort(-values)[:width]]
    v, axes, rng = x @ pca, [], np.random.default_rng(seed)
    p, q = (s - mean for s in pairs_at(sample, cosine, pairs, rng))
    agree = np.zeros((len(p), 0), bool)
    for bits in range(min(30, max(8, math.ceil(math.log2(max(n, 2))) - 2)), 0, -1):
        met = np.zeros(len(p), bool)
        for tables in range(1, MOST_TABLES + 1):
            while len(axes) * width < bits * tables:
                r = np.linalg.qr(rng.standard_normal((width, width)))[0]
                for _ in range(rounds):
                    u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                    r = (u @ w).T
                axes.append(pca @ r)
                agree = np.concatenate([agree, (p @ axes[-1] > 0) == (q @ axes[-1] > 0)], axis=1)
            met |= agree[:, (tables - 1) * bits : tables * bits].all(axis=1)
            if (~met).sum() <= (1 - recall) * len(met) / 2:
                return Quantiser(mean, axes[: -(-bits * tables // width)], bits, tables)
            if tables == 16 and met.mean() < 0.9:  # hopeless at this length
                break
    return Quantiser(mean, [], 0, 1)


def _rows(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, in double precision; those given in it are scaled by powers of two, so that no product of theirs overflows."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if kind == "<f8" else x


def near_vectors(rows: DataFrame, cosine: float = 0.98, recall: float = 0.9995, max_train_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of rows: vec_id, n_links, component_id and kept.

    Vectors are linked if their labels are equal and not null and their cosine is at least `cosine`. Null vectors, zero vectors and those with
    null or non-finite components, and vectors with a null label, link with nothing; so do vectors of different lengths. Equal vectors of a
    label count as rows each but are compared once. Repeated rows are rows of their own: each counts as a link of the others. An empty table
    gives an empty one; other columns are ignored. Vectors of floats are held as such, all others as doubles; cosines are of doubles. A row without an
    id is kept if none of its group has one. The sample is max_train_rows vectors, by a hash.
    """
    kind, held = ("<f4", "array<float>") if dict(rows.dtypes)[vector_col] == "array<float>" else ("<f8", "array<double>")
    flat = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(held).alias("v"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    flat = flat.withColumn("v", F.when(good, F.col("v")))
    classes = flat.where("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "label", "v", "copies", "first"))
    picked = classes.join(F.broadcast(hashed_sample(classes.select("id"), "id", max_train_rows)), "id").select("first", "v").toArrow().sort_by("first")
    sizes = {len(x) for x in picked.column("v").to_pylist()}
    n = classes.count()
    alone = flat.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    models = {}
    for d in sorted(sizes):
        x = _rows([np.array(v, kind).tobytes() for v in picked.column("v").to_pylist() if len(v) == d], kind)
        models[d] = fit_quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), n, cosine, recall)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def encode(batches):
        for b in batches:
            lists, group = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            flat_v = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            start = np.cumsum(size) - size
            tables = max(m.tables for m in shared.value.values())
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)[:, None] * np.uint64(tables) + np.arange(tables, dtype=np.uint64)
            keys = mixed(own).view(np.int64)  # where a length has fewer tables: a key that no other vector has
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _rows([flat_v[s : s + d].tobytes() for s in start[at]], kind)
                if d in shared.value:
                    k = shared.value[d].keys(x / np.linalg.norm(x, axis=1, keepdims=True), group[at] ^ d)
                    keys[at, : k.shape[1]] = k
                else:  # a length that the sample lacks: one bucket for each label and length
                    keys[at] = (group[at] ^ (d << 40))[:, None] | np.int64(1 << 62)
            vec = pa.array([flat_v[s : s + d].tobytes() for s, d in zip(start, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64())), b.column(2), vec], names=["id", "copies", "keys", "grp", "vec"])

    payload = cut(classes.select("id", "v", F.xxhash64(F.col("label").cast("string"), F.size("v")).alias("grp"), "copies").mapInArrow(encode, "id long, copies long, keys array<long>, grp long, vec binary"))

    def blocks(a: list, b: list) -> np.ndarray:
        ok = a[0].to_numpy()[:, None] == b[0].to_numpy()[None, :]
        x, y = a[1].to_pylist(), b[1].to_pylist()
        for d in {len(v) for v in x} & {len(v) for v in y}:
            i, j = np.flatnonzero([len(v) == d for v in x]), np.flatnonzero([len(v) == d for v in y])
            p, q = (_rows([s[k] for k in at], kind) for s, at in ((x, i), (y, j)))
            ok[np.ix_(i, j)] &= p @ q.T >= cosine * np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return ok

    def pairs(a: list, b: list) -> np.ndarray:
        same = a[0].to_numpy() == b[0].to_numpy()
        close = [len(p) == len(q) and (u := _rows([p], kind)[0]) @ (w := _rows([q], kind)[0]) >= cosine * np.sqrt(u @ u) * np.sqrt(w @ w) for p, q in zip(a[1].to_pylist(), b[1].to_pylist())]
        return same & np.array(close, bool)

    counts, edges = link(payload, pairs, blocks, ["grp", "vec"])
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(edges)
    named = classes.select("id", "first", "copies", "label", "v").join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    linked = flat.join(named, ["label", "v"], "left")
    return linked.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
