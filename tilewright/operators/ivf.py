"""Nearest neighbours by cosine from a persisted inverted-list index: coarse centres, product-quantised residuals, files partitioned by list.

A search reads the codes of the probed lists only (whole files are pruned), scores them by table look-ups, and compares the best candidates' own vectors.
Each row also keeps how far its code is from it, and each list how far its rows reach, so a search can be made exact: rows whose bound can't
beat the neighbours found are left out, and nothing else is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm

#: Numbers of the training sample (64 MB as floats), and of scores that a task holds at a time.
TRAIN_NUMBERS, SCORES = 1 << 24, 1 << 22
#: Rows that probed lists hold for each candidate.
FILL = 4
#: What bounds are widened by, for sums in single precision.
SLACK = 1e-4


@dataclass
class Model:
    """centers: the lists' unit vectors; books: for each range of components its code vectors; cuts: where the ranges begin and end."""

    centers: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: list, cosine to its centre, code, and the distance between the vector and what its code stands for."""
        near = x @ self.centers.T
        at = near.argmax(axis=1)
        rest = x - self.centers[at]
        codes, left = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = (part @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
            left += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return at, near[np.arange(len(x)), at], codes, np.sqrt(left)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of queries: the product of each part with each code vector, as queries x parts x codes."""
        out = np.zeros((len(q), len(self.books), max(len(b) for b in self.books)), np.float32)
        for m, book in enumerate(self.books):
            out[:, m, : len(book)] = q[:, self.cuts[m] : self.cuts[m + 1]] @ book.T
        return out


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """k centres of a sample; a centre without rows takes the row that is worst off. unit: centres of length one, nearest by product."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ centers.T - (0 if unit else (centers**2).sum(axis=1) / 2)
        at = score.argmax(axis=1)
        n = np.bincount(at, minlength=len(centers))
        order = np.argsort(at, kind="stable")
        held = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)])[:-1][held], axis=0)
        centers[held] = sums / n[held, None]
        empty = np.flatnonzero(n == 0)
        centers[empty] = x[np.argsort(score.max(axis=1) - (0 if unit else (x**2).sum(axis=1) / 2))[: len(empty)]]
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _units(v: pa.Array) -> np.ndarray:
    x = np.array(v.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null, of a positive and finite length, no component missing."""
    v = F.col(vector)
    return rows.where(v.isNotNull() & (norm(v) > 0) & (norm(v) < float("inf")))


def train(rows: DataFrame, lists: int | None = None, parts: int | None = None, max_train: int = 65_536, rounds: int = 12, seed: int = 7, id_col: str = "unique_id", vector: str = "vector") -> Model:
    """A model from max_train rows at most (fewer of very wide vectors), those with the smallest hashes of their ids.

    lists: by default the root of the number of rows, at most 16,384 and at most one for every four rows of the sample; parts: by default a part for each four
    components. The sample is all that reaches the driver.
    """
    rows = _usable(rows, vector)
    first = rows.select(F.size(vector).alias("d")).first()
    if first is None:
        raise ValueError("no vector to train on")
    d, n = first["d"], rows.count()
    most = max(256, min(max_train, TRAIN_NUMBERS // d))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
    some = rows.where(h < F.lit(int((1 << 40) * min(1.0, (most + 8 * most**0.5 + 16) / n)))).select(vector, h.alias("h")).orderBy("h").limit(most)
    x = _units(some.select(vector).toArrow().column(0)).astype(np.float32)
    rng = np.random.default_rng(seed)
    centers = lloyd(x, max(1, min(lists or int(n**0.5), 16_384, -(-len(x) // 4))), rounds, rng, unit=True)
    rest = x - centers[(x @ centers.T).argmax(axis=1)]
    cuts = np.linspace(0, d, (parts or max(1, d // 4)) + 1).astype(int)
    books = [lloyd(rest[:, a:b], 256, rounds, rng) for a, b in zip(cuts[:-1], cuts[1:])]
    return Model(centers.astype(np.float64), [b.astype(np.float64) for b in books], cuts)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    parts = [("center", 0, i, c.tolist()) for i, c in enumerate(model.centers)] + [("code", m, i, c.tolist()) for m, b in enumerate(model.books) for i, c in enumerate(b)]
    spark.createDataFrame([*parts, ("cuts", 0, 0, [float(c) for c in model.cuts])], "kind string, part int, number int, v array<double>").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("kind", "part", "number").collect()  # the model: lists and 256 codes a part
    cuts = np.array(next(r["v"] for r in rows if r["kind"] == "cuts")).astype(int)
    books = [np.array([r["v"] for r in rows if r["kind"] == "code" and r["part"] == m]) for m in range(len(cuts) - 1)]
    return Model(np.array([r["v"] for r in rows if r["kind"] == "center"]), books, cuts)


class Index:
    """The index in a folder: model, about (its columns), lists (a folder a list) and stats. size and reach: of each list, its rows and the largest
    angle between its centre and one of them (minus infinity where it has none)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model = load_model(spark, f"{path}/model")
        self.id_col, self.vector = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.rows = spark.read.parquet(f"{path}/lists")
        self.size, self.reach = np.zeros(len(self.model.centers), np.int64), np.full(len(self.model.centers), -np.inf)
        for r in spark.read.parquet(f"{path}/stats").collect():  # a row a list
            self.size[r["list"]], self.reach[r["list"]] = r["n"], np.arccos(np.clip(r["least"], -1, 1)) + SLACK

    @classmethod
    def build(cls, rows: DataFrame, path: str, keep: tuple[str, ...] = (), id_col: str = "unique_id", vector: str = "vector", **training) -> Index:
        """Train on a sample of rows and write all that have a direction, with the columns `keep` to filter by."""
        spark = rows.sparkSession
        save_model(spark, train(rows, id_col=id_col, vector=vector, **training), f"{path}/model")
        spark.createDataFrame([(json.dumps([id_col, vector]),)], "about string").coalesce(1).write.text(f"{path}/about")
        _write(rows, load_model(spark, f"{path}/model"), path, id_col, vector, keep)
        return cls(spark, path)

    def add(self, rows: DataFrame) -> Index:
        """Append rows under the model as it is; what becomes of repeated ids is the caller's matter."""
        keep = tuple(c for c in self.rows.columns if c not in ("list", "_near", "_code", "_off", self.id_col, self.vector))
        _write(rows, self.model, self.path, self.id_col, self.vector, keep)
        return Index(self.spark, self.path)

    def search(self, queries: DataFrame, top_k: int = 10, num_candidates: int = 1000, probes: int = 16, where: Column | None = None, exact: bool = False, block: int = 1024) -> DataFrame:
        """query_id, rank, id and cosine: each query's top_k rows other than itself (by id), ties by id.

        where: a filter on the kept columns, applied before anything is cut. Without `exact`, the `probes` nearest lists are read, and more until they hold
        FILL times num_candidates rows; the num_candidates best of them by their codes are compared. With it, candidates are all rows that may be among the top_k, in all lists that may hold one: first
        the probed lists, then those that the k-th neighbour found doesn't rule out. Queries are taken `block` at a time.
        """
        asked = _usable(queries, self.vector).select(F.col(self.id_col).alias("query_id"), F.col(self.vector).alias("_q"))
        parts = max(1, -(-asked.count() // block))
        at = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        one = self._exact if exact else lambda q, *a: self._found(q, *a, num_candidates)[0]
        return reduce(DataFrame.unionByName, (one(asked.where(at == p), top_k, probes, where) for p in range(parts)))

    # --- parts of a search

    def _asked(self, queries: DataFrame) -> tuple[list, np.ndarray]:
        got = queries.toArrow()  # a block
        return got.column(0).to_pylist(), _units(got.column(1)) if got.num_rows else np.zeros((0, self.model.centers.shape[1]))

    def _found(self, queries: DataFrame, top_k: int, probes: int, where: Column | None, num_candidates: int | None, chosen: np.ndarray | None = None, floor: np.ndarray | None = None) -> tuple[DataFrame, tuple]:
        """The top_k among candidates of the chosen lists (default: the nearest ones), and the queries with the lists that were read.

        num_candidates None: all candidates that may be among the top_k, given that cosines below `floor` can't be.
        """
        ids, q = self._asked(queries)
        near = q @ self.model.centers.T
        if chosen is None:
            order = np.argsort(-near, axis=1, kind="stable")
            before = np.cumsum(self.size[order], axis=1) - self.size[order]
            chosen = np.zeros(near.shape, bool)
            np.put_along_axis(chosen, order, (np.arange(near.shape[1]) < probes) | (before < FILL * (num_candidates or 0)), axis=1)
        lists = np.flatnonzero(chosen.any(axis=0)).tolist()
        rows = self.rows.where(f"list in ({', '.join(map(str, lists))})" if lists else "false")
        rows = rows if where is None else rows.where(where)
        kind = self.rows.schema[self.id_col].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast((np.array(ids, object), self.model.tables(q), near.astype(np.float32), chosen, floor))
        scored = rows.select("list", self.id_col, "_code", "_off").mapInArrow(_scorer(shared, top_k + 1, num_candidates and num_candidates + 1), f"query_id {kind}, list int, id {kind}, low float, high float")
        if num_candidates is None:
            low = scored.groupBy("query_id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("_p")).agg(F.sort_array(F.collect_list("low"), asc=False).alias("l")).select("query_id", F.explode(F.slice("l", 1, top_k + 1)).alias("low"))
            kth = low.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("_r") == top_k + 1).select(F.col("query_id").alias("_id"), F.col("low").alias("_kth"))
            candidates = scored.join(F.broadcast(kth), F.col("query_id") == F.col("_id"), "left").where("_kth is null or high >= _kth").select("query_id", "list", "id")  # a row a query of the block
        else:
            candidates = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.asc("id")))).where(F.col("_r") <= num_candidates + 1).select("query_id", "list", "id")
        candidates = candidates.where("query_id <> id").distinct()
        vectors = rows.select(F.col("list").alias("_l"), F.col(self.id_col).alias("_i"), F.col(self.vector).alias("_v"))
        own = candidates.join(vectors, (F.col("list") == F.col("_l")) & (F.col("id") == F.col("_i"))).join(F.broadcast(queries.withColumnRenamed("query_id", "_id")), F.col("query_id") == F.col("_id"))  # a block of queries
        best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id"))
        top = own.select("query_id", "id", cosine(F.col("_q"), F.col("_v")).alias("cosine")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        return top.select("query_id", "rank", "id", "cosine"), (ids, near, chosen)

    def _exact(self, queries: DataFrame, top_k: int, probes: int, where: Column | None) -> DataFrame:
        first, (ids, near, chosen) = self._found(queries, top_k, probes, where, None)
        kth = {r["query_id"]: r["cosine"] for r in first.where(F.col("rank") == top_k).select("query_id", "cosine").collect()}  # a row a query of the block
        floor = np.array([kth.get(i, -np.inf) for i in ids]) - SLACK
        angle = np.arccos(np.clip(near, -1, 1)) - self.reach  # at least so far from any row of the list
        chosen = np.where(angle > 0, np.cos(np.clip(angle, 0, np.pi)), 1.0) + SLACK >= floor[:, None]
        chosen &= self.size > 0
        return self._found(queries, top_k, probes, where, None, chosen, floor)[0]


def _scorer(shared, top_k: int, num_candidates: int | None):
    """For batches of codes: each query's best rows of its lists (itself may be one), with bounds of their cosines (both are the estimate where
    num_candidates is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables, near, chosen, floor = shared.value
        for batch in batches:
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(lists):
                continue
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            off = batch.column(3).to_numpy(zero_copy_only=False)
            for one in np.unique(lists):
                here, asking = np.flatnonzero(lists == one), np.flatnonzero(chosen[:, one])
                if not len(asking):
                    continue
                step = max(1, SCORES // len(here))
                for a in range(0, len(asking), step):
                    q = asking[a : a + step]
                    score = np.repeat(near[q, one][:, None], len(here), axis=1)
                    for m in range(codes.shape[1]):
                        score += tables[q, m][:, codes[here, m]]
                    if num_candidates is None:
                        low, high = score - off[here] - SLACK, score + off[here] + SLACK
                        k = min(top_k, len(here))
                        least = -np.partition(-low, k - 1, axis=1)[:, k - 1] if k == top_k else np.full(len(q), -np.inf)
                        if floor is not None:
                            least = np.maximum(least, floor[q])
                        keep = high >= least[:, None]
                    else:
                        low = high = score
                        k = min(num_candidates, len(here))
                        keep = score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[i]].tolist(), batch.schema.field(1).type), pa.array(np.full(len(i), one, np.int32)), batch.column(1).take(pa.array(here[j])), pa.array(low[i, j].astype(np.float32)), pa.array(high[i, j].astype(np.float32))], names=["query_id", "list", "id", "low", "high"])

    return run


def _write(rows: DataFrame, model: Model, path: str, id_col: str, vector: str, keep: tuple[str, ...]) -> None:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = _usable(rows, vector).select(id_col, vector, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, near, codes, off = shared.value.encode(_units(batch.column(1)))
                found = [pa.array(at.astype(np.int32)), pa.array(near), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "list", "_near", "_code", "_off"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    coded = kept.mapInArrow(run, f"{fields}, list int, _near double, _code binary, _off double")
    # files of a list lie together; adaptive execution splits a list that holds much of the table
    coded.hint("rebalance", "list").sortWithinPartitions("list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    stats = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("_near").alias("least"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # a row a list
