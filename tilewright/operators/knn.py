"""Nearest neighbours by cosine: exact, with filters before and exclusions after; and by random hyperplanes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm


def knn(rows: DataFrame, query: list[float], top_k: int = 10, where: Column | None = None, exclude_id: object = None, exclude_block: str | None = None, id_col: str = "unique_id", vector: str = "vector") -> DataFrame:
    """The top_k rows closest to query, with score = (1 + cosine) / 2; ties by id.

    where and exclude_id apply before the cut, exclude_block after it (and so may leave fewer rows). Top-k is kept per task and then merged.
    """
    got = rows if where is None else rows.where(where)
    got = got if exclude_id is None else got.where(F.col(id_col) != exclude_id)
    q = F.array(*(F.lit(float(x)) for x in query))
    got = got.withColumn("score", (1 + cosine(F.col(vector), q)) / 2).where("score is not null").orderBy(F.desc("score"), F.asc(id_col)).limit(top_k)
    return got if exclude_block is None else got.where(F.col("block_id") != exclude_block)


def knn_join(queries: DataFrame, corpus: DataFrame, top_k: int, id_col: str = "unique_id", vector: str = "vector", block: int = 16_384) -> DataFrame:
    """Each query's top_k rows of the corpus other than itself, ties by id, blockwise: corpus batches against `block` queries at a time, best kept
    per batch, then merged in two steps. Vectors that are null or have no length have no neighbours and are none."""
    there = F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)
    asked = queries.select(id_col, vector).where(there)
    parts = max(1, -(-asked.count() // block))
    if parts > 1:
        part = F.pmod(F.xxhash64(id_col), F.lit(parts))
        return reduce(DataFrame.unionByName, (_knn_block(asked.where(part == p), corpus.where(there), top_k, id_col, vector) for p in range(parts)))
    return _knn_block(asked, corpus.where(there), top_k, id_col, vector)


def _knn_block(queries: DataFrame, corpus: DataFrame, top_k: int, id_col: str, vector: str) -> DataFrame:
    q = queries.select(id_col, vector).toArrow()
    ids = q.column(0).to_pylist()
    matrix = np.array(q.column(1).to_pylist() or np.zeros((0, 1)), np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        import pandas as pd

        names, m = shared.value
        for pdf in batches:
            if not len(names) or not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            s = m @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            k = min(top_k + 1, s.shape[1])
            q, at = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])  # all that tie with the last one
            yield pd.DataFrame({"query_id": np.array(names, dtype=object)[q], "id": pdf["id"].to_numpy()[at], "cosine": s[q, at]})

    kind = corpus.schema[id_col].dataType.simpleString()
    near = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInPandas(run, f"query_id {kind}, id {kind}, cosine double").where("query_id <> id")
    keep = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "id"))), 1, top_k).alias("b")
    some = near.groupBy("query_id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_part")).agg(keep)  # so that no task gathers what all batches kept
    best = some.select("query_id", F.explode("b").alias("x")).select("query_id", (-F.col("x.d")).alias("cosine"), F.col("x.id").alias("id")).groupBy("query_id").agg(keep)
    return best.select("query_id", F.posexplode("b").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.d")).alias("cosine"))


def lsh_candidates(rows: DataFrame, query: list[float], bits: int = 8, tables: int = 16, seed: int = 7, vector: str = "vector") -> DataFrame:
    """Rows that agree with query in all signs of one table of random hyperplanes at least; expressions only."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, len(query)))
    q = np.asarray(query, float)
    hit = F.lit(False)
    for t in planes:
        one = F.lit(True)
        for p in t:
            d = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(x)) for x in p)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            one = one & ((d > 0) == F.lit(bool(p @ q > 0)))
        hit = hit | one
    return rows.where(hit)
