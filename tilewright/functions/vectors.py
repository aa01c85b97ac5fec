"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where one vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "vector", name: str = "center") -> DataFrame:
    """The mean vector of each group. Components are averaged as rows, so map-side combining bounds what is shuffled."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    got = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name), F.max("_n").alias("n"))
    return got
