"""Counts, shares, pivots, summaries of columns and of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles


def class_counts(rows: DataFrame, keys: list[str], alpha: str | None = None) -> DataFrame:
    """Rows per combination of keys; alpha: a column whose values must be letters only."""
    rows = rows if alpha is None else rows.where(F.col(alpha).rlike(r"^\p{L}+$"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def shares(counts: DataFrame, by: str, digits: int = 9) -> DataFrame:
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(by)), digits))


def pivot_counts(counts: DataFrame, row: str, column: str, values: list, other: str | None = None) -> DataFrame:
    """A row for each value of row, with a column for each of `values`, and one named `other` for what has none of its own."""
    if other is None:
        return counts.groupBy(row).pivot(column, values).agg(F.sum("count")).na.fill(0)
    named = F.col(column).isin(values)
    key = F.when(named, F.col(column).cast("string")).otherwise(F.lit(other))
    return counts.select(row, key.alias(column), "count").groupBy(row).pivot(column, [*map(str, values), other]).agg(F.sum("count")).na.fill(0)


def size_summary(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Smallest and largest cluster (ties: the smallest label), least, most, mean and median size."""
    n = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min_by(cluster, F.struct("n", cluster)).alias("smallest"), F.min_by(cluster, F.struct(-F.col("n"), F.col(cluster))).alias("largest"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("avg_size"), F.round(F.median("n"), 6).alias("median_size"))


def low_tissue(rows: DataFrame, limit: float = 20.0) -> DataFrame:
    low = F.count_if(F.col("tissue_percentage") < limit)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"), low.alias("low"), F.round(low / F.count(F.lit(1)) * 100, 6).alias("low_percent"))


def zero_filled_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per (a, b) for every a with every b; both are small sets of labels."""
    grid = F.broadcast(rows.select(a).distinct()).crossJoin(F.broadcast(rows.select(b).distinct()))
    return grid.join(class_counts(rows, [a, b]), [a, b], "left").na.fill(0, ["count"])


def describe_numeric(rows: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Exact count, mean, deviation, least, quartiles and most."""
    c = F.col(column).cast("double")
    whole = rows.agg(F.lit(column).alias("column"), F.count(c).alias("count"), *(F.round(x, digits).alias(n) for n, x in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c)), ("max", F.max(c)))))
    q = percentiles(rows, [], column, [0.25, 0.5, 0.75]).agg(F.first("q").alias("q"))  # one row, also of no values
    return whole.crossJoin(F.broadcast(q)).select("column", "count", "mean", "std", "min", *(F.round(F.get("q", i), digits).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "max")


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value; nulls are a value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k)


def describe_categorical(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """For each column its number of distinct values, and its k most frequent values with their counts."""
    out = None
    for c in columns:
        one = top_values(rows.where(F.col(c).isNotNull()), c, k).withColumn("value", F.col("value").cast("string"))
        one = one.crossJoin(F.broadcast(rows.agg(F.count_distinct(c).alias("n_unique")))).select(F.lit(c).alias("column"), "n_unique", "value", "count")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(rows: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Rows per equal-width bin between the least and the largest value; the last bin includes the largest."""
    c = F.col(column).cast("double")
    ends = F.broadcast(rows.agg(F.min(c).alias("_low"), F.max(c).alias("_high")))
    at = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((c - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)))
    return rows.where(c.isNotNull()).crossJoin(ends).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def part_counts(keys: DataFrame, key: str, names: list[str]) -> DataFrame:
    """How often each value comes at each place of an underscore-joined key (keys of fewer than six parts are left out)."""
    from ..functions.keys import first_five_and_rest

    parts = keys.select(first_five_and_rest(F.col(key)).alias("p")).where("p is not null")
    return parts.select(F.posexplode("p").alias("i", "value")).groupBy(F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("i") + 1).cast("int")).alias("part"), "value").agg(F.count(F.lit(1)).alias("count"))


def correlation(rows: DataFrame, of: str, others: list[str], digits: int = 6) -> DataFrame:
    got = rows.agg(*(F.round(F.corr(of, o), digits).alias(o) for o in others))
    return got.unpivot([], others, "metric", "correlation")


def deviation_category(rows: DataFrame, column: str) -> DataFrame:
    """rows with category: low, mid or high, as column lies below, within or above one deviation of its mean."""
    s = F.broadcast(rows.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")))
    return rows.crossJoin(s).withColumn("category", F.when(F.col(column) < F.col("_m") - F.col("_s"), "low").when(F.col(column) > F.col("_m") + F.col("_s"), "high").otherwise("mid")).drop("_m", "_s")


def spine_fill(rows: DataFrame, k: int, key: str, columns: list[str]) -> DataFrame:
    """A row for each of 0 .. k - 1, with 0 for what rows lack."""
    return rows.sparkSession.range(k).select(F.col("id").alias(key)).join(rows.withColumn(key, F.col(key).cast("long")), key, "left").na.fill(0, columns)
