"""Quota-based stratified samples with largest-remainder apportionment; draws follow a hash of the id and thus repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(id_col: str) -> Column:
    return F.md5(F.col(id_col).cast("string"))


def class_targets(rows: DataFrame, cls: str, per_class: int, most: int) -> DataFrame:
    """cls, n and target: per_class at most, scaled down to `most` in all, the remainder to the largest fractions (ties by name).

    Null, empty and all-digit classes take no part.
    """
    counts = rows.where(F.col(cls).isNotNull() & (F.col(cls) != "") & ~F.col(cls).rlike("^[0-9]+$")).groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    raw = counts.withColumn("raw", F.least("n", F.lit(per_class)).cast("long"))
    all_ = Window.partitionBy()  # a row per class
    part = raw.withColumn("total", F.sum("raw").over(all_))
    part = part.withColumn("low", F.when(F.col("total") > most, F.expr(f"raw * {most} div total")).otherwise(F.col("raw"))).withColumn("rest", F.when(F.col("total") > most, F.expr(f"raw * {most} % total")).otherwise(F.lit(0)))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.asc(cls)))).withColumn("left", F.least(F.lit(most), "total") - F.sum("low").over(all_))
    return ranked.select(cls, "n", (F.col("low") + (F.col("rank") <= F.col("left")).cast("long")).alias("target"))


def source_quotas(rows: DataFrame, cls: str, source: str, targets: DataFrame) -> DataFrame:
    """cls, source and quota: each class's target split by the sources' shares of it, by largest remainders (ties by name)."""
    counts = rows.groupBy(cls, source).agg(F.count(F.lit(1)).alias("n_ci")).join(targets, cls)
    part = counts.withColumn("low", F.expr("n_ci * target div n")).withColumn("rest", F.expr("n_ci * target % n"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy(cls).orderBy(F.desc("rest"), F.asc(source)))).withColumn("left", F.col("target") - F.sum("low").over(Window.partitionBy(cls)))
    return ranked.select(cls, source, (F.col("low") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota"))


def quota_sample(rows: DataFrame, cls: str, source: str, id_col: str, per_class: int, most: int) -> DataFrame:
    """Each (class, source) gets its quota of rows, in the order of a hash of the id; of rows with the same id the first by class and source counts.

    Rows without an id are never drawn. Quotas follow the numbers of rows; a (class, source) with fewer different ids than its quota gives them all. How many ids each slice of hashes
    holds is counted, and only the slices that a quota reaches into are ordered, so what is ordered follows the quotas, not the table, and
    no quota is left short.
    """
    quotas = source_quotas(rows, cls, source, class_targets(rows, cls, per_class, most)).where("quota > 0")
    first = F.min(F.struct(F.col(cls).alias("cls"), F.col(source).alias("source"))).alias("_f")
    once = rows.groupBy(F.col(id_col).alias("_id")).agg(first).select("_id", F.col("_f.cls").alias("_cls"), F.col("_f.source").alias("_src"), draw_order("_id").alias("_h"))
    once = once.withColumn("_slice", F.substring("_h", 1, 3))
    before = F.sum("_n").over(Window.partitionBy("_cls", "_src").orderBy("_slice")) - F.col("_n")  # at most 4096 slices
    wanted = quotas.select(F.col(cls).alias("_cls"), F.col(source).alias("_src"), F.col("quota").alias("_quota"))
    filled = once.groupBy("_cls", "_src", "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    reached = _join_groups(filled, wanted).where("_before < _quota").groupBy("_cls", "_src").agg(F.max("_slice").alias("_last"), F.max("_quota").alias("_quota"))
    rank = F.row_number().over(Window.partitionBy("_cls", "_src").orderBy("_h", "_id"))
    drawn = _join_groups(once, reached).where("_slice <= _last").withColumn("_rank", rank).where("_rank <= _quota").select("_id", "_cls", "_src")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(cls) == F.col("_cls")) & F.col(source).eqNullSafe(F.col("_src"))
    return keep_first(rows.join(drawn, same, "left_semi"), [id_col], [F.col(cls), F.col(source)])


def _join_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """By class and source; a missing source is one."""
    right = right.withColumnsRenamed({"_cls": "_cls2", "_src": "_src2"})
    return left.join(right, (F.col("_cls") == F.col("_cls2")) & F.col("_src").eqNullSafe(F.col("_src2"))).drop("_cls2", "_src2")


def per_group_sample(rows: DataFrame, group: str, id_col: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw_order(id_col), F.col(id_col)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def hashed_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows, evenly drawn and the same at every run."""
    return rows.orderBy(draw_order(id_col), F.col(id_col)).limit(n)


def greedy_sample(rows: DataFrame, group: str, id_col: str, least: int, most: int) -> DataFrame:
    """`least` rows of each group, `most` in all."""
    return per_group_sample(rows, group, id_col, least).orderBy(draw_order(id_col), F.col(id_col)).limit(most)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def chunk_numbers(rows: DataFrame, group: str, order: str, size: int, parts: int = 64) -> DataFrame:
    """rows with chunk: each group's rows, in order, in chunks of `size`.

    Where order is a number, a group is ranked in `parts` ranges of it (the same for all groups, at approximate quantiles), whose sizes are then
    summed, so no task orders a whole group; else by one window a group.
    """
    kind = rows.schema[order].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))
    cuts = sorted({*rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)})
    part = F.coalesce(sum((F.col(order) >= c).cast("int") for c in cuts) if cuts else F.lit(0), F.lit(-1))  # nulls come first
    placed = rows.withColumn("_p", part)
    w = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n")).select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))  # `parts` rows a group
    own = placed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy(order)) - 1)
    return own.join(bases, own[group].eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).withColumn("chunk", F.floor((F.col("_base") + F.col("_r")) / size)).select(*rows.columns, "chunk")
