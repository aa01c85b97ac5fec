"""Joins with tissue percentages on normalised tile keys, and relabelling by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_tile_key

LOW, MID = 5.0, 20.0
#: Labels of tiles with almost no tissue and with little.
NO_TISSUE, LITTLE_TISSUE = -2, -1


def column_or(rows: DataFrame, name: str, value: object) -> Column:
    """A column where rows has it (nulls become value), else the value for all."""
    return (F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)).alias(name)


def dedup_tissue(ext: DataFrame, modality: str | None = None) -> DataFrame:
    """norm_key and its largest tissue_percentage: the build side of all joins, a row per key, so that no join fans out."""
    rows = ext if modality is None else ext.where(F.col("modality") == modality)
    return rows.groupBy(norm_tile_key(F.col("tile_key")).alias("norm_key")).agg(F.max("tissue_percentage").alias("tissue_percentage"))


def with_tissue(tiles: DataFrame, ext: DataFrame, how: str = "left", modality: str | None = None) -> DataFrame:
    rows = tiles.drop("tissue_percentage").withColumn("norm_key", norm_tile_key(F.col("tile_key")))
    return rows.join(dedup_tissue(ext, modality), "norm_key", how).drop("norm_key")


def filter_tissue(tiles: DataFrame, ext: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Tiles with at least (strict: more than) so much tissue; tiles of unknown tissue go."""
    got = with_tissue(tiles, ext, "inner")
    return got.where(F.col("tissue_percentage") > least if strict else F.col("tissue_percentage") >= least)


def enrich(ext: DataFrame, blur: DataFrame) -> DataFrame:
    """ext with the percentages that blur has for a key and modality (the largest), and its own elsewhere."""
    found = blur.groupBy(norm_tile_key(F.col("tile_key")).alias("_k"), F.when(F.col("stained"), "stained").otherwise("unstained").alias("_m")).agg(F.max("tissue_percentage").alias("_t"))
    got = ext.join(found, (norm_tile_key(F.col("tile_key")) == F.col("_k")) & (F.col("modality") == F.col("_m")), "left")
    return got.withColumn("tissue_percentage", F.coalesce("_t", "tissue_percentage")).drop("_k", "_m", "_t")


def relabel(cluster: Column, tissue: Column, low: float = LOW, mid: float = MID) -> Column:
    """-2 below low, -1 below mid, else the cluster; unknown tissue keeps the cluster."""
    return F.when(tissue < low, NO_TISSUE).when(tissue < mid, LITTLE_TISSUE).otherwise(cluster)


def relabel_single(cluster: Column, tissue: Column, low: float = LOW, mid: float = MID) -> Column:
    """As prediction does it: in single precision, unknown tissue as 100."""
    t = F.coalesce(tissue.cast("float"), F.lit(100.0).cast("float"))
    return F.when(t < low, NO_TISSUE).when(t < mid, LITTLE_TISSUE).otherwise(cluster)


def postprocess(preds: DataFrame, ext: DataFrame, fan_out: bool = False) -> DataFrame:
    """Predictions relabelled by tissue. fan_out keeps a row for each different percentage of a key instead of the largest one."""
    if fan_out:
        build = ext.where(F.col("modality") == "stained").select(norm_tile_key(F.col("tile_key")).alias("norm_key"), "tile_key", "tissue_percentage").dropDuplicates(["tile_key", "tissue_percentage"]).drop("tile_key")
    else:
        build = dedup_tissue(ext, "stained")
    got = preds.withColumn("norm_key", norm_tile_key(F.col("tile_key"))).join(build, "norm_key", "left").drop("norm_key")
    return got.withColumn("cluster", relabel(F.col("cluster"), F.col("tissue_percentage")))


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per cluster before and after, and the difference; clusters of one side only count 0 on the other."""
    a, b = (d.groupBy("cluster").agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, "cluster", "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def special_split(rows: DataFrame, cluster: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Rows of real clusters, and of the special ones (negative numbers, which relabelling gives)."""
    return rows.where(F.col(cluster) >= 0), rows.where(F.col(cluster) < 0)
