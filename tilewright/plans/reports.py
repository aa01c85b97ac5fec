"""Further registered queries: grids, matches over files, exports, versions, frames with a query's row; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import kselect, paired, sampling, tissue
from ..sources import readers, sinks
from .fixtures import view
from .queries import DEDUP, NORM, _scratch, query


@query()
def sweep_clusters(spark, sf_dir):
    """The relabelled clusters of both conditions of a sweep."""
    tiles = tissue.with_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"))
    return kselect.condition_clusters(tiles, [4, 8], "vec_id")


@query(f"WITH {DEDUP}, t AS (SELECT t.vec_id, coalesce(d.tissue_percentage, 100.0) AS x FROM tiles t LEFT JOIN dedup d ON d.nk = {NORM.format('t.tile_key')}), c AS (SELECT 'filtered' AS condition, x FROM t WHERE x >= 20 UNION ALL SELECT 'unfiltered', x FROM t) SELECT condition, k, cast(count(*) as bigint) AS rows, count(*) FILTER (cast(x as float) < 5) AS no_tissue, count(*) FILTER (cast(x as float) >= 5 AND cast(x as float) < 20) AS little_tissue FROM c, (VALUES (4), (8)) k(k) GROUP BY 1, 2", "tiles", "ext")
def sweep_cluster_counts(spark, sf_dir):
    """Of each condition and k the rows, and those that tissue relabels; whatever the models are."""
    got = sweep_clusters(spark, sf_dir)
    return got.groupBy("condition", "k").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cluster") == tissue.NO_TISSUE).alias("no_tissue"), F.count_if(F.col("cluster") == tissue.LITTLE_TISSUE).alias("little_tissue"))


@query(f"WITH {DEDUP}, r AS (SELECT t.vec_id, cast(t.label as int) AS cluster, d.tissue_percentage FROM tiles t JOIN dedup d ON d.nk = {NORM.format('t.tile_key')} WHERE d.tissue_percentage BETWEEN 20 AND 80) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5(cast(vec_id as string)), vec_id) <= 6", "tiles", "ext")
def cluster_range_sample(spark, sf_dir):
    """Some tiles of each cluster whose tissue lies in a range, for all clusters at once."""
    tiles = view(spark, sf_dir, "tiles").select("vec_id", "tile_key", F.col("label").cast("int").alias("cluster"))
    held = tissue.with_tissue(tiles, view(spark, sf_dir, "ext"), "inner").where("tissue_percentage between 20 and 80")
    return sampling.per_group_sample(held.select("vec_id", "cluster", "tissue_percentage"), "cluster", "vec_id", 6)


@query("SELECT t.vec_id, b.tissue_percentage, b.tile_key IS NOT NULL AS found FROM tiles t LEFT JOIN (SELECT tile_key, max(tissue_percentage) AS tissue_percentage FROM blur GROUP BY 1) b ON b.tile_key = t.slide_key || '_' || cast(t.box_id as string) || '_' || t.filename", "tiles", "blur")
def raw_key_join(spark, sf_dir):
    """Tiles with the percentages of the same key, as it is written."""
    tiles = view(spark, sf_dir, "tiles").select("vec_id", F.concat_ws("_", "slide_key", F.col("box_id").cast("string"), "filename").alias("tile_key"))
    blur = view(spark, sf_dir, "blur").groupBy("tile_key").agg(F.max("tissue_percentage").alias("tissue_percentage"), F.lit(True).alias("there"))
    return tiles.join(blur, "tile_key", "left").select("vec_id", "tissue_percentage", F.col("there").isNotNull().alias("found"))


@query(f"WITH {DEDUP} SELECT t.vec_id, coalesce(d.tissue_percentage, 100.0) AS tissue_percentage, 'none' AS remark FROM tiles t LEFT JOIN dedup d ON d.nk = {NORM.format('t.tile_key')}", "tiles", "ext")
def column_or_constant(spark, sf_dir):
    """A column where it is there, a constant where it isn't."""
    rows = tissue.with_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"))
    return rows.select("vec_id", tissue.column_or(rows, "tissue_percentage", 100.0), tissue.column_or(rows, "remark", "none"))


@query("SELECT modality, count(*) AS rows, count(p.unique_id) AS matched, count(*) - count(p.unique_id) AS missing FROM tiles t LEFT JOIN (SELECT DISTINCT unique_id FROM preds) p USING (unique_id) GROUP BY 1", "tiles", "preds")
def match_report(spark, sf_dir):
    """How many rows of each of several files have a prediction."""
    path = _scratch(spark)
    view(spark, sf_dir, "tiles").select("unique_id", "modality").repartition(1).write.partitionBy("modality").parquet(path)
    _, report = readers.match_files(spark, path, view(spark, sf_dir, "preds"), "unique_id")
    return report.select(F.regexp_extract("file", "modality=([^/]+)", 1).alias("modality"), "rows", "matched", "missing")


@query("WITH p AS (SELECT t.slide_key || '_' || t.tile_key AS slide_key, t.tissue_type, t.block_id, t.slice_id, t.scan_date, t.box_id, t.filename, cast(label as int) AS cluster FROM tiles t), g AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(slide_key), slide_key) AS cell FROM p) SELECT cluster, cell, slide_key, '/img/' || concat_ws('/', tissue_type, block_id, slice_id, scan_date, cast(box_id as string), filename) || '-stained.tiff' AS stained, '/img/' || concat_ws('/', tissue_type, block_id, slice_id, scan_date, cast(box_id as string), filename) || '-stained-sr.tiff' AS virtual FROM g WHERE cell <= 4", "tiles")
def paired_grids(spark, sf_dir):
    """A few pairs of each cluster, stained beside virtual."""
    tiles = view(spark, sf_dir, "tiles").withColumn("slide_key", F.concat_ws("_", "slide_key", "tile_key")).withColumn("cluster", F.col("label").cast("int"))
    return paired.paired_grid(tiles, 4, "/img").select("cluster", F.col("cell").cast("long").alias("cell"), "slide_key", "stained", "virtual")


@query()
def components_query_row(spark, sf_dir):
    rows = view(spark, sf_dir, "tiles").select(F.when(F.col("vec_id") == 3, "__query__").otherwise(F.col("tile_key")).alias("slide_key"), "vector")
    got = paired.components_with_query(rows, 3)
    return got.select("slide_key", "is_query", *(F.round(f"pc{i}", 6).alias(f"pc{i}") for i in (1, 2, 3)))


@query("SELECT vec_id, coalesce(len(embedding), 0) AS dimension, true AS named_once FROM embeddings")
def vector_dimensions(spark, sf_dir):
    """The width of each vector, 0 for none; surrogate ids of a plan that is computed once name each row."""
    rows = view(spark, sf_dir, "embeddings").select("vec_id", keys.dimension(F.col("embedding")).cast("long").alias("dimension"), keys.row_id().alias("row_id"))
    path = _scratch(spark)
    rows.write.parquet(path)
    held = spark.read.parquet(path)
    twice = held.groupBy("row_id").count().where("count > 1").select("row_id", "count")
    return held.join(twice, "row_id", "left").select("vec_id", "dimension", F.col("count").isNull().alias("named_once"))


@query("SELECT '/out/' || replace(replace(tile_key, '_', '/'), 'tile/', 'tile_') || '.tiff' AS path FROM preds WHERE cluster = 3", "preds")
def export_cluster_paths(spark, sf_dir):
    """The object paths of a cluster, written as text and read again."""
    path = _scratch(spark)
    rows = view(spark, sf_dir, "preds").where("cluster = 3").select(F.concat(F.lit("/out/"), keys.key_to_path(F.col("tile_key")), F.lit(".tiff")).alias("path"))
    sinks.export_paths(rows, "path", path)
    return spark.read.text(path).withColumnRenamed("value", "path")


@query("SELECT vec_id, label FROM embeddings WHERE label < 4")
def versioned_table(spark, sf_dir):
    """The last of several versions of a table, of which two are kept."""
    path, rows = _scratch(spark), view(spark, sf_dir, "embeddings").select("vec_id", "label")
    for most in (8, 6, 4):
        last = sinks.write_version(rows.where(F.col("label") < most), path, keep=2)
    assert sinks.versions(spark, path) == [last - 1, last]
    return spark.read.parquet(f"{path}/{last}")
