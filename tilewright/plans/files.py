"""Registered queries over sources and sinks: what is written is read again and compared; importing this registers them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import documents, images, kmeans
from ..sources import fetch, readers, sinks
from ..streaming import micro
from .fixtures import view
from .queries import NEAREST, _scratch, label_centers, query


def _taken(spark, table: str, path: str):
    """What a table holds, written beside it, and the table dropped."""
    spark.table(table).write.parquet(path)
    spark.sql(f"DROP TABLE {table}")
    return spark.read.parquet(path)


@query("SELECT vec_id, tissue_type, CASE WHEN vec_id % 2 = 0 THEN slice_id END AS slice_id FROM tiles", "tiles")
def table_from_files(spark, sf_dir):
    """A table made once from files whose columns differ in order and number; a second call leaves it as it is."""
    path, name, tiles = _scratch(spark), f"made_{uuid.uuid4().hex}", view(spark, sf_dir, "tiles")
    tiles.where("vec_id % 2 = 0").select("slice_id", "vec_id", "tissue_type").write.parquet(f"{path}/in/a")
    tiles.where("vec_id % 2 = 1").select("tissue_type", "vec_id").write.parquet(f"{path}/in/b")
    sinks.create_table_once(spark, name, f"{path}/in")
    tiles.select("vec_id", "tissue_type").write.parquet(f"{path}/in/c")
    sinks.create_table_once(spark, name, f"{path}/in")
    return _taken(spark, name, f"{path}/out").select("vec_id", "tissue_type", "slice_id")


@query("SELECT unique_id, vec_id FROM tiles WHERE vec_id % 3 = 1", "tiles")
def table_replaced(spark, sf_dir):
    """A bucketed table that takes the place of another."""
    path, name, tiles = _scratch(spark), f"replaced_{uuid.uuid4().hex}", view(spark, sf_dir, "tiles").select("unique_id", "vec_id")
    sinks.replace_table(tiles, name, "unique_id", 8)
    sinks.replace_table(tiles.where("vec_id % 3 = 1"), name, "unique_id", 8)
    return _taken(spark, name, f"{path}/out")


@query("SELECT tissue_type, modality, count(*) AS count FROM tiles GROUP BY 1, 2", "tiles")
def csv_round_trip(spark, sf_dir):
    """A report written as CSV, and read by its suffix with the columns asked for."""
    path = f"{_scratch(spark)}/report.csv"
    sinks.write_csv(view(spark, sf_dir, "tiles").groupBy("tissue_type", "modality").agg(F.count(F.lit(1)).alias("count"), F.max("vec_id").alias("largest")), path)
    return readers.resolve(spark, path, ["tissue_type", "modality", "count"]).select("tissue_type", "modality", F.col("count").cast("long").alias("count"))


@query("SELECT model, k, inertia, CASE WHEN model = 'front' THEN silhouette END AS silhouette FROM kmetrics", "kmetrics")
def metric_collection(spark, sf_dir):
    """The metric files of several models, of which one has a column less and one isn't there."""
    path, metrics = _scratch(spark), view(spark, sf_dir, "kmetrics")
    sinks.write_csv(metrics.where("model = 'front'").select("k", "inertia", "silhouette"), f"{path}/front.csv")
    sinks.write_csv(metrics.where("model = 'back'").select("k", "inertia"), f"{path}/back.csv")
    return readers.metric_files(spark, {m: f"{path}/{m}.csv" for m in ("front", "back", "gone")}).select("model", "k", "inertia", "silhouette")


@query(f"WITH {NEAREST} SELECT vec_id, cluster, round(dist, 6) AS distance FROM nearest", "tiles")
def model_round_trip(spark, sf_dir):
    """Assignment by centres that were saved and loaded."""
    path, rows = _scratch(spark), label_centers(spark, sf_dir).orderBy("cluster").collect()
    sinks.save_centers(spark, np.array([r["center"] for r in rows]), f"{path}/{sinks.model_name(10, 'stained')}", k=10)
    centers = sinks.load_centers(spark, f"{path}/{sinks.model_name(10, 'stained')}")
    return kmeans.assign(view(spark, sf_dir, "tiles"), centers).select("vec_id", "cluster", F.round(F.sqrt("d2"), 6).alias("distance"))


@query("SELECT 'store://b/' || tissue_type || '/' || filename || '-stained.tiff' AS path FROM tiles WHERE vec_id % 4 = 0", "tiles")
def manifest_paths(spark, sf_dir):
    """Object paths from a manifest: the last field of each line, with and without prefix and suffix."""
    path = _scratch(spark)
    key = F.concat_ws("/", "tissue_type", "filename")
    line = F.when(F.col("vec_id") % 8 == 0, F.concat(F.lit("7,x, "), key, F.lit(" "))).otherwise(F.concat(F.lit("store://b/"), key, F.lit("-stained.tiff")))
    view(spark, sf_dir, "tiles").where("vec_id % 4 = 0").select(line.alias("value")).unionByName(spark.range(2).select(F.lit("").alias("value"))).write.text(path)
    return readers.path_list(spark, path, "store://b/", "-stained.tiff")


@query("SELECT DISTINCT filename AS name FROM tiles WHERE vec_id % 2 = 0 OR vec_id % 3 = 0", "tiles")
def manifest_union(spark, sf_dir):
    """The names of two runs in one manifest, each once."""
    path, tiles = _scratch(spark), view(spark, sf_dir, "tiles")
    sinks.merge_manifest(tiles.where("vec_id % 2 = 0").select("filename"), tiles.where("vec_id % 3 = 0").select("filename"), path)
    return spark.read.text(path).withColumnRenamed("value", "name")


_DECODED = f"WITH p AS (SELECT vec_id, i, cast(floor(abs(cast(list_element(embedding, cast(i as int)) as double)) * 255) as int) % 256 AS v FROM embeddings, range(1, 65) AS r(i) WHERE vec_id % 10 = 0)"


def _images(spark, sf_dir):
    """Every tenth vector as an image of 8 x 8 grey pixels in a file of its own, each fortieth broken; the folder."""
    folder = _scratch(spark)
    pixels = F.transform(F.col("embedding"), lambda x: (F.floor(F.abs(x.cast("double")) * 255).cast("int") % 256))
    rows = view(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select("vec_id", pixels.alias("pixels"))

    def write(batches):
        for batch in batches:
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = np.repeat(np.array(values, np.uint8), 3).tobytes()
                fetch.FileStore().put(f"{folder}/images/{vec_id % 3}/t{vec_id}.ppm", b"P6\n8 8\n255\n" + body if vec_id % 40 else b"broken")
                fetch.FileStore().put(f"{folder}/images/{vec_id % 3}/t{vec_id}.txt", b"no image")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["vec_id"])

    rows.mapInArrow(write, "vec_id long").write.parquet(f"{folder}/written")
    return f"{folder}/images"


@query("SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN 6 ELSE 203 END::bigint AS length FROM embeddings WHERE vec_id % 10 = 0 AND vec_id % 20 = 0")
def image_listing(spark, sf_dir):
    """The images below a folder, by suffix, that another listing has too."""
    found = readers.image_files(spark, _images(spark, sf_dir), "*.ppm").select("path", "length")
    known = found.where(F.regexp_extract("path", r"t(\d+)\.ppm$", 1).cast("long") % 20 == 0).select("path")
    return readers.existing(found, "path", known).select(F.regexp_extract("path", r"t(\d+)\.ppm$", 1).cast("long").alias("vec_id"), "length")


@query(f"{_DECODED} SELECT vec_id, vec_id % 40 <> 0 AS ok, CASE WHEN vec_id % 40 = 0 THEN 0.0 ELSE round(avg(v), 3) END AS mean, CASE WHEN vec_id % 40 = 0 THEN 0.0 ELSE round(stddev_pop(v), 3) END AS deviation FROM p WHERE (i - 1) // 8 < 4 AND (i - 1) % 8 < 4 GROUP BY 1")
def extract_vectors(spark, sf_dir):
    """Vectors of images in two runs, the second of which skips what the first has; a broken image counts as a black one."""
    files = readers.image_files(spark, _images(spark, sf_dir), "*.ppm")
    path = _scratch(spark)
    images.extract(files.where("path like '%0.ppm' and path rlike '/[01]/'"), images.MeanColour(), "none").write.parquet(f"{path}/1")
    images.extract(files, images.MeanColour(), "none", spark.read.parquet(f"{path}/1")).write.parquet(f"{path}/2")
    got = spark.read.parquet(f"{path}/1", f"{path}/2")
    return got.select(F.regexp_extract("path", r"t(\d+)\.ppm$", 1).cast("long").alias("vec_id"), "ok", F.round(F.col("vector")[0].cast("double"), 3).alias("mean"), F.round(F.col("vector")[3].cast("double"), 3).alias("deviation"))


@query("SELECT vec_id, unique_id FROM tiles WHERE unique_id = (SELECT unique_id FROM tiles WHERE vec_id = 17)", "tiles")
def point_lookup(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    wanted = tiles.where("vec_id = 17").first()["unique_id"]
    return documents.scan(tiles, documents.TermFilter(unique_id=wanted).build(), ["vec_id", "unique_id"], 1)


@query("SELECT unique_id FROM tiles WHERE modality = 'stained' AND filename LIKE '%-512' AND tissue_type IS NOT NULL ORDER BY unique_id", "tiles")
def condition_scan(spark, sf_dir):
    """The ids that a condition in words selects, in order; columns that aren't there are dropped without a complaint."""
    tiles = view(spark, sf_dir, "tiles").drop("vector", "no_such_column")
    return documents.scan(tiles, F.expr("modality = 'stained' and endswith(filename, '-512')") & F.col("tissue_type").isNotNull(), ["unique_id"]).orderBy("unique_id")


@query("SELECT p.unique_id, t.vec_id, p.cluster FROM preds p JOIN tiles t ON t.tile_key = p.tile_key", "preds", "tiles")
def tile_key_join(spark, sf_dir):
    return view(spark, sf_dir, "preds").select("tile_key", "unique_id", "cluster").join(view(spark, sf_dir, "tiles").select("tile_key", "vec_id"), "tile_key").select("unique_id", "vec_id", "cluster")


@query(f"WITH {NEAREST} SELECT cluster, i AS dim, round(avg(cast(vector[i] as double)), 6) AS value FROM nearest, range(1, 65) AS r(i) GROUP BY 1, 2", "tiles")
def incremental_model(spark, sf_dir):
    """Centres after a stream's first batch: the means of the rows that were nearest; a model that goes on from its files has them too."""
    path, rows = _scratch(spark), label_centers(spark, sf_dir).orderBy("cluster").collect()
    view(spark, sf_dir, "tiles").select("vec_id", "vector").coalesce(1).write.parquet(f"{path}/in")
    start = np.array([r["center"] for r in rows])
    model = micro.IncrementalModel(start, f"{path}/model", spark)
    stream = micro.read_stream(spark, f"{path}/in", "vec_id long, vector array<float>", 1)
    micro.run_batches(stream, model.update, f"{path}/state").awaitTermination()
    held = micro.IncrementalModel(start, f"{path}/model", spark).centers
    return spark.createDataFrame([(c, i + 1, float(round(x, 6))) for c, center in enumerate(held) for i, x in enumerate(center)], "cluster int, dim long, value double")
