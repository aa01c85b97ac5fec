"""Tables and files written: replaced, created, appended, chunked, bucketed; manifests; models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "unique_id string, id string, slide_key string, tile_key string, short_box_name string, box_id string, cluster int"


def create_table_once(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table of this name, made from Parquet files if it isn't there."""
    from .readers import read_parquet

    if not spark.catalog.tableExists(name):
        read_parquet(spark, path).write.saveAsTable(name)
    return spark.table(name)


def replace_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64) -> None:
    """bucket_by takes the place of an index: joins and look-ups on it need no exchange, or one bucket."""
    writer = df.write.mode("overwrite")
    (writer.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else writer).saveAsTable(name)


#: The fields of the document table.
DOCUMENTS = "unique_id string, block_id string, box_id string, created_at string, dataset string, dataset_version string, dimension int, filename string, id string, modality string, model string, preprocessing string, scan_date string, slice_id string, slide_key string, tile_type string, tissue_type string, cluster string, vector array<float>"


def create_documents(spark: SparkSession, name: str, anew: bool = False, buckets: int = 64) -> None:
    """The document table, bucketed by its key; anew: without what it held."""
    if anew:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({DOCUMENTS}) USING parquet CLUSTERED BY (unique_id) INTO {buckets} BUCKETS")


def create_predictions(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PREDICTIONS}) USING parquet")


def append(df: DataFrame, name: str) -> None:
    df.select(*df.sparkSession.table(name).columns).write.mode("append").insertInto(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int | None = None, bloom_on: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer = writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer
    writer = writer.option(f"parquet.bloom.filter.enabled#{bloom_on}", "true") if bloom_on else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file, for reports; for large results leave out coalesce by writing Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def merge_manifest(done: DataFrame, new: DataFrame, path: str) -> None:
    """The sorted union of two sets of processed names, as text."""
    done.select(F.col(done.columns[0]).alias("value")).union(new.select(F.col(new.columns[0]))).distinct().orderBy("value").write.mode("overwrite").text(path)


def export_paths(df: DataFrame, path_col: str, path: str) -> None:
    df.select(F.col(path_col).alias("value")).write.mode("overwrite").text(path)


def save_centers(spark: SparkSession, centers: np.ndarray, path: str, **about) -> None:
    """A row per cluster: cluster, center, and what is known about the model as JSON."""
    rows = [(i, [float(x) for x in c], json.dumps(about, sort_keys=True)) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cluster int, center array<double>, about string").coalesce(1).write.mode("overwrite").parquet(path)


def load_centers(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["center"] for r in spark.read.parquet(path).orderBy("cluster").collect()])


def model_name(k: int, modality: str, least_tissue: float = 0) -> str:
    """One name for training and prediction."""
    return f"kmeans_{modality}_k{k}" + (f"_tissue{least_tissue:g}" if least_tissue else "")


def write_version(df: DataFrame, path: str, keep: int = 3) -> int:
    """Write df as the next version of a table (a folder a version, complete or not there) and remove all but the last `keep`; its number."""
    version = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    spark = df.sparkSession
    for old in versions(spark, path)[:-keep]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return version


def versions(spark, path: str) -> list[int]:
    """The complete versions of a table, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
