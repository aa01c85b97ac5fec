"""Tables from Parquet, CSV, JSON, nested files, manifests, images and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(spark: SparkSession, source: str, columns: list[str] | None = None) -> DataFrame:
    """`table:<name>` from the catalogue, else files by their suffix (parquet, csv, json), a folder as Parquet. Columns are pruned at the scan."""
    if source.startswith("table:"):
        got = spark.table(source.removeprefix("table:"))
    elif source.endswith(".csv"):
        got = read_csv(spark, source)
    elif source.endswith((".json", ".jsonl")):
        got = spark.read.json(source)
    elif source.endswith((".pkl", ".pickle")):
        raise ValueError("pickles are not read; convert them to Parquet or JSON")
    else:
        got = read_parquet(spark, source)
    return got if columns is None else got.select(*columns)


def read_parquet(spark: SparkSession, *paths: str, union_by_name: bool = True, partitions_as_columns: bool = False) -> DataFrame:
    """Files united by column name; folder names don't become columns unless asked for."""
    reader = spark.read.option("mergeSchema", str(union_by_name).lower())
    if not partitions_as_columns:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def with_file(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def file_metadata(path: Column) -> list[Column]:
    """k, min_samples, the run's folder and whether components were reduced, from a result file's path; null where the name has none."""
    number = lambda p: F.regexp_extract(path, p, 1)
    as_int = lambda p: F.when(number(p) != "", number(p).cast("int"))
    return [as_int(r"_k(\d+)").alias("k"), as_int(r"min_samples_(\d+)").alias("min_samples"), F.try_element_at(F.split(path, "/"), F.lit(-2)).alias("run_name"), path.contains("with_pca").alias("apply_pca")]


def metric_files(spark: SparkSession, paths: dict[str, str], schema: str | None = None) -> DataFrame | None:
    """The metric tables of several models, with their name; files that can't be read are left out."""
    from pyspark.errors import AnalysisException

    out = None
    for model, path in paths.items():
        try:
            one = read_csv(spark, path, schema).withColumn("model", F.lit(model))
        except AnalysisException:
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


#: The nested layout of generated vectors: a map from modality to samples with their vectors.
NESTED = "map<string, array<struct<id:string, created_at:string, metadata:struct<tissue_type:string, block_id:string, slice_id:string, scan_date:string, box_id:string, filename:string, tile_type:string>, embeddings:array<struct<metadata:struct<preprocessing:string, dimension:int, model:string>, created_at:string, vector:array<float>>>>>>"


def flatten_nested(df: DataFrame, column: str = "data") -> DataFrame:
    """A row for each vector, with the metadata of its sample."""
    samples = df.select(F.explode(column).alias("modality", "samples")).select("modality", F.explode("samples").alias("s"))
    rows = samples.select("modality", F.col("s.id").alias("id"), F.col("s.metadata").alias("m"), F.explode("s.embeddings").alias("e"))
    key = F.concat_ws("_", *(F.col(f"m.{n}") for n in ("tissue_type", "block_id", "slice_id", "scan_date", "box_id", "filename")))
    return rows.select(key.alias("slide_key"), "modality", "e.metadata.preprocessing", "e.metadata.dimension", "e.metadata.model", "e.vector", "id", "m.*")


def image_files(spark: SparkSession, path: str, pattern: str = "*.tiff") -> DataFrame:
    """path, modificationTime, length and content of the images below a folder, local or in an object store."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def path_list(spark: SparkSession, manifest: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Sorted object paths from a text or Parquet manifest: the last comma-separated field of each line, with prefix and suffix."""
    lines = spark.read.text(manifest) if not manifest.endswith(".parquet") else spark.read.parquet(manifest).toDF("value")
    key = F.trim(F.element_at(F.split("value", ","), -1))
    full = F.when(key.startswith(prefix), key).otherwise(F.concat(F.lit(prefix), key))
    return lines.where(F.col("value").isNotNull() & (key != "")).select(F.when(full.endswith(suffix), full).otherwise(F.concat(full, F.lit(suffix))).alias("path")).orderBy("path")


def existing(df: DataFrame, path_col: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is in a listing (a frame with path)."""
    return df.join(listing.select(F.col("path").alias(path_col)), path_col, "left_semi")


def match_files(spark: SparkSession, paths: list[str] | str, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of many Parquet files whose key is known, with file; and a row a file: rows, matched and missing (rows without a known key)."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).withColumn("file", F.col("_metadata.file_path"))
    there = known.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    marked = rows.join(there, F.col(key) == F.col("_key"), "left")
    report = marked.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count("_key").alias("matched"), F.count_if(F.col("_key").isNull()).alias("missing"))
    return marked.where("_key is not null").drop("_key"), report
