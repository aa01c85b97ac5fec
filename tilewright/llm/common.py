"""What the operators of this subpackage share: reading tables, cutting lineage, mapping over whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.lineage import cut as cut
from ..functions.lineage import shared_dir, shuffles_removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc_id (long, unique, not null) and text of each row of docs. Where ids are repeated or null, rows are numbered in the order of id (nulls
    last) and text instead, and the second frame has _row, the number, and doc_id, the id; else it is None."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows, None
    rows = cut(rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_row", F.monotonically_increasing_id()))
    return rows.select(F.col("_row").alias("doc_id"), "text"), rows.select("_row", "doc_id")


class Scratch:
    """Parquet tables in the shared folder, for what is read more than once; drop() removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        self.paths.append(path)
        with shuffles_removed(self.spark):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, all_but: int = 0) -> None:
        """Remove the tables, but for the last all_but."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = self.paths[: len(self.paths) - all_but]
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = self.paths[len(gone) :]


BITMAP = 1 << 24


def bitmap_of(rows: DataFrame, key: str) -> np.ndarray:
    """BITMAP bits (2 MB, however many rows), set at a long column of hashes: a row whose bit isn't set is surely not among rows."""
    slot = rows.select(F.shiftright(key, 16).bitwiseAND(F.lit(BITMAP - 1)).alias("slot"))
    parts = slot.selectExpr("cast(slot div 32 as int) at", "shiftleft(1L, cast(slot % 32 as int)) v").groupBy("at").agg(F.bit_or("v").alias("v")).toArrow()
    bitmap = np.zeros(BITMAP // 32, np.uint32)
    bitmap[parts.column("at").to_numpy()] = parts.column("v").to_numpy().astype(np.uint32)
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set: of all that bitmap_of() saw, and of few others."""
    at = hashes.astype(np.int64) >> np.int64(16) & np.int64(BITMAP - 1)
    return (bitmap[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)


def maybe_in(bitmap: np.ndarray, key: str) -> Column:
    """in_bitmap() of a long column without nulls."""
    shared = SparkSession.active().sparkContext.broadcast(bitmap)
    return pandas_udf(lambda h: pd.Series(in_bitmap(shared.value, h.to_numpy())), "boolean")(F.col(key))


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list, list], dict], schema: str) -> DataFrame:
    """Apply fn(ids, texts) to Arrow batches of the two columns; null texts arrive as the empty string.

    fn returns columns by name. Only the two columns reach Python, so other columns, whatever their names, cost nothing.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 1):
                got = fn(part.column(0).to_pylist(), ["" if t is None else t for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=types[n]) for n in names], names=names)

    types = arrow_types(schema)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of key, from narrow rows (pass ids, not texts).

    Rows whose hash is too large to be among them are left out where they are, so that what meets in one task doesn't grow with the table.
    """
    space = 1 << 40
    h = F.pmod(F.xxhash64(key), F.lit(space))
    n = rows.count()
    below = space if n <= 2 * most else int(space * (most + 8 * most**0.5 + 16) / n)
    return rows.where(h < F.lit(below)).orderBy(h, key).limit(most)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    return {n: ARROW[t] for n, t in (x.split() for x in schema.split(","))}


def split_batch(batch: pa.RecordBatch, text_at: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text each (a row at least), so that memory doesn't follow the batch."""
    n = batch.num_rows
    if not n:
        return
    rows = max(1, min(n, int(n * most / max(1, batch.column(text_at).nbytes))))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)
