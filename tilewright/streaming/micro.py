"""Micro-batch forms of ingest, prediction and training: file streams whose batches can be replayed without doubling rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents, kmeans
from ..sources import sinks
from ..sources.keyed import KeyedTable


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8, after: str | None = None, archive: str | None = None) -> DataFrame:
    """New Parquet files of a folder; after: what becomes of read ones (archive, delete)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("cleanSource", after) if after else reader
    return (reader.option("sourceArchiveDir", archive) if archive else reader).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def predict_stream(stream: DataFrame, centers: np.ndarray, out: str, checkpoint: str, ext: DataFrame | None = None, modality: str = "stained") -> StreamingQuery:
    """Predictions appended to a table; a batch that comes twice adds nothing, as what is there is left out."""

    def each(batch: DataFrame, _: int) -> None:
        sinks.create_predictions(batch.sparkSession, out)
        got = kmeans.predict_rest(documents_once(batch), batch.sparkSession.table(out), centers, ext, modality)
        sinks.append(got, out)

    return run_batches(stream, each, checkpoint)


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "unique_id") -> StreamingQuery:
    """Documents appended to a table unless their key is there."""

    def each(batch: DataFrame, _: int) -> None:
        rows = documents_once(batch, key)
        if batch.sparkSession.catalog.tableExists(out):
            documents.new_documents(rows, batch.sparkSession.table(out), key).write.mode("append").saveAsTable(out)
        else:
            rows.where(F.col(key).isNotNull()).write.saveAsTable(out)

    return run_batches(stream, each, checkpoint)


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "stream", order: str | None = None) -> StreamingQuery:
    """Rows merged into a keyed table, a commit a batch; a batch that comes twice changes nothing, as its number is in the table's log."""
    return run_batches(stream, lambda batch, n: table.upsert(batch, order, (writer, n)), checkpoint)


def documents_once(batch: DataFrame, key: str = "unique_id") -> DataFrame:
    return batch.dropDuplicates([key])


class IncrementalModel:
    """Mini-batch k-means over the batches of a stream; centres and counts are k rows and live on the driver.

    With a path, the state after each batch is written there (a folder a batch, the last two stay), and a model with the same path goes on from
    it: after a restart the stream's checkpoint skips the batches that the state has seen, and a replayed one changes nothing.
    """

    def __init__(self, centers: np.ndarray, path: str | None = None, spark: SparkSession | None = None):
        self.centers, self.counts, self.seen, self.path = np.asarray(centers, float), np.zeros(len(centers)), -1, path
        if path and spark is not None:
            for batch in sorted(self._batches(spark), reverse=True)[:1]:
                rows = spark.read.parquet(f"{path}/{batch}").orderBy("cluster").collect()  # k rows
                self.centers, self.counts, self.seen = np.array([r["center"] for r in rows]), np.array([r["n"] for r in rows]), batch

    def _batches(self, spark: SparkSession) -> list[int]:
        """The batches whose state was written in full."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [f.getPath() for f in files.listStatus(at)]
        return [int(p.getName()) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.seen:  # replayed
            return
        n, sums, _ = kmeans.cluster_sums(batch, self.centers)
        self.centers, self.counts = kmeans.mini_batch(self.centers, self.counts, sums, n)
        self.seen = batch_id
        if self.path:
            spark = batch.sparkSession
            rows = [(i, c.tolist(), float(m)) for i, (c, m) in enumerate(zip(self.centers, self.counts))]
            spark.createDataFrame(rows, "cluster int, center array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
            files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for old in sorted(self._batches(spark))[:-2]:
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows per window and keys, for a stream with late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("count"))
