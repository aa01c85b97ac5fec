"""What streams report of their batches, as rows: a listener that writes each report, and rolling means over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "id string, run_id string, name string, batch long, at string, rows long, seconds double, rows_per_second double, state_rows long, event string, error string"


class ProgressLog(StreamingQueryListener):
    """Writes a file of one JSON row for each batch of any query of the session, and one when a query ends; in a folder that any reader sees.

    Files are named by run and batch, so a report that comes twice is one row. Add it with spark.streams.addListener().
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = (p.durationMs or {}).get("triggerExecution", 0) / 1000
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self._write(f"{p.runId}-{p.batchId:09d}", {"id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "seconds": seconds, "rows_per_second": p.numInputRows / seconds if seconds else None, "state_rows": state, "event": "batch", "error": None})

    def onQueryTerminated(self, event) -> None:
        self._write(f"{event.runId}-end", {"id": str(event.id), "run_id": str(event.runId), "event": "end", "error": event.exception})

    def _write(self, name: str, row: dict) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(json.dumps(row).encode())
        out.close()


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(f"{folder}/*.json").withColumn("at", F.to_timestamp("at"))


def rolling(progress: DataFrame, columns: list[str], last: int = 5, by: str = "run_id", order: str = "batch", digits: int = 6) -> DataFrame:
    """progress with the mean of each column over a batch and those before it, `last` in all (fewer at the start), as rolling_<column>."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - last, 0)
    return progress.select("*", *(F.round(F.avg(c).over(w), digits).alias(f"rolling_{c}") for c in columns))


def totals(progress: DataFrame, by: str = "run_id") -> DataFrame:
    """Of each run its batches, rows, seconds, mean seconds of a batch with rows, and rows a second."""
    done = progress.where("event = 'batch'")
    return done.groupBy(by).agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.avg(F.when(F.col("rows") > 0, F.col("seconds"))).alias("mean_seconds"), F.try_divide(F.sum("rows"), F.sum("seconds")).alias("rows_per_second"))
