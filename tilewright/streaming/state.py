"""Streams that know their keys: the first row of each key by keyed state, so that a batch costs what it holds and not what the sink holds."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import kmeans

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class FirstOfKey(StatefulProcessor):
    """Passes on one row of a key that it hasn't seen, the smallest of a batch's, and remembers the key for ttl milliseconds (None: for good)."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "there boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, ttl_seconds: float | None = None, seen: DataFrame | None = None) -> DataFrame:
    """One row of each key, in the batch that brings it first; rows without a key are left out. Pass narrow rows.

    ttl_seconds: how long a key is remembered, so that state is bounded by the keys of that time; a key that comes later than that is new.
    seen: a frame with keys that count as seen when the query is first started; it isn't read again. State is kept by key and lies in the checkpoint; start the
    query under state_store().
    """
    rows = stream.where(F.col(key).isNotNull()).groupBy(key)
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)
    known = None if seen is None else seen.where(F.col(key).isNotNull()).select(key).distinct().groupBy(key)
    return rows.transformWithState(FirstOfKey(ttl), stream.schema, "append", "none" if ttl is None else "processingTime", initialState=known)


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started here keep their state in RocksDB, outside the heap."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_until_idle(query: StreamingQuery, poll: float = 0.2) -> None:
    """Wait until a query has read all that its sources hold, then stop it. Queries with a time to live run empty batches for ever otherwise.

    The first batch after a restart may be an empty one that was stopped before, so two in a row must be empty.
    """
    while query.isActive:
        last = query.recentProgress[-2:]
        if len(last) == 2 and all(s["startOffset"] == s["endOffset"] for p in last for s in p["sources"]):
            query.stop()
        query.awaitTermination(poll)
    if (error := query.exception()) is not None:
        raise error


def write_batches(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch in a folder of its own, replaced if the batch is run again: path/run=(of the checkpoint)/batch=(its number)."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    writer = rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={n}")).option("checkpointLocation", checkpoint)
    with state_store(rows.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def predict_once(stream: DataFrame, centers: np.ndarray, path: str, checkpoint: str, ext: DataFrame | None = None, modality: str = "stained", ttl_seconds: float | None = None) -> StreamingQuery:
    """Predictions in a folder, one for each unique_id, also after restarts, replays and with a new checkpoint.

    What was seen is kept as state by id: no batch reads the folder. It is read once, when a checkpoint is new: the ids in it count as seen.
    Use run_until_idle() on the query where a time to live is given.
    """
    spark = stream.sparkSession
    rows = kmeans.predictions(stream.where(F.col("modality") == modality), centers, ext, modality)
    seen = None
    if _is_there(spark, path):
        seen = spark.read.parquet(path).select("unique_id")
    return write_batches(first_of_key(rows, "unique_id", ttl_seconds, seen), path, checkpoint)


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/batch=*/*.parquet")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0
