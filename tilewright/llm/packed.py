"""Records as bytes: many narrow rows are dealt out by key as a few rows of packed NumPy records, which Spark shuffles without touching them."""

from __future__ import annotations

import ctypes
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of records that a task holds before it passes them on, and that one part should hold.
FLUSH = PART = 1 << 23


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def released() -> None:
    """Give the memory that is free back to the system: a worker goes on to other tasks, or stays idle beside others for a minute."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def parts_for(df: DataFrame, total_bytes: int) -> int:
    """So many parts that each holds about PART bytes, and as many as the session shuffles to at least."""
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // PART)))


def rounds_for(total_bytes: int, most: int) -> int:
    """In how many rounds to deal out so many bytes: one for each half a gigabyte, `most` at most. Small tables need no rounds to spare disk."""
    return max(1, min(most, total_bytes >> 29))


def deal(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], use: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, parts: int, thin: Callable[[np.ndarray], np.ndarray] | None = None, key: Callable[[np.ndarray], np.ndarray] = operator.itemgetter("k")) -> DataFrame:
    """make: structured arrays from batches of df; key: the unsigned 64-bit key of each record, by default its field "k". Records of a key meet in one call of use, with those of
    other keys, in no order. thin: what of a batch of records is passed on; it may drop what use doesn't need only."""

    def spread(batches):
        held, size = [], 0
        for records in make(batches):
            held.append(records)
            size += records.nbytes
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)
        held.clear()
        released()

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        records = np.concatenate(held)
        if thin is not None:
            records = thin(records)
        p = ((key(records) >> np.uint64(16)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(p, kind="stable")
        records, p = records.take(order), p[order]  # take() copies records as they are, indexing goes by field
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(p)), bool), p[1:] != p[:-1]]))
        raw = pa.py_buffer(records.tobytes())
        edges = pa.py_buffer((np.append(at, len(records)) * records.itemsize).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(p[at].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(at), [None, edges, raw])], names=["p", "data"])

    def gather(batches):
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(p, []).append(data)
        for p in sorted(found):
            yield from use(b"".join(found.pop(p)))
        released()

    return df.mapInArrow(spread, "p int, data binary").repartition(parts, "p").mapInArrow(gather, schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))
