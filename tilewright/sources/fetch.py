"""Objects of a store as rows: fetched by tasks a few at a time, tried again after growing waits, with a row for each one that failed, and resumed."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, content binary, bytes long, tries int, error string"
_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary()), ("bytes", pa.int64()), ("tries", pa.int32()), ("error", pa.string())])
#: Bytes of content in a batch of rows.
BATCH_BYTES = 1 << 25


class Store(ABC):
    """Where objects are. It is pickled to the tasks; open connections lazily. Errors: FileNotFoundError for what isn't there, which isn't tried
    again, OSError for what may work later."""

    @abstractmethod
    def get(self, path: str) -> bytes: ...

    @abstractmethod
    def put(self, path: str, content: bytes) -> None:
        """Write an object whole: others see all of it or nothing."""

    @abstractmethod
    def size(self, path: str) -> int | None:
        """Bytes of an object, None if it isn't there."""

    @abstractmethod
    def list(self, prefix: str) -> Iterable[str]:
        """The objects below a prefix."""


class FileStore(Store):
    """A local or Hadoop file system or an object store, by paths or URIs."""

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    def get(self, path: str) -> bytes:
        files, at = self._at(path)
        with files.open_input_file(at) as f:
            return f.read()

    def put(self, path: str, content: bytes) -> None:
        files, at = self._at(path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        draft = f"{at}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(draft, compression=None) as f:
            f.write(content)
        files.move(draft, at)

    def size(self, path: str) -> int | None:
        files, at = self._at(path)
        info = files.get_file_info(at)
        return info.size if info.is_file else None

    def list(self, prefix: str) -> Iterable[str]:
        from pyarrow import fs

        files, at = self._at(prefix)
        lead = prefix[: len(prefix) - len(at)] if prefix.endswith(at) else ""
        for info in files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            if info.is_file and not info.path.endswith(".part"):
                yield lead + info.path


def attempt(call: Callable[[], object], tries: int, first_wait: float, longest_wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int, str | None]:
    """What call() gives (None if nothing did), how often it was called, and the last error; waits double up to longest_wait."""
    for n in range(1, tries + 1):
        try:
            return call(), n, None
        except FileNotFoundError:
            return None, n, "missing"
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            sleep(min(longest_wait, first_wait * 2 ** (n - 1)))
    return None, tries, error


def ahead_of(items: Iterator, work: Callable, workers: int, ahead: int) -> Iterator:
    """work() of each item, in order, by some threads; no more than `ahead` results are under way or wait to be taken."""
    with ThreadPoolExecutor(workers) as pool:
        under_way: deque[Future] = deque()
        try:
            for item in items:
                under_way.append(pool.submit(work, item))
                if len(under_way) >= ahead:
                    yield under_way.popleft().result()
            while under_way:
                yield under_way.popleft().result()
        finally:
            for f in under_way:
                f.cancel()


def fetch(paths: DataFrame, store: Store, done: DataFrame | None = None, workers: int = 8, ahead: int = 16, tries: int = 5, first_wait: float = 0.5, longest_wait: float = 30.0, path_col: str = "path") -> DataFrame:
    """path, content, bytes, tries and error for each different path, null paths left out. Content is null where fetching failed, and error says why
    ("missing", or the last error).

    done: an earlier result; what it has without an error isn't fetched again. A task holds `ahead` objects and the batch that it passes on.
    """
    todo = paths.select(F.col(path_col).alias("path")).where("path is not null").distinct()
    if done is not None:
        todo = todo.join(done.where("error is null").select("path"), "path", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(path: str) -> dict:
            content, n, error = attempt(lambda: store.get(path), tries, first_wait, longest_wait)
            return {"path": path, "content": content, "bytes": None if content is None else len(content), "tries": n, "error": error}

        yield from _batched(ahead_of((p for b in batches for p in b.column(0).to_pylist()), one, workers, ahead), _ARROW, lambda r: r["bytes"] or 0)

    return todo.mapInArrow(run, SCHEMA)


def _batched(rows: Iterator[dict], schema: pa.Schema, weight: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def fetch_into(paths: DataFrame, store: Store, folder: str, **options) -> DataFrame:
    """fetch() into Parquet files of a folder, a run a subfolder, and go on where earlier runs stopped: what they have isn't fetched again, what
    failed is. The whole folder is returned, with run; latest() gives a row a path."""
    spark = paths.sparkSession
    done = read_fetched(spark, folder)
    run = 0 if done is None else (done.agg(F.max("run")).first()[0] + 1)
    fetch(paths, store, None if done is None else done.select("path", "error"), **options).write.parquet(f"{folder}/run={run}")
    return read_fetched(spark, folder)


def read_fetched(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of fetch_into(); None before the first complete run."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return None
    return spark.read.option("basePath", folder).schema(f"{SCHEMA}, run int").parquet(*(str(f.getPath().getParent().toString()) for f in found))


def latest(fetched: DataFrame) -> DataFrame:
    """A row a path: the one that was fetched, else the last failure."""
    rank = F.struct(F.col("error").isNull(), F.col("run"))
    return fetched.groupBy("path").agg(F.max_by(F.struct("content", "bytes", "tries", "error"), rank).alias("r")).select("path", "r.*")


def download(paths: DataFrame, store: Store, target: Store, target_col: str = "target", path_col: str = "path", workers: int = 8, ahead: int = 16, tries: int = 5, first_wait: float = 0.5, longest_wait: float = 30.0) -> DataFrame:
    """Copy objects from a store to another: path, target, bytes, status (written, there, failed) and error. A target that is there with the
    size of its source is left alone, so a run that was stopped goes on."""
    schema = pa.schema([("path", pa.string()), ("target", pa.string()), ("bytes", pa.int64()), ("status", pa.string()), ("error", pa.string())])

    def copy(path: str, to: str) -> tuple[int, str]:
        size = store.size(path)
        if size is None:
            raise FileNotFoundError(path)
        if target.size(to) == size:
            return size, "there"
        content = store.get(path)
        target.put(to, content)
        return len(content), "written"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(both: tuple[str, str]) -> dict:
            got, _, error = attempt(lambda: copy(*both), tries, first_wait, longest_wait)
            return {"path": both[0], "target": both[1], "bytes": got and got[0], "status": got[1] if got else "failed", "error": error}

        yield from _batched(ahead_of((p for b in batches for p in zip(*(c.to_pylist() for c in b.columns))), one, workers, ahead), schema, lambda r: 0)

    pairs = paths.select(F.col(path_col).alias("path"), F.col(target_col).alias("target")).where("path is not null and target is not null").distinct()
    return pairs.mapInArrow(run, "path string, target string, bytes long, status string, error string")


def list_objects(prefixes: DataFrame, store: Store, suffix: str = "", prefix_col: str = "prefix") -> DataFrame:
    """The paths below each prefix that end with suffix, a task a prefix or more; put prefixes fine enough that one task can list each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                yield from _batched(({"path": p} for p in store.list(prefix) if p.endswith(suffix)), pa.schema([("path", pa.string())]), lambda r: 0)

    return prefixes.select(F.col(prefix_col)).where(F.col(prefix_col).isNotNull()).distinct().mapInArrow(run, "path string")
