"""Results that are kept: a frame is computed once and read again, until its plan or one of its input files changes."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """Results in a folder, by name. An entry is used if it was made by the same plan from the same files (path, length and time); else it is made anew
    and takes the place of the old one. What a plan doesn't show counts as unchanged: give it as `depends` (parameters of a Python function, a model)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, name: str, rows: DataFrame, depends: object = None) -> DataFrame:
        """rows, from the cache where it has them."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise ValueError(f"no name for a result: {name}")
        digest = self.digest(rows, depends)
        path = f"{self.folder}/{name}/{digest}"
        if not self.holds(name, digest):
            rows.write.mode("overwrite").parquet(path)  # complete with its _SUCCESS, or not there
            for other in self._list(f"{self.folder}/{name}"):
                if other.getName() != digest:
                    self._fs().delete(other, True)
        return self.spark.read.schema(rows.schema).parquet(path)

    def holds(self, name: str, digest: str) -> bool:
        return self._fs().exists(self._at(f"{self.folder}/{name}/{digest}/_SUCCESS"))

    def fresh(self, name: str, rows: DataFrame, depends: object = None) -> bool:
        """Whether get() would read the cache."""
        return self.holds(name, self.digest(rows, depends))

    def drop(self, name: str) -> None:
        self._fs().delete(self._at(f"{self.folder}/{name}"), True)

    def digest(self, rows: DataFrame, depends: object = None) -> str:
        """Of the plan without the numbers that Spark gives to columns, the schema, `depends`, and the input files."""
        plan = rows._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        plan = re.sub(r"#\d+L?|plan_id=\d+|\[id=\d+\]|@[0-9a-f]{4,}", "", plan)
        files = []
        for path in sorted(rows.inputFiles()):
            at = self._at(path)
            status = at.getFileSystem(self._conf()).getFileStatus(at)
            files.append(f"{path} {status.getLen()} {status.getModificationTime()}")
        return hashlib.sha256("\n".join([plan, rows.schema.json(), repr(depends), *files]).encode()).hexdigest()[:32]

    def _list(self, path: str) -> list:
        at = self._at(path)
        return [s.getPath() for s in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        return self._at(self.folder).getFileSystem(self._conf())
