"""A table of rows by key, in hashed buckets behind a commit log: an upsert, update or delete rewrites the buckets that hold a touched key, and no other.

A commit is one file that names the folder of each bucket. Changed buckets are written to new folders first; then the commit's file is moved to the next
version's name, which fails where another writer was first. So a reader sees the table before a commit or after it, and what a writer that died has left
is never read. The file system's rename must be atomic and refuse a name that is taken (HDFS and local ones do; plain object stores don't).
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has changed the same buckets meanwhile; nothing was committed."""


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key: the first 32 bits of its MD5, modulo the number of buckets."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


class KeyedTable:
    """The table in a folder. Keys are unique and not null: rows without a key are left out, of rows with the same key the last by `order` counts.

    buckets: fixed when the table is made; such that one task can rewrite a bucket (its size is the table's divided by them).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not self._versions():
            raise FileNotFoundError(path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 256, order: str | None = None) -> KeyedTable:
        """Write rows as the first version of a new table."""
        table = cls.__new__(cls)
        table.spark, table.path = rows.sparkSession, path
        if table._versions():
            raise FileExistsError(path)
        base = {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.json(), "dirs": {}, "txn": {}}
        folder, n = table._written(table._bucketed(table._once(rows, key, order), base), table._folder())
        table._commit(base | {"operation": "create"}, folder, None, n)
        return table

    # --- reading

    def state(self, version: int | None = None) -> dict:
        """A commit: version, key, buckets, schema, dirs (bucket to folder), operation, rewritten (buckets) and rows (written)."""
        versions = self._versions()
        version = versions[-1] if version is None else version
        if version not in versions:
            raise ValueError(f"no version {version}")
        return json.loads(self.spark.read.text(f"{self.path}/_log/{version:012d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        return self._files(state, state["dirs"])

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows with one of these keys; only the files of their buckets are read."""
        state = self.state(version)
        keys = keys.select(state["key"])
        return self._files(state, self._touched(keys, state)).join(keys, state["key"], "left_semi")

    def history(self) -> DataFrame:
        """A row a commit: version, operation, rewritten (buckets), rows (written)."""
        commits = [self.state(v) for v in self._versions()]
        return self.spark.createDataFrame([(c["version"], c["operation"], len(c["rewritten"]), c["rows"]) for c in commits], "version long, operation string, rewritten int, rows long")

    # --- writing

    def upsert(self, rows: DataFrame, order: str | None = None, txn: tuple[str, int] | None = None) -> dict:
        """Rows replace those with their keys, or are added; columns that the table lacks are added to it, those that rows lack become null where a row is
        replaced. txn: a writer's name and number; a number that was committed before changes nothing. The commit is returned."""
        state = self.state()
        if self._seen(state, txn):
            return state
        schema = self._schema(state)
        more = [f for f in rows.schema if f.name not in schema.names]
        state["schema"] = StructType([*schema, *more]).json()
        rows = self._once(rows, state["key"], order)
        rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(state)))
        return self._merge(state, rows, "upsert", insert=True, txn=txn)

    def update(self, rows: DataFrame, order: str | None = None, txn: tuple[str, int] | None = None) -> dict:
        """The columns of rows are set where their keys are in the table; other keys change nothing."""
        state = self.state()
        unknown = set(rows.columns) - set(self._schema(state).names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        if self._seen(state, txn):
            return state
        return self._merge(state, self._once(rows, state["key"], order), "update", insert=False, txn=txn)

    def delete(self, keys: DataFrame, txn: tuple[str, int] | None = None) -> dict:
        """Rows with one of these keys go."""
        state = self.state()
        if self._seen(state, txn):
            return state
        return self._merge(state, self._once(keys.select(state["key"]), state["key"], None), "delete", insert=False, txn=txn)

    def delete_where(self, condition: Column) -> dict:
        """Rows that fulfil a condition go; buckets without one stay as they are."""
        return self.delete(self.read().where(condition))

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Remove all but the last `keep` versions, and folders that none of these names and that were last written older_than seconds ago; how many
        folders. A writer that takes longer than that to commit would lose its files."""
        versions = self._versions()
        used = {d.split("/")[0] for v in versions[-keep:] for d in self.state(v)["dirs"].values()}
        for v in versions[:-keep]:
            self._fs().delete(self._at(f"_log/{v:012d}.json"), False)
        old = [s for s in self._list("data") if s.getPath().getName() not in used and s.getModificationTime() < (time.time() - older_than) * 1000]
        for s in old:
            self._fs().delete(s.getPath(), True)
        return len(old)

    # --- parts

    def _merge(self, state: dict, rows: DataFrame, operation: str, insert: bool, txn: tuple[str, int] | None) -> dict:
        """Join the touched buckets with rows, bucket by bucket, and write what is left of them."""
        key, names = state["key"], self._schema(state).names
        touched = self._touched(rows, state) if insert else self._holding(rows, state)
        old = self._bucketed(self._files(state, touched), state).alias("o")
        new = self._bucketed(rows, state).withColumn("_given", F.lit(True)).alias("n")
        both = old.join(new, ["_bucket", key], "full_outer" if insert else "left_outer")
        both = both.where("_given is null") if operation == "delete" else both
        value = lambda c: F.when(F.col("_given"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) if c in rows.columns else F.col(f"o.`{c}`")
        left = both.select("_bucket", *(F.col(key) if c == key else value(c) for c in names))
        folder, n = self._written(left, self._folder()) if touched else (None, 0)
        return self._commit(state | {"operation": operation, "txn": state["txn"] | (dict([txn]) if txn else {})}, folder, touched, n, txn)

    def _once(self, rows: DataFrame, key: str, order: str | None) -> DataFrame:
        """A row a key: the last by order, then by a hash of the other columns."""
        if rows.columns == [key]:
            return rows.where(F.col(key).isNotNull()).distinct()
        others = [c for c in rows.columns if c != key]
        rank = F.struct(*([F.col(order)] if order else []), F.xxhash64(*(F.col(c) for c, kind in rows.dtypes if c != key and "map<" not in kind)))
        got = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_row"))
        return got.select(*(F.col(key) if c == key else F.col("_row")[c].alias(c) for c in rows.columns))

    def _bucketed(self, rows: DataFrame, state: dict) -> DataFrame:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.withColumn("_bucket", bucket_of(F.col(state["key"]), state["buckets"])).repartition(parts, "_bucket")

    def _touched(self, rows: DataFrame, state: dict) -> list[str]:
        """The buckets of the keys of rows."""
        return sorted(str(r[0]) for r in rows.where(F.col(state["key"]).isNotNull()).select(bucket_of(F.col(state["key"]), state["buckets"])).distinct().collect())  # at most `buckets`

    def _holding(self, rows: DataFrame, state: dict) -> list[str]:
        """The buckets that hold one of the keys of rows; of their files only the keys are read."""
        there = self._files(state, self._touched(rows, state)).select(state["key"])
        return self._touched(there.join(rows.select(state["key"]), state["key"], "left_semi"), state)

    def _files(self, state: dict, buckets) -> DataFrame:
        dirs = [f"{self.path}/data/{state['dirs'][b]}" for b in buckets if b in state["dirs"]]
        schema = self._schema(state)
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def _schema(self, state: dict) -> StructType:
        return StructType.fromJson(json.loads(state["schema"]))

    def _seen(self, state: dict, txn: tuple[str, int] | None) -> bool:
        return txn is not None and state["txn"].get(txn[0], -1) >= txn[1]

    def _folder(self) -> str:
        return uuid.uuid4().hex

    def _written(self, rows: DataFrame, folder: str) -> tuple[str, int]:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder, seen.get["n"]

    def _commit(self, state: dict, folder: str | None, touched: list[str] | None, rows: int, txn: tuple[str, int] | None = None) -> dict:
        """Move the state with the new folders to the next version's name. Where others came first and changed other buckets, their folders are
        taken over; else nothing is committed."""
        new = {s.getPath().getName().split("=")[1]: f"{folder}/{s.getPath().getName()}" for s in self._list(f"data/{folder}") if "=" in s.getPath().getName()} if folder else {}
        touched = sorted(new) if touched is None else touched
        files, draft = self._fs(), self._at(f"_log/_{uuid.uuid4().hex}")
        context = self._jvm().org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf())
        while True:
            dirs = {b: d for b, d in state["dirs"].items() if b not in touched} | new
            commit = state | {"version": state["version"] + 1, "dirs": dirs, "rewritten": touched, "rows": rows}
            out = files.create(draft, True)
            out.write(json.dumps(commit).encode())
            out.close()
            try:
                context.rename(draft, self._at(f"_log/{commit['version']:012d}.json"), self.spark.sparkContext._gateway.new_array(getattr(self._jvm().org.apache.hadoop.fs, "Options$Rename"), 0))
                return commit
            except Py4JJavaError as e:
                files.delete(draft, False)
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
            theirs = self.state(commit["version"])
            if self._seen(theirs, txn):
                files.delete(self._at(f"data/{folder}"), True)
                return theirs
            if set(theirs["rewritten"]) & set(touched) or theirs["schema"] != state["schema"] or state["version"] == 0:
                if folder:
                    files.delete(self._at(f"data/{folder}"), True)
                raise Conflict(f"version {commit['version']} of {self.path} has changed the same buckets")
            state = state | {"version": theirs["version"], "dirs": theirs["dirs"], "txn": theirs["txn"] | state["txn"]}

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for s in self._list("_log") if (n := s.getPath().getName()).endswith(".json"))

    def _list(self, folder: str) -> list:
        at = self._at(folder)
        return list(self._fs().listStatus(at)) if self._fs().exists(at) else []

    def _jvm(self):
        return self.spark.sparkContext._jvm

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm().org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("_log").getFileSystem(self._conf())
