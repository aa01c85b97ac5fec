"""The keyed table against a dictionary; what is rewritten and read; writers that die, meet or come twice."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import documents
from tilewright.sources.keyed import Conflict, KeyedTable
from tilewright.streaming import micro


def bucket(key, buckets):
    return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % buckets


def frame(spark, rows, schema="k string, a int, b string"):
    return spark.createDataFrame(rows, schema)


def content(table, version=None):
    return {r["k"]: tuple(r)[1:] for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"k{i}", i, f"b{i}") for i in range(60)] + [(None, 1, "no key")]
    return KeyedTable.create(frame(spark, rows), str(tmp_path / "table"), "k", 16)


def test_against_a_dictionary(spark, table):
    rng, model = random.Random(4), {f"k{i}": (i, f"b{i}") for i in range(60)}
    assert content(table) == model
    for step in range(4):
        some = {f"k{rng.randrange(90)}": (rng.randrange(1000), f"s{step}") for _ in range(7)}
        commit = table.upsert(frame(spark, [(k, *v) for k, v in some.items()] + [(None, 0, "")]))
        model |= some
        assert content(table) == model
        assert set(commit["rewritten"]) == {str(bucket(k, 16)) for k in some}
        assert commit["rows"] == sum(str(bucket(k, 16)) in commit["rewritten"] for k in model)
    keys = [f"k{i}" for i in range(0, 200, 5)]
    commit = table.update(frame(spark, [(k, -1) for k in keys], "k string, a int"))
    model = {k: (-1, v[1]) if k in keys else v for k, v in model.items()}
    assert content(table) == model
    assert set(commit["rewritten"]) == {str(bucket(k, 16)) for k in keys if k in model}
    commit = table.delete(frame(spark, [("k1",), ("k2",), ("gone",), (None,)], "k string"))
    model = {k: v for k, v in model.items() if k not in ("k1", "k2")}
    assert content(table) == model and len(commit["rewritten"]) == len({bucket("k1", 16), bucket("k2", 16)})
    table.delete_where(F.col("b") == "s3")
    model = {k: v for k, v in model.items() if v[1] != "s3"}
    assert content(table) == model
    assert table.update(frame(spark, [("nobody", 1)], "k string, a int"))["rewritten"] == []
    assert content(table, 1) == {f"k{i}": (i, f"b{i}") for i in range(60)}
    assert [r["operation"] for r in table.history().orderBy("version").collect()] == ["create", "upsert", "upsert", "upsert", "upsert", "update", "delete", "delete", "update"]


def test_of_repeated_keys_the_last_counts(spark, table):
    rows = frame(spark, [("k0", 5, "x"), ("k0", 9, "y"), ("k0", 7, "z")])
    table.upsert(rows, order="a")
    assert content(table)["k0"] == (9, "y")
    table.upsert(rows)
    assert content(table)["k0"] in {(5, "x"), (9, "y"), (7, "z")} and table.read().where("k = 'k0'").count() == 1


def test_columns_that_are_new_or_missing(spark, table):
    table.upsert(frame(spark, [("k3", 1.5), ("new", 2.5)], "k string, c double"))
    got = content(table)
    assert got["k3"] == (None, None, 1.5) and got["new"] == (None, None, 2.5) and got["k4"] == (4, "b4", None)
    with pytest.raises(ValueError, match="unknown"):
        table.update(frame(spark, [("k3", 1)], "k string, zzz int"))


def test_only_the_buckets_of_keys_are_read(spark, table):
    got = table.get(frame(spark, [("k7",), ("nobody",)], "k string"))
    assert [r["a"] for r in got.collect()] == [7]
    assert {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()} == {str(bucket(k, 16)) for k in ("k7", "nobody")}
    assert len(table.read().inputFiles()) > 2


class Died(Exception):
    pass


def test_a_writer_that_dies_changes_nothing(spark, table, monkeypatch):
    before, held = content(table), table.read()
    rows = frame(spark, [("k0", -5, "x"), ("more", 1, "y")])

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", die)  # the files are written, the commit isn't
        with pytest.raises(Died):
            table.upsert(rows)
    assert content(table) == before and KeyedTable(spark, table.path).state()["version"] == 1
    table.upsert(rows)
    assert content(table) == before | {"k0": (-5, "x"), "more": (1, "y")}
    assert {r["k"]: tuple(r)[1:] for r in held.collect()} == before  # a reader keeps what it has begun with
    assert table.vacuum(keep=2, older_than=3600) == 0
    assert table.vacuum(keep=2, older_than=-60) == 1  # what the dead writer left
    assert content(table) == before | {"k0": (-5, "x"), "more": (1, "y")} and content(table, 1) == before
    assert table.vacuum(keep=1, older_than=-60) == 0 and len(table.history().collect()) == 1  # the first folder still holds buckets that are in use


def meeting(monkeypatch, other):
    """Let another writer commit while one is about to."""
    own = KeyedTable._commit
    with monkeypatch.context() as m:

        def commit(self, *args):
            m.setattr(KeyedTable, "_commit", own)
            other()
            return own(self, *args)

        m.setattr(KeyedTable, "_commit", commit)
        yield


def test_writers_that_meet(spark, table, monkeypatch):
    a = "k0"
    b = next(f"k{i}" for i in range(60) if bucket(f"k{i}", 16) != bucket(a, 16))
    for _ in meeting(monkeypatch, lambda: table.upsert(frame(spark, [(b, 1, "other")]))):
        table.upsert(frame(spark, [(a, 2, "own")]))
    got = content(table)
    assert got[a] == (2, "own") and got[b] == (1, "other") and table.state()["version"] == 3
    with pytest.raises(Conflict):
        for _ in meeting(monkeypatch, lambda: table.upsert(frame(spark, [(a, 3, "first")]))):
            table.upsert(frame(spark, [(a, 4, "second")]))
    assert content(table)[a] == (3, "first") and table.state()["version"] == 4
    for _ in meeting(monkeypatch, lambda: table.upsert(frame(spark, [(a, 5, "x")]), txn=("w", 1))):
        table.upsert(frame(spark, [(a, 6, "y")]), txn=("w", 1))
    assert content(table)[a] == (5, "x") and table.state()["version"] == 5


def test_a_table_is_made_once(spark, table):
    with pytest.raises(FileExistsError):
        KeyedTable.create(frame(spark, []), table.path, "k")
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, table.path + "-none")
    with pytest.raises(ValueError):
        table.read(99)


def test_empty_table(spark, tmp_path):
    table = KeyedTable.create(frame(spark, []), str(tmp_path / "empty"), "k", 4)
    assert content(table) == {}
    table.upsert(frame(spark, [("x", 1, "y")]))
    assert content(table) == {"x": (1, "y")}
    table.delete_where(F.lit(True))
    assert content(table) == {} and table.state()["dirs"] == {}


def test_stream_comes_twice(spark, table, tmp_path):
    frame(spark, [("k1", 100, "s"), ("n1", 1, "s")]).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    frame(spark, [("k1", 200, "s"), ("n2", 2, "s")]).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    for again in range(2):  # the second time without the stream's checkpoint: all batches are replayed
        stream = micro.read_stream(spark, str(tmp_path / "in/*"), "k string, a int, b string", 1)
        micro.upsert_stream(stream, table, str(tmp_path / f"state-{again}")).awaitTermination()
        assert table.state()["version"] == 3
    got = content(table)
    assert got["n1"] == (1, "s") and got["n2"] == (2, "s") and got["k1"][0] in (100, 200) and len(got) == 62


def test_clusters_are_written_back(spark, tmp_path):
    docs = spark.createDataFrame([(f"u{i}", None if i % 2 else "7") for i in range(40)], "unique_id string, cluster string")
    table = KeyedTable.create(docs, str(tmp_path / "docs"), "unique_id", 32)
    preds = spark.createDataFrame([("u1", 5), ("u2", 5), ("u3", None), ("zz", 1)], "unique_id string, cluster int")
    commit = documents.write_back_into(table, preds)
    assert commit["rewritten"] == [str(bucket("u1", 32))]
    assert {r["unique_id"]: r["cluster"] for r in table.read().collect()} == {f"u{i}": "5" if i == 1 else None if i % 2 else "7" for i in range(40)}
    documents.write_back_into(table, preds, force=True)
    assert {r["cluster"] for r in table.get(preds).collect()} == {"5", None}
