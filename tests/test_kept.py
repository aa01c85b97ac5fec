"""Cached results, tables laid out for look-ups, and reports of streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources.cache import ResultCache
from tilewright.sources.clustered import interleaved, rank_cuts, write_clustered
from tilewright.streaming import micro, monitor


def test_a_result_is_computed_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).withColumn("g", F.col("id") % 3).coalesce(1).write.parquet(source)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(1)
            yield b

    def result(least):
        return spark.read.parquet(source).where(F.col("id") >= least).mapInArrow(counted, "id long, g long").groupBy("g").agg(F.sum("id").alias("s"))

    cache = ResultCache(spark, str(tmp_path / "cache"))
    want = sorted(map(tuple, result(10).collect()))
    before = runs.value
    assert not cache.fresh("sums", result(10))
    for _ in range(3):  # the plan is built anew each time
        assert sorted(map(tuple, cache.get("sums", result(10)).collect())) == want
    assert runs.value == before + 1 and cache.fresh("sums", result(10))
    assert not cache.fresh("sums", result(11)) and not cache.fresh("sums", result(10), depends="model 2")
    assert sorted(map(tuple, cache.get("sums", result(50)).collect())) == sorted(map(tuple, result(50).collect()))
    assert not cache.fresh("sums", result(10))  # an entry a name
    time.sleep(0.01)
    spark.range(1000, 1003).withColumn("g", F.lit(0).cast("long")).coalesce(1).write.mode("append").parquet(source)
    assert not cache.fresh("sums", result(50))  # a new file
    assert sorted(map(tuple, cache.get("sums", result(50)).collect())) == sorted(map(tuple, result(50).collect()))
    cache.drop("sums")
    assert not cache.fresh("sums", result(50))
    with pytest.raises(ValueError):
        cache.get("../x", result(1))


def scanned(df):
    """Rows and files that the scan of a frame has read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_look_ups_skip_most_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 60_000
    rows = spark.createDataFrame([(f"id-{i:08d}-{x}", int(a), float(b), f"c{c}", None if i % 1000 == 0 else int(a) % 7) for i, (x, a, b, c) in enumerate(zip(rng.integers(0, 1 << 40, n).tolist(), rng.integers(0, 100_000, n), rng.lognormal(0, 2, n), rng.integers(0, 40, n)))], "uid string, a int, b double, c string, d int").repartition(4)
    path = str(tmp_path / "clustered")
    write_clustered(rows, path, ["a", "c"], ["uid"], files=4, group_bytes=1 << 13)
    table = spark.read.parquet(path)
    assert table.schema.names == rows.schema.names and table.count() == n
    assert table.exceptAll(rows).isEmpty()
    one = rows.where("uid like 'id-00031%'").first()
    asked = {"uid": F.col("uid") == one["uid"], "a": F.col("a").between(one["a"], one["a"] + 50), "c": F.col("c") == one["c"], "both": (F.col("a").between(one["a"], one["a"] + 2000)) & (F.col("c") == one["c"])}
    for name, where in asked.items():
        want = rows.where(where).count()
        found = table.where(where)
        read = scanned(found.select("uid"))
        assert found.count() == want > 0
        assert read <= n * 0.1, (name, read)


def test_ranks_and_keys(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else i % 4) for i in range(64)], "a int, b int")
    cuts = rank_cuts(rows, ["a", "b"], 2)
    got = {r["a"]: r["k"] for r in rows.select("a", interleaved(rows, ["a", "b"], cuts, 2).alias("k")).collect()}
    rank = lambda v, c: 0 if v is None else sum(v >= x for x in c[1]) * 4 // (len(c[1]) + 1)
    for i in range(64):
        x, y = rank(i, cuts["a"]), rank(None if i == 5 else i % 4, cuts["b"])
        assert got[i] == sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(2))
    with pytest.raises(ValueError):
        write_clustered(rows, "/nowhere", ["a"] * 8)


def test_reports_of_a_stream(spark, tmp_path):
    sizes = [5, 1, 0, 7, 2, 2, 9, 4]
    for i, n in enumerate(sizes):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(0.02)
    log = monitor.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        micro.run_batches(micro.read_stream(spark, str(tmp_path / "in/*"), "id long", 1), lambda b, n: b.count(), str(tmp_path / "state")).awaitTermination()
        with pytest.raises(Exception):
            micro.run_batches(micro.read_stream(spark, str(tmp_path / "in/*"), "id long", 1), lambda b, n: 1 / 0, str(tmp_path / "other")).awaitTermination()
        for _ in range(100):  # reports come after the batches
            if len(list((tmp_path / "log").glob("*-end.json"))) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    rows = monitor.read_progress(spark, str(tmp_path / "log"))
    run = rows.where("event = 'end' and error is null").first()["run_id"]
    got = monitor.rolling(rows.where((F.col("run_id") == run) & (F.col("event") == "batch")), ["rows"]).orderBy("batch").collect()
    counts = [r["rows"] for r in got]
    assert sum(counts) == sum(sizes) and sorted(c for c in counts if c) == sorted(s for s in sizes if s)
    assert [r["rolling_rows"] for r in got] == [round(float(np.mean(counts[max(0, i - 4) : i + 1])), 6) for i in range(len(counts))]
    assert all(r["seconds"] > 0 and r["at"] is not None for r in got)
    whole = {r["run_id"]: r for r in monitor.totals(rows).collect()}[run]
    assert whole["rows"] == sum(sizes) and whole["batches"] == len(counts) and whole["rows_per_second"] > 0
    assert "ZeroDivisionError" in rows.where("error is not null").first()["error"]
