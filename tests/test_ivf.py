"""The inverted-list index against comparisons with all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import ivf


def clouds(n, d, k, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((k, d))
    return centers[rng.integers(0, k, n)] + spread * rng.standard_normal((n, d))


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "unique_id long, vector array<double>, side string").repartition(3)


def brute(x, queries, top_k, allowed=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        c = u @ u[q]
        order = [int(j) for j in np.lexsort((np.arange(len(x)), -c)) if j != q and (allowed is None or allowed(j))]
        out[q] = order[:top_k]
    return out


def found(got):
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize(("d", "spread", "least"), [(32, 0.35, 0.95), (32, 3.0, 0.95), (7, 0.5, 0.95)])
def test_recall_at_a_thousand_candidates(spark, tmp_path, d, spread, least):
    x = clouds(6000, d, 40, d, spread)
    rows = frame(spark, x)
    index = ivf.Index.build(rows, str(tmp_path / "index"), max_train=3000)
    queries = rows.where("unique_id % 100 = 0")
    got, want = found(index.search(queries, 10, num_candidates=1000)), brute(x, range(0, 6000, 100), 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= least, recall


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_exact_search_is_exact(spark, tmp_path, spread):
    x = clouds(1500, 16, 12, 5, spread)
    x[700:720] = x[3]  # ties
    rows = frame(spark, x, [(9001, None, "odd"), (9002, [0.0] * 16, "odd"), (9003, [float("nan")] * 16, "odd")])
    index = ivf.Index.build(rows, str(tmp_path / "index"), keep=("side",), lists=30)
    queries = rows.where("unique_id % 100 = 3 or unique_id > 9000")
    for block in (1024, 4):
        assert found(index.search(queries, 7, probes=2, exact=True, block=block)) == brute(x, range(3, 1500, 100), 7)
    odd = found(index.search(queries, 7, probes=2, exact=True, where=F.col("side") == "odd"))
    assert odd == brute(x, range(3, 1500, 100), 7, lambda j: j % 2 == 1)
    everything = found(index.search(queries.where("unique_id = 3"), 2000, probes=1, exact=True))
    assert len(everything[3]) == 1499 and everything == brute(x, [3], 2000)


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_probe_reads_its_files_only(spark, tmp_path):
    x = clouds(3000, 16, 30, 9, 0.1)
    rows = frame(spark, x)
    index = ivf.Index.build(rows, str(tmp_path / "index"), lists=30)
    got = index.search(rows.where("unique_id = 5"), 10, num_candidates=20, probes=2)
    scans = {line.strip(" :+-") for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in line}
    assert len(scans) == 2 and all("PartitionFilters: [list#" in line and " IN (" in line for line in scans)
    assert sum("_code#" in line for line in scans) == 1 == sum("vector#" in line for line in scans)  # codes first, then the vectors of candidates
    assert not any("_code#" in line and "vector#" in line for line in scans)
    chosen = index._found(rows.where("unique_id = 5").select(F.col("unique_id").alias("query_id"), F.col("vector").alias("_q")), 10, 2, None, 20)[1][2]
    lists = np.flatnonzero(chosen.any(axis=0)).tolist()
    assert len(lists) == 2
    assert files_read(index.rows.where(F.col("list").isin(lists)).select("_code")) * 5 <= files_read(index.rows.select("_code"))
    assert len(found(got)[5]) == 10


def test_rows_are_added_to_the_index(spark, tmp_path):
    x = clouds(800, 8, 9, 2)
    index = ivf.Index.build(frame(spark, x[:500]), str(tmp_path / "index"), keep=("side",))
    more = spark.createDataFrame([(i, x[i].tolist(), "late") for i in range(500, 800)], "unique_id long, vector array<double>, side string")
    index = index.add(more)
    assert index.rows.count() == 800
    again = ivf.Index(spark, str(tmp_path / "index"))
    assert found(again.search(more.where("unique_id % 100 = 7"), 5, exact=True)) == brute(x, [507, 607, 707], 5)
    assert again.search(more, 5, where=F.col("side") == "none").count() == 0


def test_nothing_to_train_on(spark, tmp_path):
    with pytest.raises(ValueError):
        ivf.Index.build(spark.createDataFrame([(1, None, "x")], "unique_id long, vector array<double>, side string"), str(tmp_path / "index"))


def test_few_and_equal_rows(spark, tmp_path):
    x = np.ones((9, 5))
    rows = frame(spark, x)
    index = ivf.Index.build(rows, str(tmp_path / "index"))
    assert found(index.search(rows, 3, exact=True)) == found(index.search(rows, 3)) == {q: [j for j in range(9) if j != q][:3] for q in range(9)}
