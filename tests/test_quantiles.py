"""Percentiles by brackets against all values, and how much a task orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import analysis, paired, quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def values(kind, n, rng):
    x = {"normal": rng.standard_normal(n), "skewed": rng.lognormal(0, 3, n), "ties": rng.integers(0, 5, n) / 2, "one": np.full(n, 3.25)}[kind]
    if kind == "skewed":
        x[: n // 3] = 1.0  # a third of all rows
    return x


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "one"])
def test_against_all_values(spark, kind):
    rng = np.random.default_rng(5)
    groups = {"a": values(kind, 9000, rng), None: values(kind, 700, rng), "b": values(kind, 3, rng), "c": values(kind, 1, rng)}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("empty", None)], "g string, _v double").repartition(4)
    for most in (1 << 16, 64):
        got = {r["g"]: (r["n"], r["q"]) for r in quantiles.percentiles(rows, ["g"], "_v", SHARES, most).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert got[g][0] == len(xs)
            np.testing.assert_allclose(got[g][1], np.percentile(xs, np.array(SHARES) * 100), rtol=1e-12, atol=1e-12)


def test_without_groups_and_values(spark):
    rows = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert quantiles.percentiles(rows, [], "x", [0.1, 0.5], 50).first()["q"] == [100.0, 500.0]
    assert quantiles.percentiles(rows.where("false"), [], "x", [0.5]).count() == 0


def test_two_group_columns(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"), F.col("id").cast("int").alias("x"))
    got = {(r["a"], r["b"]): r["q"][0] for r in quantiles.percentiles(rows, ["b", "a"], "x", [0.5], 20).collect()}
    assert got == {(a, b): float(np.median([x for x in range(4000) if x % 2 == a and x % 5 == b])) for a in range(2) for b in range(5)}


def test_what_a_task_orders_is_bounded(spark):
    rng = np.random.default_rng(6)
    held = spark.createDataFrame([("hot", float(x)) for x in rng.lognormal(0, 2, 60_000)] + [("small", float(x)) for x in range(9)], "_g0 string, _v double").repartition(8)
    sizes = held.groupBy("_g0").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    for passes, most in ((1, 60_000 * 6 // 200 + 600), (2, 200)):
        brackets = quantiles.brackets_of(held, sizes, ["_g0"], SHARES, passes).collect()
        assert len(brackets) == 14 and max(r["_within"] for r in brackets) <= most
        x = {g: np.sort([r["_v"] for r in held.where(F.col("_g0") == g).collect()]) for g in ("hot", "small")}
        for r in brackets:
            assert r["_below"] == (x[r["_g0"]] < r["_low"]).sum() and r["_below"] <= r["_at"] < r["_below"] + r["_within"]
    assert quantiles.passes_for(10**12, 1 << 16) <= 5 and quantiles.passes_for(100, 100) == 0


def test_statistics_of_groups(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal(500)
    rows = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(7, None), (8, 1.0)], "cluster int, d double")
    got = {r["cluster"]: r for r in paired.group_stats(rows, "cluster", "d").collect()}
    for c in range(3):
        for name, p in (("median", 50), ("p75", 75), ("p90", 90), ("p99", 99)):
            assert got[c][name] == pytest.approx(np.percentile(x[c::3], p), abs=1e-6)
    assert got[7]["median"] is None and got[8]["p99"] == 1.0 and got[8]["std"] is None
    out = {r["cluster"]: r for r in paired.outliers(rows, "cluster", "d").collect()}
    q1, q3 = np.percentile(x[::3], [25, 75])
    assert out[0]["outliers"] == ((x[::3] < q1 - 1.5 * (q3 - q1)) | (x[::3] > q3 + 1.5 * (q3 - q1))).sum()
    assert out[0]["n"] == len(x[::3]) and out[7]["q1"] is None and (out[7]["n"], out[7]["outliers"]) == (1, 0)
    d = analysis.describe_numeric(rows, "d").first()
    assert (d["count"], d["q50"]) == (501, pytest.approx(np.percentile(np.append(x, 1.0), 50), abs=1e-6))
    none = analysis.describe_numeric(rows.where("d is null"), "d").first()
    assert none["count"] == 0 and none["q50"] is None


def test_distances_are_computed_before_they_are_filtered(spark):
    rng = np.random.default_rng(9)
    spark.createDataFrame([(i, i % 3, rng.standard_normal(4).tolist()) for i in range(60)], "id long, cluster long, v array<double>").createOrReplaceTempView("stats_vectors")
    pairs = spark.sql("SELECT a.cluster, a.v AS p, b.v AS q FROM stats_vectors a CROSS JOIN (SELECT count(*) AS n FROM stats_vectors) c JOIN stats_vectors b ON b.id = (a.id + 1) % c.n")
    got = paired.group_stats(paired.pair_distances(pairs, "p", "q"), "cluster", "distance")
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()  # as a join's condition it has each vector meet each other one
    v = {r["id"]: np.array(r["v"]) for r in spark.table("stats_vectors").collect()}
    d = np.array([np.linalg.norm(v[i] - v[(i + 1) % 60]) for i in range(60)])
    assert {r["cluster"]: r["p90"] for r in got.collect()} == {c: pytest.approx(np.percentile(d[c::3], 90), abs=1e-6) for c in range(3)}
    both = paired.group_stats(spark.createDataFrame([(None, 1, 2.0), (None, 1, 4.0), ("x", None, 5.0)], "a string, b int, d double"), ["a", "b"], "d")
    assert {(r["a"], r["b"], r["median"]) for r in both.collect()} == {(None, 1, 3.0), ("x", None, 5.0)}
