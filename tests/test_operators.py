import time
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import keys, vectors
from tilewright.operators import analysis, documents, kmeans, knn, kselect, paired, sampling, tissue
from tilewright.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("name", ["", "a/b", "Ä/ß/日本", "x" * 200])
def test_uuid5(spark, name):
    assert one(spark, keys.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_norm_key_drops_the_first_box_only(spark):
    assert one(spark, keys.norm_tile_key(F.lit("t_b_1_d_x_tile_1_y_tile_2"))) == "t_b_1_d_tile_1_y_tile_2"
    assert one(spark, keys.norm_tile_key(F.lit("plain"))) == "plain"


def test_null_part_gives_null_id(spark):
    row = spark.createDataFrame([(None, "a")], "x string, y string")
    assert row.select(keys.md5_unique_id(("x", "y"))).first()[0] is None


def test_short_paths_and_unknown_modality(spark):
    got = spark.createDataFrame([("a/b.tiff",), ("/r/t/b/1/d/x/tile_1-STAINED.TIFF",)], "p string").select(*keys.parse_path(F.col("p"))).collect()
    assert got[0]["filename"] is None and got[0]["modality"] == "unknown"
    assert (got[1]["filename"], got[1]["modality"], got[1]["tissue_type"]) == ("tile_1", "stained", "t")


def test_relabel_bounds_and_null(spark):
    got = spark.createDataFrame([(7, 4.9), (7, 5.0), (7, 19.9), (7, 20.0), (7, None)], "c int, t double").select(tissue.relabel(F.col("c"), F.col("t")).alias("a"), tissue.relabel_single(F.col("c"), F.col("t")).alias("b")).collect()
    assert [r["a"] for r in got] == [-2, -1, -1, 7, 7] == [r["b"] for r in got]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=5), st.integers(1, 40), st.integers(1, 120))
def test_targets_add_up(spark, sizes, per_class, most):
    rows = spark.createDataFrame([(f"c{i}", j) for i, n in enumerate(sizes) for j in range(n)], "cls string, id long")
    got = {r["cls"]: r["target"] for r in sampling.class_targets(rows, "cls", per_class, most).collect()}
    assert sum(got.values()) == min(most, sum(min(per_class, n) for n in sizes))
    assert all(got[f"c{i}"] <= min(per_class, n) for i, n in enumerate(sizes))


def test_null_and_numeric_classes_take_no_part(spark):
    rows = spark.createDataFrame([(None,), ("7",), ("",), ("skin",)], "cls string")
    assert [r["cls"] for r in sampling.class_targets(rows, "cls", 5, 5).collect()] == ["skin"]


def test_cosine_of_zero_vector_is_null(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_knn_excludes_block_after_the_cut(spark):
    rows = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 0.1]), ("c", "x", [0.0, 1.0])], "unique_id string, block_id string, vector array<double>")
    assert [r["unique_id"] for r in knn.knn(rows, [1.0, 0.0], 2, exclude_block="x").collect()] == ["b"]
    assert [r["unique_id"] for r in knn.knn(rows, [1.0, 0.0], 2, exclude_id="a").collect()] == ["b", "c"]


def test_unknown_filter_field():
    with pytest.raises(ValueError):
        documents.TermFilter(nothing=1)


def test_upsert_replaces_by_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "unique_id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "unique_id int, v string")
    assert sorted(map(tuple, documents.upsert(old, new, "unique_id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def blobs(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.1, (n // 3, 3)) for c in ([0, 0, 0], [5, 0, 0], [0, 5, 1])])
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "unique_id long, vector array<double>")


def test_training_finds_blobs(spark):
    x, rows = blobs(spark)
    for centers in (kmeans.fit(rows, 3), kmeans.full_passes(rows, x[[0, 100, 200]], 3)):
        sizes = {r["count"] for r in kmeans.assign(rows, centers).groupBy("cluster").count().collect()}
        assert sizes == {100}
    assert kmeans.mini_batch_fit(rows, 3, parts=3).shape == (3, 3)


def test_components_match_svd(spark):
    x, rows = blobs(spark)
    mean, axes, ratio = kmeans.pca(rows, 2)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(mean, x.mean(0)) and np.allclose(ratio, (s / s.sum())[:2])
    got = np.array([r["projected"] for r in kmeans.project(rows, mean, axes).orderBy("unique_id").collect()])
    assert np.allclose(got.mean(0), 0, atol=1e-9)
    assert kmeans.pca(rows, variance=0.5)[1].shape[1] == 1


def test_prediction_resumes(spark):
    x, rows = blobs(spark, 30)
    tiles = rows.select(F.col("unique_id").cast("string").alias("unique_id"), "vector", *(F.lit("s").alias(c) for c in ("id", "slide_key", "tile_key", "short_box_name", "box_id")), F.lit("stained").alias("modality"))
    empty = spark.createDataFrame([], sinks.PREDICTIONS)
    first = kmeans.predict_rest(tiles, empty, x[[0, 10, 20]])
    assert first.count() == 30
    assert kmeans.predict_rest(tiles, first, x[[0, 10, 20]]).count() == 0


def test_empty_training_set(spark):
    with pytest.raises(ValueError):
        kmeans.fit(spark.createDataFrame([], "vector array<double>"), 2)


def test_elbow_of_two_points_is_the_first(spark):
    rows = spark.createDataFrame([("m", 8, 10.0), ("m", 16, 5.0)], "model string, k int, inertia double")
    assert kselect.elbow(rows).first()["elbow_k"] == 8


def test_knee():
    k = list(range(1, 20))
    assert kselect.knee(k, [1 / x for x in k]) in (3.0, 4.0, 5.0)
    assert kselect.knee([1, 2], [2.0, 1.0]) is None and kselect.knee([1, 2, 3], [1.0, 1.0, 1.0]) is None


def test_ssim_of_equal_images(spark):
    img = [float(i * 7 % 50) for i in range(100)]
    got = paired.ssim(spark.createDataFrame([(img, img), (img, img[:90])], "a array<double>, b array<double>"), "a", "b", 10).collect()
    assert got[0]["ssim"] == pytest.approx(1.0) and (got[1]["ssim"] is None or np.isnan(got[1]["ssim"]))


def test_histogram_of_equal_values_and_empty(spark):
    assert [tuple(r) for r in analysis.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").collect()] == [(0, 2)]
    assert analysis.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, m string")
    sinks.write_csv(rows, str(tmp_path / "x.csv"))
    assert readers.resolve(spark, str(tmp_path / "x.csv"), ["m"]).count() == 2
    sinks.replace_table(rows, "bucketed", "id", 2)
    assert readers.resolve(spark, "table:bucketed").count() == 2
    sinks.save_centers(spark, np.eye(2), str(tmp_path / "c"), k=2)
    assert np.allclose(sinks.load_centers(spark, str(tmp_path / "c")), np.eye(2))
    (tmp_path / "m.txt").write_text("x, p/b\nq/a.tiff\n\n")
    assert [r[0] for r in readers.path_list(spark, str(tmp_path / "m.txt"), "s3://k/", ".tiff").collect()] == ["s3://k/p/b.tiff", "s3://k/q/a.tiff"]
    with pytest.raises(ValueError):
        readers.resolve(spark, "x.pkl")
    sinks.merge_manifest(spark.createDataFrame([("b",)], "v string"), spark.createDataFrame([("a",), ("b",)], "v string"), str(tmp_path / "manifest"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "manifest")).collect()) == ["a", "b"]


def test_union_by_name_of_files(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "d/one"))
    spark.createDataFrame([(2, 3)], "a int, b int").write.parquet(str(tmp_path / "d/two"))
    assert sorted(readers.read_parquet(spark, str(tmp_path / "d")).columns) == ["a", "b"]


def test_silhouette_of_all_takes_every_row(spark):
    rng = np.random.default_rng(8)
    v, c = rng.standard_normal((5200, 2)), rng.integers(0, 3, 5200)
    v[:, 0] += c
    c[0] = 7  # alone in its cluster
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    to = np.stack([d[:, c == k].sum(axis=1) / np.maximum(1, (c == k).sum() - (c == k)) for k in (0, 1, 2, 7)], axis=1)
    mine = np.array([[0, 1, 2, 0, 0, 0, 0, 3][k] for k in c])
    a = to[np.arange(len(c)), mine]
    to[np.arange(len(c)), mine] = np.inf
    b = to.min(axis=1)
    want = np.where(c == 7, 0, (b - a) / np.maximum(a, b)).mean()
    rows = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(c, v))], "vec_id long, cluster int, vector array<double>")
    assert kselect.silhouette_of_all(rows, "vec_id").first()[0] == pytest.approx(want, abs=2e-6)
    assert kselect.silhouette_of_all(rows, "vec_id", block_rows=1000).first()[0] == pytest.approx(want, abs=2e-6)


def plain_silhouettes(c, v):
    """Each row's, from the differences of all pairs; 0 / 0 is NaN, as in SQL."""
    d = np.stack([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in v])
    kinds, mine, n = np.unique(c, return_inverse=True, return_counts=True)
    order = np.argsort(mine, kind="stable")
    to = np.add.reduceat(d[:, order], np.r_[0, np.cumsum(n)[:-1]], axis=1)
    rows = np.arange(len(c))
    with np.errstate(all="ignore"):
        a, mean = to[rows, mine] / (n[mine] - 1), to / n
        mean[rows, mine] = np.inf
        b = mean.min(axis=1)
        return np.where((n[mine] == 1) | (len(n) == 1), 0, (b - a) / np.maximum(a, b))


@pytest.mark.parametrize("kind", ["far from 0", "copies", "many clusters", "one cluster", "one large"])
def test_silhouette_of_all_is_exact_on_hard_vectors(spark, kind):
    rng = np.random.default_rng(len(kind))
    v, c = rng.standard_normal((3000, 5)), rng.integers(0, 4, 3000)
    if kind == "far from 0":  # clusters of a millionth of their distance, whose squared norms hold none of it
        v = v * 1e-6 + np.eye(5)[c] * 3 + 1e5
        v[:500] = v[0] + rng.standard_normal((500, 5)) * 1e-7  # in all clusters
    elif kind == "copies":
        v = v[rng.integers(0, 40, 3000)]
    elif kind == "many clusters":
        c = np.where(rng.random(3000) < 0.5, rng.integers(0, 1000, 3000), rng.integers(5000, 5004, 3000))
    elif kind == "one cluster":
        c[:] = 1
    else:
        c = np.where(np.arange(3000) < 2990, 3, np.arange(3000))
    rows = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(c, v))], "vec_id long, cluster int, vector array<double>")
    want = plain_silhouettes(c, v).mean()
    for block_rows in (32_768, 700):
        assert kselect.silhouette_of_all(rows, "vec_id", digits=9, block_rows=block_rows).first()[0] == pytest.approx(want, abs=3e-9)


def test_silhouette_of_all_on_odd_rows(spark):
    def of(*rows):
        return kselect.silhouette_of_all(spark.createDataFrame(list(rows), "i long, cluster int, vector array<float>"), "i").first()[0]

    near, far = [(0, 1, [0.0, 0.0]), (1, 1, [0.0, 1.0])], [(2, 2, [9.0, 0.0]), (3, 2, [9.0, 1.0])]
    four = of(*near, *far)
    assert of(*near, *far, (4, 1, None), (5, None, [0.0, 0.5])) == pytest.approx(four * 4 / 6, abs=1e-6)  # compared with none, and 0
    assert of(*near, *far, (None, 1, [5.0, 5.0])) == four
    assert np.isnan(of(*[(i, i % 2, [1.0, 2.0]) for i in range(4)]))  # 0 / 0, as in SQL
    assert np.isnan(of(*near, *far, (4, 2, [float("nan"), 0.0]))) and of(*near, *far, (4, 3, [float("inf"), 0.0])) == pytest.approx(four * 4 / 5, abs=1e-6)
    assert of() is None and of(near[0]) is None and of(*near) == 0.0 and of(near[0], far[0]) == 0.0
    with pytest.raises(Exception, match="different lengths"):
        of(*near, (2, 2, [1.0]))


def test_silhouette_of_all_takes_little_time_a_pair():
    """A pair of blocks takes a fraction of what differences of vectors do (before: all of it)."""
    rng = np.random.default_rng(5)
    v, one = rng.standard_normal((4096, 64)), np.ones(4096, np.int64)
    c = np.sort(rng.integers(0, 3, 4096))
    x, y = (kselect.Side(c, one, one * 10_000, v + shift, np.zeros(64), tile) for shift, tile in ((0, 256), (1, 1024)))
    began = time.thread_time()
    kselect.meet(x, y)
    took, began = time.thread_time() - began, time.thread_time()
    plain = np.stack([np.sqrt(((y.v - a) ** 2).sum(axis=1)) for a in v[:512]])
    assert took < (time.thread_time() - began) * 8 / 3
    for kind, d in x.sums.items():
        assert np.allclose(d[:512], plain[:, c == kind].sum(axis=1), rtol=1e-12)


def test_null_vectors_get_no_cluster_and_no_projection(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, None), (2, [5.0, 5.0])], "unique_id long, vector array<double>")
    centers = np.array([[0.0, 0.0], [5.0, 5.0]])
    got = {r["unique_id"]: (r["cluster"], r["d2"]) for r in kmeans.assign(rows, centers).collect()}
    assert got == {0: (0, 1.0), 1: (None, None), 2: (1, 0.0)}
    table = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "cluster int, center array<double>")
    assert {r["unique_id"]: (r["cluster"], r["d2"]) for r in kmeans.assign_native(rows, table, "unique_id").collect()} == got
    shown = {r["unique_id"]: r["projected"] for r in kmeans.project(rows, np.zeros(2), np.eye(2)[:, :1]).collect()}
    assert shown == {0: [0.0], 1: None, 2: [5.0]}


def test_sweep_against_plain_metrics(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "unique_id long, vector array<double>")
    got = {r["k"]: r for r in kselect.sweep(rows, [2, 3], "unique_id").collect()}
    own = np.repeat(np.arange(3), 30)
    centers = np.stack([x[own == c].mean(0) for c in range(3)])
    assert got[3]["inertia"] == pytest.approx(((x - centers[own]) ** 2).sum(), abs=1e-5) and got[3]["inertia"] < got[2]["inertia"]
    assert got[3]["silhouette"] > 0.9 and got[3]["n"] == 90


def test_chunks_of_a_group_follow_its_order(spark):
    rows = [(i % 3, (i * 37) % 100 if i % 11 else None, i) for i in range(100)]
    got = sampling.chunk_numbers(spark.createDataFrame(rows, "g int, o int, id int"), "g", "o", 7, parts=5).collect()
    for g in range(3):
        order = sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"] is not None, r["o"] or 0, r["chunk"]))
        assert [r["chunk"] for r in order] == [i // 7 for i in range(len(order))]


def test_incremental_model_goes_on_after_a_restart(spark, tmp_path):
    from tilewright.streaming.micro import IncrementalModel

    rng = np.random.default_rng(2)
    batch = lambda: spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(20)], "unique_id long, vector array<double>")
    a, b, start = batch(), batch(), np.array([[-1.0, 0.0], [1.0, 0.0]])
    whole = IncrementalModel(start)
    whole.update(a, 0)
    whole.update(b, 1)
    IncrementalModel(start, str(tmp_path), spark).update(a, 0)
    again = IncrementalModel(start, str(tmp_path), spark)
    again.update(a, 0)  # replayed
    again.update(b, 1)
    assert np.allclose(again.centers, whole.centers) and (again.counts == whole.counts).all() and again.seen == 1


def test_versions_rotate(spark, tmp_path):
    for n in range(4):
        assert sinks.write_version(spark.range(n), f"{tmp_path}/t", keep=2) == n + 1
    assert sinks.versions(spark, f"{tmp_path}/t") == [3, 4] and spark.read.parquet(f"{tmp_path}/t/4").count() == 3


def test_ssim_against_plain_windows(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((9, 8)), rng.random((9, 8))
    got = paired.ssim(spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>"), "a", "b", 8, window=3, peak=1.0).first()["ssim"]
    c1, c2, each = 0.01**2, 0.03**2, []
    for i in range(7):
        for j in range(6):
            x, y = a[i : i + 3, j : j + 3].ravel(), b[i : i + 3, j : j + 3].ravel()
            v = np.cov(x, y)
            each.append((2 * x.mean() * y.mean() + c1) * (2 * v[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (v[0, 0] + v[1, 1] + c2)))
    assert got == pytest.approx(np.mean(each))


def test_full_passes_and_mini_batches_against_plain_ones(spark):
    rng = np.random.default_rng(5)
    x, start = rng.normal(size=(60, 3)), rng.normal(size=(4, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "unique_id long, vector array<double>")
    want = start.copy()
    for _ in range(3):
        own = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        want = np.stack([x[own == c].mean(0) if (own == c).any() else want[c] for c in range(4)])
    assert np.allclose(kmeans.full_passes(rows, start, 3), want)
    centers, counts = kmeans.mini_batch(start, np.array([2.0, 0.0, 1.0, 5.0]), np.array([[3.0, 0, 0], [4.0, 2, 0], [0, 0, 0], [1.0, 1, 1]]), np.array([3.0, 2.0, 0.0, 1.0]))
    assert np.allclose(centers[0], (2 * start[0] + [3, 0, 0]) / 5) and np.allclose(centers[1], [2, 1, 0]) and np.allclose(centers[2], start[2]) and counts.tolist() == [5, 2, 1, 6]


def test_two_rows_meet_in_one_pair_of_blocks(spark):
    met, sent = {}, {}
    for r in kselect.block_pairs(spark.range(60).withColumnRenamed("id", "i"), "i", 5).collect():
        met.setdefault((r["p"], r["q"]), {0: [], 1: []})[r["s"]].append(r["i"])
        sent[r["i"]] = sent.get(r["i"], 0) + 1
    pairs = [tuple(sorted((a, b))) for (p, q), m in met.items() for a in m[0] for b in (m[1] if p < q else m[0]) if p < q or a < b]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 and set(sent.values()) == {5}
