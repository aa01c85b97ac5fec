"""Seeding, full passes and mini-batches of k-means against plain versions."""

import numpy as np
import pytest

from tilewright.operators import kmeans


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "unique_id long, vector array<double>").repartition(4)


def skewed(seed, sizes=(6000, 2500, 900, 400, 300, 200, 150, 120, 110, 100), d=6):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((len(sizes), d)) * 9
    return np.concatenate([c + rng.standard_normal((n, d)) for c, n in zip(centers, sizes)])


def inertia(x, centers):
    return ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def plain(x, k, runs=8):
    """The best of several runs: plain seeding by squared distance, then full passes."""
    rng, best = np.random.default_rng(0), None
    for _ in range(runs):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d2 = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.concatenate([c, x[[rng.choice(len(x), p=d2 / d2.sum())]]])
        for _ in range(15):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        best = c if best is None or inertia(x, c) < inertia(x, best) else best
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_blobs(spark, seed):
    x = skewed(seed)
    rows, want = frame(spark, x), inertia(x, plain(x, 10))
    assert inertia(x, kmeans.fit(rows, 10)) <= 1.02 * want
    assert inertia(x, kmeans.mini_batch_fit(rows, 10)) <= 1.02 * want


def test_starved_centres_go_elsewhere(spark):
    x = skewed(3)
    rows = frame(spark, x)
    start = np.concatenate([plain(x, 10)[:7], np.full((3, 6), 500.0)])  # three that no row is near to
    n, sums, cost = kmeans.cluster_sums(rows, start)
    assert (n[7:] == 0).all() and n.sum() == len(x) and cost == pytest.approx(inertia(x, start))
    centers, counts = kmeans.reassign(start, n, rows, 0.01, 5)
    assert np.array_equal(centers[:7], start[:7]) and (counts[7:] == n[:7].min()).all()
    assert inertia(x, kmeans.full_passes(rows, centers, 3)) < 0.8 * inertia(x, kmeans.full_passes(rows, start, 3))
    assert kmeans.reassign(centers[:7], n[:7], rows, 0.0, 5)[0] is not None


def test_sums_against_plain_ones(spark):
    rng = np.random.default_rng(4)
    x, c = rng.standard_normal((300, 3)), rng.standard_normal((5, 3))
    n, sums, cost = kmeans.cluster_sums(frame(spark, x), c)
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert n.tolist() == np.bincount(own, minlength=5).tolist()
    np.testing.assert_allclose(sums, [x[own == j].sum(0) for j in range(5)])
    assert cost == pytest.approx(inertia(x, c))


def test_draws_follow_distance(spark):
    x = np.concatenate([np.zeros((2000, 2)), np.full((3, 2), 50.0), np.full((3, 2), -50.0)])
    got = kmeans.far_rows(frame(spark, x).where("vector is not null"), np.zeros((1, 2)), 20, 1)
    assert len(got) == 6 and (np.abs(got) == 50).all()  # rows at a centre are never drawn
    assert sorted(np.unique(kmeans.seeds(frame(spark, x), 3), axis=0).ravel().tolist()) == [-50, -50, 0, 0, 50, 50]


def test_fewer_rows_than_centres(spark):
    x = np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]])
    assert sorted(kmeans.fit(frame(spark, x), 5).tolist()) == [[1.0, 2.0], [3.0, 4.0]] == sorted(kmeans.mini_batch_fit(frame(spark, x), 5, parts=1).tolist())
    for train in (kmeans.fit, kmeans.mini_batch_fit):
        with pytest.raises(ValueError):
            train(frame(spark, np.zeros((0, 2))), 2)


def test_weights_count(spark):
    points = np.array([[0.0], [1.0], [10.0], [11.0]])
    got = kmeans.weighted_centers(points, np.array([3.0, 1.0, 1.0, 3.0]), 2, np.random.default_rng(0))
    assert sorted(got.ravel().tolist()) == [0.25, 10.75]


def test_components_of_each_cluster(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6)) * [5, 4, 3, 1, 1, 1] @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    c = np.concatenate([np.zeros(180), np.ones(118), [2, 2]]).astype(int)
    rows = spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(c, x))] + [(900, None, x[0].tolist()), (901, 1, None)], "unique_id long, cluster int, vector array<double>").repartition(4)
    for size in (100_000, 50):  # several tasks a cluster
        monkeypatch.setattr(kmeans, "GROUP_ROWS", size)
        model = kmeans.cluster_components(rows, 3)
        assert sorted(model) == [0, 1, 2] and model[2][1].shape == (6, 2)
        for g in (0, 1):
            own = x[c == g]
            _, _, axes = np.linalg.svd(own - own.mean(0), full_matrices=False)
            assert np.allclose(model[g][0], own.mean(0)) and np.allclose(np.abs(np.sum(model[g][1] * axes[:3].T, axis=0)), 1)
    got = {r["unique_id"]: r["projected"] for r in kmeans.project_clusters(rows, model).collect()}
    assert got[900] is None and got[901] is None
    for i in range(300):
        assert np.allclose(got[i], (x[i] - model[c[i]][0]) @ model[c[i]][1])


def test_sub_clusters_on_components(spark):
    rng = np.random.default_rng(9)
    noise, rows, want = rng.standard_normal((400, 12)) * 0.1, [], {}
    for i in range(400):
        g, s = i % 2, (i // 2) % 2
        v = noise[i].copy()
        v[g] += 5 * s  # each cluster splits along an axis of its own
        rows.append((i, g, v.tolist()))
        want[i] = (g, s)
    rows.append((999, 7, [0.0] * 12))
    got = {r["unique_id"]: (r["cluster"], r["sub_cluster"]) for r in kmeans.sub_clusters(spark.createDataFrame(rows, "unique_id long, cluster int, vector array<double>"), 2, components=2).collect()}
    assert len(got) == 401 and got[999] == (7, 0)
    for g in (0, 1):
        pairs = {(want[i][1], got[i][1]) for i in range(400) if want[i][0] == g}
        assert len(pairs) == 2 and len({p[0] for p in pairs}) == 2
