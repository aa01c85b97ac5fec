"""The map of a sample against principal components, and the places of other rows."""

import numpy as np
import pytest

from tilewright.operators import kmeans, projection


def curves(seed, n=250, d=20, groups=12):
    """Noisy arcs in random planes: their neighbours lie along them, which no two axes of all can show."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(groups):
        plane, _ = np.linalg.qr(rng.standard_normal((d, 3)))
        t = rng.uniform(0, 5, n)
        out.append(rng.standard_normal(d) * 3 + np.stack([2 * np.cos(t), 2 * np.sin(t), t / 2], axis=1) @ plane.T + 0.05 * rng.standard_normal((n, d)))
    return np.concatenate(out), np.repeat(np.arange(groups), n)


def frame(spark, x, c):
    return spark.createDataFrame([(i, int(g), v.tolist()) for i, (v, g) in enumerate(zip(x, c))], "unique_id long, cluster int, vector array<double>").repartition(4)


@pytest.fixture(scope="module")
def fitted(spark):
    x, c = curves(1)
    rows = frame(spark, x, c)
    return x, c, rows, projection.fit_layout(rows, per_cluster=100, epochs=150)


def test_more_neighbours_are_kept_than_by_components(spark, fitted):
    x, c, rows, layout = fitted
    assert len(layout.ids) == 12 * 100 and sorted(set(layout.clusters)) == list(range(12))
    plane, kept = projection.neighbours_kept(layout, layout.vectors[:, :2]), projection.neighbours_kept(layout)
    assert kept > 0.5 and kept > plane + 0.08, (kept, plane)
    again = projection.fit_layout(rows, per_cluster=100, epochs=150)
    assert again.ids == layout.ids and np.allclose(again.positions, layout.positions)


def test_the_graph_is_the_samples(fitted):
    x, c, rows, layout = fitted
    d = ((layout.vectors[:, None] - layout.vectors[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :15]
    assert np.allclose(np.take_along_axis(d, layout.neighbours, axis=1), want)


def test_other_rows_find_their_place(spark, fitted):
    x, c, rows, layout = fitted
    got = {r["unique_id"]: (r["x"], r["y"]) for r in projection.place(rows, layout).collect()}
    assert len(got) == len(x)
    for i, at in zip(layout.ids, layout.positions):
        assert np.allclose(got[i], at, atol=1e-6)  # the sample stays where it is
    rest = [i for i in got if i not in set(layout.ids)]
    y = np.array([got[i] for i in rest])
    near, _ = projection.nearest(y, layout.positions, 15)
    same = np.mean(np.array(layout.clusters)[near] == c[rest][:, None])
    true, _ = projection.nearest((x[rest] - layout.mean) @ layout.axes, layout.vectors, 15)
    kept = np.mean([len(np.intersect1d(a, b)) for a, b in zip(near, true)]) / 15
    assert same > 0.97 and kept > 0.5, (same, kept)


def test_nulls_and_few_rows(spark, fitted):
    layout = fitted[3]
    rows = spark.createDataFrame([(1, 0, None), (2, 0, [0.0] * 20)], "unique_id long, cluster int, vector array<double>")
    got = {r["unique_id"]: r for r in projection.place(rows, layout).collect()}
    assert got[1]["x"] is None and got[1]["y"] is None and got[2]["x"] is not None
    with pytest.raises(ValueError):
        projection.fit_layout(frame(spark, np.eye(2), [0, 0]))


def test_equal_rows(spark):
    layout = projection.fit_layout(frame(spark, np.concatenate([np.ones((30, 4)), np.eye(4)]), np.zeros(34)), epochs=20)
    assert np.isfinite(layout.positions).all()


def test_central_rows(spark, fitted):
    layout = fitted[3]
    got = projection.central_rows(projection.sample_frame(spark, layout)).collect()
    y, c = layout.positions, np.array(layout.clusters)
    for r in got:
        mid = y[c == r["cluster"]].mean(0)
        d = np.hypot(*(y - mid).T) + np.where(c == r["cluster"], 0, np.inf)
        assert np.allclose((r["center_x"], r["center_y"]), mid) and r["unique_id"] == layout.ids[int(d.argmin())]
    assert len(got) == 12
