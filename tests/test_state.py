"""Keyed streaming state: one row a key, over restarts, replays, lost checkpoints and expiry."""

import shutil
import time

import numpy as np
import pytest

from tilewright.operators import kmeans
from tilewright.streaming import micro, state

SCHEMA = "unique_id string, id string, slide_key string, tile_key string, short_box_name string, box_id int, modality string, vector array<double>"
CENTERS = np.array([[0.0, 0.0], [10.0, 10.0]])


def tiles(spark, ids):
    return spark.createDataFrame([(None if i is None else f"u{i}", str(i), "s", f"t{i}", "b", 1, "unstained" if i == 13 else "stained", [float(i or 0) % 20, 3.0]) for i in ids], SCHEMA).coalesce(1)


def run(spark, folder, out, checkpoint, **more):
    query = state.predict_once(micro.read_stream(spark, f"{folder}/*", SCHEMA, 1), CENTERS, str(out), str(checkpoint), **more)
    state.run_until_idle(query)
    return query


def ids(spark, out):
    return sorted(r[0] for r in spark.read.parquet(str(out)).select("unique_id").collect())


def test_one_row_a_key(spark, tmp_path):
    out, source = tmp_path / "out", tmp_path / "in"
    tiles(spark, [1, 2, 2, 3, None, 13]).write.parquet(str(source / "1"))
    tiles(spark, [3, 4, 1]).write.parquet(str(source / "2"))
    run(spark, source, out, tmp_path / "state")
    assert ids(spark, out) == ["u1", "u2", "u3", "u4"]
    tiles(spark, [4, 5, 2]).write.parquet(str(source / "3"))
    run(spark, source, out, tmp_path / "state")  # a restart
    assert ids(spark, out) == ["u1", "u2", "u3", "u4", "u5"]
    run(spark, source, out, tmp_path / "other")  # a new checkpoint: all files again, nothing new
    assert ids(spark, out) == ["u1", "u2", "u3", "u4", "u5"]
    tiles(spark, [5, 6]).write.parquet(str(source / "4"))
    run(spark, source, out, tmp_path / "other")
    assert ids(spark, out) == ["u1", "u2", "u3", "u4", "u5", "u6"]
    got = {r["unique_id"]: r["cluster"] for r in spark.read.parquet(str(out)).collect()}
    want = {r["unique_id"]: r["cluster"] for r in kmeans.predictions(tiles(spark, range(1, 7)), CENTERS).collect()}
    assert got == want


def test_a_batch_that_is_run_again(spark, tmp_path):
    out, source, checkpoint = tmp_path / "out", tmp_path / "in", tmp_path / "state"
    for n, some in enumerate(([1, 2], [2, 3], [3, 4])):
        tiles(spark, some).write.parquet(str(source / str(n)))
        run(spark, source, out, checkpoint)
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver died between the sink and the commit
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run(spark, source, out, checkpoint)
    assert ids(spark, out) == ["u1", "u2", "u3", "u4"]


def test_batches_do_not_read_the_sink(spark, tmp_path):
    out, source, checkpoint = tmp_path / "out", tmp_path / "in", tmp_path / "state"
    tiles(spark, range(20, 60)).write.parquet(str(source / "1"))
    run(spark, source, out, checkpoint)
    shutil.rmtree(out)  # what was written is gone, what was seen isn't
    tiles(spark, [20, 30, 61]).write.parquet(str(source / "2"))
    run(spark, source, out, checkpoint)
    assert ids(spark, out) == ["u61"]


def test_keys_are_forgotten_in_time(spark, tmp_path):
    out, source, checkpoint = tmp_path / "out", tmp_path / "in", tmp_path / "state"
    tiles(spark, [1, 2]).write.parquet(str(source / "1"))
    run(spark, source, out, checkpoint, ttl_seconds=2)
    time.sleep(3)
    tiles(spark, [2, 3]).write.parquet(str(source / "2"))
    run(spark, source, out, checkpoint, ttl_seconds=2)
    assert ids(spark, out) == ["u1", "u2", "u2", "u3"]


def test_errors_come_through(spark, tmp_path):
    tiles(spark, [1]).write.parquet(str(tmp_path / "in/1"))
    with pytest.raises(Exception, match="[Vv]alue|shape|mul|matmul"):
        query = state.predict_once(micro.read_stream(spark, f"{tmp_path}/in/*", SCHEMA, 1), np.zeros((2, 5)), str(tmp_path / "out"), str(tmp_path / "state"))
        state.run_until_idle(query)
