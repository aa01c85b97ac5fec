"""Fetching from a store that fails: retries, failure rows, resumption, bounded prefetch."""

import os
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle

from tilewright.operators import images
from tilewright.sources import fetch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this module


class Flaky(fetch.FileStore):
    """Fails a path's first `failures` times; times are counted in files, as tasks are processes of their own."""

    def __init__(self, counts: str, failures: dict[str, int]):
        self.counts, self.failures = counts, failures

    def get(self, path: str) -> bytes:
        name = os.path.basename(path)
        with open(f"{self.counts}/{name}", "ab") as f:
            f.write(b"x")
            f.flush()
            n = f.tell()
        if n <= self.failures.get(name, 0):
            raise ConnectionError(f"try {n}")
        return super().get(path)

    def asked(self) -> dict[str, int]:
        return {n: os.path.getsize(f"{self.counts}/{n}") for n in os.listdir(self.counts)}


@pytest.fixture
def store(tmp_path):
    (tmp_path / "counts").mkdir()
    for i in range(30):
        (tmp_path / f"objects/{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"objects/{i % 3}/o{i}.bin").write_bytes(bytes([i]) * (i * 100))
    return Flaky(str(tmp_path / "counts"), {"o3.bin": 2, "o4.bin": 99, "o5.bin": 4})


def paths(spark, tmp_path, ids):
    return spark.createDataFrame([(f"{tmp_path}/objects/{i % 3}/o{i}.bin",) for i in ids] + [(None,)], "path string").repartition(3)


def by_name(rows):
    return {os.path.basename(r["path"]): r for r in rows}


def test_all_rows_or_a_failure_row(spark, tmp_path, store):
    asked = paths(spark, tmp_path, [*range(32), 7])  # 30 and 31 aren't there, 7 comes twice
    got = by_name(fetch.fetch(asked, store, tries=3, first_wait=0.01).collect())
    assert len(got) == 32
    for i in range(30):
        row = got[f"o{i}.bin"]
        if i in (4, 5):
            assert row["content"] is None and row["bytes"] is None and row["tries"] == 3 and "ConnectionError: try 3" in row["error"]
        else:
            assert (bytes(row["content"]), row["bytes"], row["error"], row["tries"]) == (bytes([i]) * (i * 100), i * 100, None, 3 if i == 3 else 1)
    assert all((got[f"o{i}.bin"]["error"], got[f"o{i}.bin"]["tries"]) == ("missing", 1) for i in (30, 31))


def test_a_run_goes_on_where_another_stopped(spark, tmp_path, store):
    folder = str(tmp_path / "fetched")
    fetch.fetch_into(paths(spark, tmp_path, range(20)), store, folder, tries=2, first_wait=0.01)
    assert {n for n, r in by_name(fetch.latest(fetch.read_fetched(spark, folder)).collect()).items() if r["error"]} == {"o3.bin", "o4.bin", "o5.bin"}
    before = store.asked()
    rows = fetch.fetch_into(paths(spark, tmp_path, range(30)), store, folder, tries=3, first_wait=0.01)
    after = store.asked()
    assert {n for n in after if after[n] != before.get(n, 0)} == {"o3.bin", "o4.bin", "o5.bin", *(f"o{i}.bin" for i in range(20, 30))}
    got = by_name(fetch.latest(rows).collect())
    assert len(got) == 30 and {n for n, r in got.items() if r["error"]} == {"o4.bin"}
    assert bytes(got["o5.bin"]["content"]) == bytes([5]) * 500


def test_copies_that_are_there_stay(spark, tmp_path, store):
    asked = paths(spark, tmp_path, range(8)).selectExpr("path", f"replace(path, '{tmp_path}/objects', '{tmp_path}/copy') as target")
    first = by_name(fetch.download(asked, store, fetch.FileStore(), tries=3, first_wait=0.01).collect())
    assert {n for n, r in first.items() if r["status"] == "failed"} == {"o4.bin", "o5.bin"}
    assert (tmp_path / "copy/1/o7.bin").read_bytes() == bytes([7]) * 700
    (tmp_path / "copy/1/o7.bin").write_bytes(b"half")
    again = by_name(fetch.download(asked, store, fetch.FileStore(), tries=3, first_wait=0.01).collect())
    assert {n: r["status"] for n, r in again.items()} == {f"o{i}.bin": {4: "failed", 5: "written", 7: "written"}.get(i, "there") for i in range(8)}
    assert not list(tmp_path.glob("copy/**/*.part"))


def test_listing(spark, tmp_path, store):
    prefixes = spark.createDataFrame([(f"{tmp_path}/objects/{i}",) for i in range(4)] + [(None,)], "prefix string")
    got = {r["path"] for r in fetch.list_objects(prefixes, store, "5.bin").collect()}
    assert got == {f"{tmp_path}/objects/{i % 3}/o{i}.bin" for i in (5, 15, 25)}


def test_no_more_than_some_are_under_way():
    lock, now, most, taken = threading.Lock(), 0, 0, 0

    def work(i):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now - taken)
        time.sleep(0.002)
        return i

    out = []
    for x in fetch.ahead_of(iter(range(60)), work, 4, 7):
        taken += 1
        out.append(x)
    assert out == list(range(60)) and most <= 8


def test_waits_grow():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    assert fetch.attempt(fail, 5, 1.0, 4.0, waits.append) == (None, 5, "OSError: no")
    assert waits == [1.0, 2.0, 4.0, 4.0] and len(calls) == 5
    with pytest.raises(ZeroDivisionError):
        fetch.attempt(lambda: 1 / 0, 5, 1.0, 4.0, waits.append)


def test_images_from_a_store(spark, tmp_path, store):
    for i in range(4):
        pixels = np.full((8, 8, 3), 40 * i, np.uint8)
        (tmp_path / f"objects/0/t{i}.ppm").write_bytes(b"P6\n8 8\n255\n" + pixels.tobytes())
    asked = spark.createDataFrame([(f"{tmp_path}/objects/0/t{i}.ppm",) for i in range(5)], "path string")
    got = by_name(images.extract(fetch.fetch(asked, store, tries=1), images.MeanColour()).collect())
    assert [got[f"t{i}.ppm"]["ok"] for i in range(5)] == [True] * 4 + [False]
    assert got["t3.ppm"]["vector"][0] == 120.0
