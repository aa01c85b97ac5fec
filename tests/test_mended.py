"""Cases that the fixtures don't hold: repeated ids in quotas, vectors without length, line feeds and odd dates in documents."""

import datetime
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import documents, knn, sampling


@pytest.mark.parametrize(("ids", "times", "quota"), [(1000, 10, 500), (20_000, 2, 4000), (50, 3, 400)])
def test_quotas_are_filled_where_ids_repeat(spark, ids, times, quota):
    rows = spark.range(ids * times).select((F.col("id") % ids).alias("key"), F.lit("a").alias("cls"), F.lit("s").alias("src"), "id")
    got = [r["key"] for r in sampling.quota_sample(rows, "cls", "src", "key", quota, quota).collect()]
    assert len(got) == len(set(got)) == min(ids, quota)
    order = {r["key"]: r["h"] for r in rows.select("key", sampling.draw_order("key").alias("h")).distinct().collect()}
    assert sorted(got) == sorted(sorted(order, key=lambda k: (order[k], k))[:quota])


def test_quotas_of_missing_sources_and_ids(spark):
    rows = spark.createDataFrame([(i, "a", None if i % 2 else "s") for i in range(40)] + [(1, "a", "s"), (None, "a", "s"), (None, "a", "s")], "key int, cls string, src string")
    got = [tuple(r) for r in sampling.quota_sample(rows, "cls", "src", "key", 100, 100).collect()]
    assert sorted(got, key=str) == sorted([(i, "a", None if i % 2 else "s") for i in range(40)], key=str)


@pytest.mark.parametrize("top_k", [3, 20, 50])
def test_vectors_without_length_cost_no_neighbour(spark, top_k):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, [0.0] * 4), (99, None)], "unique_id int, vector array<double>").coalesce(1)
    got = {}
    for block in (16_384, 5):
        found = knn.knn_join(rows, rows, top_k, block=block).collect()
        got[block] = sorted((r["query_id"], r["rank"], r["id"]) for r in found)
    c = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    want = sorted((i, n + 1, int(j)) for i in range(20) for n, j in enumerate([j for j in np.argsort(-c[i], kind="stable") if j != i][:top_k]))
    assert got[16_384] == got[5] == want
    assert knn.knn_join(rows.where("unique_id > 97"), rows, top_k).count() == 0


TIMES = ["2024-01-01", "2024-02-30", "2024-02-29", "2023-02-29", "20240131", "2024-W05-3", "2024W053", "2024-W53-1", "2020-W53-1", "2024-W05", "2024", "2024-01", "2024-1-5", "2024-01-01T10", "2024-01-01 10:20", "2024-01-01T10:20:30.123456+02:00", "2024-01-01T10:20:30Z", "2024-01-01T25:00", "2024-01-01T10:60", "2024-01-01\n", "2024-01-01T10:20:30\n", "2024-01-01 10:20:30 Europe/Berlin", "10:20", "now", "", "0000-01-01", "0001-01-01", "9999-12-31T23:59:59", "20240101T102030", "20240101T1020", "2024-01-01T10:20:30,5", "2024-01-01x10:20", "2024-01-01T10:20-0330", "2024-01-01T", " 2024-01-01"]


def test_dates_as_python_takes_them(spark):
    def taken(t):
        try:
            datetime.datetime.fromisoformat(t)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "t string").select("t", documents.is_iso_time(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {t: taken(t) for t in TIMES} | {None: False}


def test_uuids_as_python_takes_them(spark):
    good = str(uuid.uuid4())
    ids = [good, good.upper(), good.replace("-", ""), f"{{{good}}}", f"urn:uuid:{good}", good + "\n", good[:-1], good + "0", "", "x" * 32]

    def taken(t):
        try:
            uuid.UUID(t)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(t,) for t in ids], "t string").select("t", documents.is_uuid(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {t: taken(t) for t in ids}


GOOD = {"unique_id": str(uuid.UUID(int=7)), "block_id": "b1", "box_id": "1-2", "created_at": "2024-01-01T00:00:00", "filename": "tile_1-2-3-4", "modality": "stained", "tile_type": "stained", "preprocessing": "resize", "scan_date": "2024-01-01", "slice_id": "3", "tissue_type": "skin"}


def with_key(doc):
    return doc | {"slide_key": "_".join(doc[n] for n in ("tissue_type", "block_id", "slice_id", "scan_date", "box_id", "filename"))}


def test_each_rule_holds_for_the_whole_value(spark):
    rows = [(None, with_key(GOOD))] + [(n, with_key(GOOD | {n: GOOD[n] + "\n"})) for n in GOOD] + [("slide_key", GOOD | {"slide_key": with_key(GOOD)["slide_key"] + "\n"})]
    docs = spark.createDataFrame([(why, *doc.values()) for why, doc in rows], ", ".join(f"{n} string" for n in ("why", *GOOD, "slide_key")))
    assert [(r["why"], r["valid"]) for r in documents.validate(docs).where("not (why <=> reason)").select("why", "valid", "reason").collect()] == []


def test_defaults_and_the_time(spark):
    docs = spark.createDataFrame([("a", None), ("b", "m2")], "unique_id string, model string")
    got = documents.with_defaults(docs, {"model": "m1", "modality": "stained", "created_at": documents.now_iso()})
    assert [(r["model"], r["modality"]) for r in got.orderBy("unique_id").collect()] == [("m1", "stained"), ("m2", "stained")]
    assert got.where(documents.is_iso_time(F.col("created_at"))).count() == 2


def test_paths_of_keys_and_listed_files(spark, tmp_path):
    from tilewright.functions import keys
    from tilewright.sources import readers

    rows = spark.createDataFrame([("skin_b1_2_2025-10-01_0-0_tile_0-0-5-5",)], "k string")
    assert rows.select(keys.key_to_path(F.col("k"))).first()[0] == "skin/b1/2/2025-10-01/0-0/tile_0-0-5-5"
    listing = spark.createDataFrame([("/x/a",), ("/x/b",)], "path string")
    assert [r["p"] for r in readers.existing(spark.createDataFrame([("/x/a",), ("/x/c",)], "p string"), "p", listing).collect()] == ["/x/a"]


def test_sources_are_cleaned_after_a_batch(spark, tmp_path):
    from tilewright.streaming import micro

    for mode in ("delete", "archive"):
        source, archive = tmp_path / mode / "in", tmp_path / f"{mode}-archive"
        for n in range(3):
            spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(str(source))
            stream = micro.read_stream(spark, str(source), "id long", 1, mode, str(archive) if mode == "archive" else None)
            micro.run_batches(stream, lambda batch, i: batch.write.mode("append").parquet(f"{tmp_path}/{mode}/out"), str(tmp_path / mode / "state")).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/{mode}/out").collect()) == [0, 1, 2]
        assert len(list(source.glob("*.parquet"))) < 3  # a file goes once its batch is committed
        assert mode == "delete" or list(archive.rglob("*.parquet"))


def test_document_table(spark):
    from tilewright.sources import sinks

    sinks.create_documents(spark, "docs_made", buckets=4)
    spark.sql("INSERT INTO docs_made (unique_id, cluster, vector) VALUES ('a', '1', array(1.0))")
    sinks.create_documents(spark, "docs_made")
    assert spark.table("docs_made").count() == 1
    sinks.create_documents(spark, "docs_made", anew=True)
    assert spark.table("docs_made").count() == 0
    spark.sql("DROP TABLE docs_made")


def test_matches_over_files(spark, tmp_path):
    from tilewright.sources import readers

    for name, ids in (("a", [1, 2, 3]), ("b", [3, None]), ("c", [9])):
        spark.createDataFrame([(i,) for i in ids], "k long").coalesce(1).write.parquet(str(tmp_path / name))
    found, report = readers.match_files(spark, [str(tmp_path / n) for n in "abc"], spark.createDataFrame([(1,), (3,), (3,), (None,)], "k long"), "k")
    assert sorted(r["k"] for r in found.collect()) == [1, 3, 3]
    assert {r["file"].split("/")[-2]: (r["rows"], r["matched"], r["missing"]) for r in report.collect()} == {"a": (3, 2, 1), "b": (2, 1, 1), "c": (1, 0, 1)}
