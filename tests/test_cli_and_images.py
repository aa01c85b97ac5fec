import numpy as np
import pytest

from tilewright import cli
from tilewright.operators import images
from tilewright.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def ppm(value: int, side: int = 8) -> bytes:
    return b"P6 %d %d 255\n" % (side, side) + bytes([value]) * (3 * side * side)


def test_extract_resumes_and_marks_broken_images(spark, tmp_path):
    folder = tmp_path / "t/b/1/2025-01-01/x"
    folder.mkdir(parents=True)
    for i in range(4):
        (folder / f"tile_{i}-stained.tiff").write_bytes(ppm(i * 10) if i else b"broken")
    from tilewright.sources.readers import image_files

    files = image_files(spark, str(tmp_path))
    got = {r["filename"]: r for r in images.extract(files, images.MeanColour()).collect()}
    assert not got["tile_0"]["ok"] and got["tile_2"]["vector"][0] == 20 and got["tile_2"]["modality"] == "stained"
    done = files.where("path not like '%tile_3%'").select("path")
    assert images.extract(files, images.MeanColour(), "center_crop", done).count() == 1


def test_crops():
    img = np.arange(48).reshape(4, 4, 3).astype(np.uint8)
    assert (images.center_crop(img, 2) == img[1:3, 1:3]).all() and (images.top_left_crop(img, 2) == img[:2, :2]).all()
    assert (images.resize(img, 4) == img).all() and images.resize(img, 2).shape == (2, 2, 3)


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert images.retry(call, sleep=waits.append) == 7 and waits == [5.0, 10.0]
    with pytest.raises(OSError):
        images.retry(lambda: (_ for _ in ()).throw(OSError()), tries=1)


def test_stages_in_a_row(spark, tmp_path):
    for n in ("tiles", "ext"):
        view(spark, SF, n).write.parquet(str(tmp_path / n))
    parse = cli.parser().parse_args
    cli.build_db(spark, parse(["build-db", str(tmp_path / "tiles"), "--out", "cli_tiles", "--buckets", "2"]))
    args = parse(["run-all", "--tiles", "table:cli_tiles", "--ext", str(tmp_path / "ext"), "--out", "cli_run", "--models", str(tmp_path / "m"), "--k", "4", "--max-samples", "100", "--per-class", "20", "--buckets", "2"])
    shares = cli.run_all(spark, args)
    assert shares.count() > 4 and {r["cluster"] for r in shares.collect()} >= {-1}
    n = spark.table("cli_run_predictions").count()
    cli.predict(spark, parse(["predict", "--tiles", "table:cli_tiles", "--out", "cli_run_predictions", "--models", str(tmp_path / "m"), "--k", "4"]))
    assert spark.table("cli_run_predictions").count() == n == spark.table("cli_tiles").where("modality = 'stained'").select("unique_id").distinct().count()
    assert cli.optimal_k(spark, parse(["optimal-k", "--tiles", "table:cli_tiles", "--ks", "2,3"])).count() == 2
