"""Makes the package importable on executors that don't have it installed."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send a zip of this package to the executors, once for each application; bound what one Arrow batch sends to Python at a time."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) in (None, "67108864b"):  # the default, which whole texts fill
        spark.conf.set(BATCH_BYTES, "4m")
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix=f"{root.name}-"))
    shutil.copytree(root, folder / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / f"{root.name}-package"), "zip", folder / "src"))
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
