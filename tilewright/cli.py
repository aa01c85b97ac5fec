"""python -m tilewright.cli <stage>: the batch stages, each a plan over named tables or files (table:<name> or a path)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import fill_unique_id
from .operators import analysis, documents, kmeans, knn, kselect, sampling, tissue
from .plans.shipping import ship_package
from .sources import readers, sinks


def build_db(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A table of tiles from Parquet, with ids filled in, bucketed by id."""
    rows = readers.read_parquet(spark, *a.inputs)
    rows = rows if "unique_id" in rows.columns else rows.withColumn("unique_id", F.lit(None).cast("string"))
    sinks.replace_table(rows.withColumn("unique_id", fill_unique_id()), a.out, "unique_id", a.buckets)
    return spark.table(a.out)


def stratify(spark, a):
    rows = readers.resolve(spark, a.tiles).where(F.col("modality") == a.modality)
    rows = rows if "source" in rows.columns else rows.withColumn("source", F.col("_metadata.file_name") if not a.tiles.startswith("table:") else F.lit(""))
    got = sampling.quota_sample(rows, a.field, "source", "unique_id", a.per_class, a.max_samples)
    sinks.replace_table(got, a.out, "unique_id", a.buckets)
    return spark.table(a.out)


def train(spark, a):
    rows = readers.resolve(spark, a.tiles).where(F.col("modality") == a.modality)
    rows = tissue.filter_tissue(rows, readers.resolve(spark, a.ext), a.min_tissue) if a.ext and a.min_tissue > 0 else rows
    name = sinks.model_name(a.k, a.modality, a.min_tissue)
    sinks.save_centers(spark, kmeans.fit(rows, a.k), f"{a.models}/{name}", k=a.k, modality=a.modality, min_tissue=a.min_tissue)
    return spark.read.parquet(f"{a.models}/{name}")


def predict(spark, a):
    centers = sinks.load_centers(spark, f"{a.models}/{sinks.model_name(a.k, a.modality, a.min_tissue)}")
    sinks.create_predictions(spark, a.out)
    ext = readers.resolve(spark, a.ext) if a.ext and a.min_tissue > 0 else None
    sinks.append(kmeans.predict_rest(readers.resolve(spark, a.tiles), spark.table(a.out), centers, ext, a.modality, a.low, a.mid), a.out)
    return spark.table(a.out)


def postprocess(spark, a):
    got = tissue.postprocess(readers.resolve(spark, a.predictions), readers.resolve(spark, a.ext))
    sinks.replace_table(got, a.out, "unique_id", a.buckets)
    return tissue.count_delta(readers.resolve(spark, a.predictions), spark.table(a.out)).orderBy("cluster")


def analyze(spark, a):
    rows = readers.resolve(spark, a.predictions).select("unique_id", "cluster").join(readers.resolve(spark, a.tiles), "unique_id")
    counts = analysis.class_counts(rows, ["cluster", a.field], a.field)
    out = analysis.shares(counts, "cluster")
    sinks.write_csv(out, f"{a.out}/cluster_{a.field}")
    sinks.write_csv(analysis.shares(counts, a.field), f"{a.out}/{a.field}_cluster")
    sinks.write_csv(analysis.size_summary(rows), f"{a.out}/sizes")
    return out


def sample_tiles(spark, a):
    return sampling.per_group_sample(readers.resolve(spark, a.predictions), "cluster", "unique_id", a.n)


def optimal_k(spark, a):
    rows = sampling.hashed_sample(readers.resolve(spark, a.tiles), "unique_id", a.max_samples)
    return kselect.sweep(rows, [int(k) for k in a.ks.split(",")], "unique_id", components=a.components)


def nearest(spark, a):
    rows = readers.resolve(spark, a.tiles)
    query = rows.where(F.col("unique_id") == a.id).select("vector").first()[0]
    return knn.knn(rows, query, a.n, exclude_id=a.id)


def ingest(spark, a):
    rows = documents.validate(readers.read_parquet(spark, *a.inputs))
    good = rows.where("valid").drop("valid", "reason")
    if spark.catalog.tableExists(a.out):
        documents.new_documents(good, spark.table(a.out)).write.mode("append").saveAsTable(a.out)
    else:
        good.write.saveAsTable(a.out)
    return rows.groupBy("reason").count()


def run_all(spark, a):
    """stratify, train, predict, postprocess and analyze with the names of one run."""
    tiles, base = a.tiles, vars(a)
    make = lambda **more: argparse.Namespace(**(base | more))
    stratify(spark, make(out=f"{a.out}_sample"))
    train(spark, make(tiles=f"table:{a.out}_sample"))
    predict(spark, make(tiles=tiles, out=f"{a.out}_predictions"))
    postprocess(spark, make(predictions=f"table:{a.out}_predictions", out=f"{a.out}_extended"))
    return analyze(spark, make(tiles=tiles, predictions=f"table:{a.out}_extended", out=f"{a.models}/{a.out}-report"))


STAGES = {"build-db": build_db, "stratify": stratify, "train": train, "predict": predict, "postprocess": postprocess, "analyze": analyze, "sample-tiles": sample_tiles, "optimal-k": optimal_k, "knn": nearest, "ingest": ingest, "run-all": run_all}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright", description=__doc__)
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("inputs", nargs="*")
    for name, kind, default in (("tiles", str, None), ("ext", str, None), ("predictions", str, None), ("out", str, "out"), ("models", str, "models"), ("modality", str, "stained"), ("field", str, "tissue_type"), ("k", int, 112), ("ks", str, "8,16,24,32"), ("per-class", int, 50_000), ("max-samples", int, 2_000_000), ("min-tissue", float, 0.0), ("low", float, tissue.LOW), ("mid", float, tissue.MID), ("components", int, None), ("n", int, 10), ("id", str, None), ("buckets", int, 64)):
        p.add_argument(f"--{name}", type=kind, default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tilewright").getOrCreate()
    ship_package(spark)
    STAGES[args.stage](spark, args).show(50, truncate=False)


if __name__ == "__main__":
    main()
