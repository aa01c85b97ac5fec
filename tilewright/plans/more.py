"""Further registered queries: sweeps and grids of k, rankings of runs, chained joins, path functions, counts; importing this registers them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import documents, ivf, kselect, paired, projection, sampling, tissue
from ..sources import cache, clustered, fetch
from ..sources.keyed import KeyedTable
from ..streaming import micro, monitor, state
from .fixtures import view
from .queries import COS, ORACLE_SQL, PD, _scratch, label_centers, labelled, query

KS = (4, 8)


@query()
def k_sweep(spark, sf_dir):
    """Metrics for each k, on principal components, with a silhouette."""
    return kselect.sweep(view(spark, sf_dir, "tiles"), list(KS), "vec_id", components=16)


@query()
def k_sweep_conditions(spark, sf_dir):
    tiles = tissue.with_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"))
    return kselect.sweep_conditions(tiles, list(KS), "vec_id")


@query()
def grid_search(spark, sf_dir):
    return kselect.grid_search(view(spark, sf_dir, "tiles"), [4], "vec_id", "tissue_type", ["resize"], [False, True], [5, 10], "stained", 8)


@query("SELECT p AS preprocessing, a AS apply_pca, m AS min_samples, 'stained_sr_' || p || '_pca' || cast(cast(a as int) as string) || '_min' || cast(m as string) AS run_name FROM (SELECT DISTINCT preprocessing AS p FROM tiles) x, (VALUES (true), (false)) y(a), (SELECT DISTINCT cast(count(*) as int) AS m FROM tiles GROUP BY tissue_type) z", "tiles")
def grid_configurations(spark, sf_dir):
    """The runs of a grid over what the tiles hold: their preprocessing, and the sizes of their classes as sample sizes."""
    tiles = view(spark, sf_dir, "tiles")
    sizes = tiles.groupBy("tissue_type").agg(F.count(F.lit(1)).cast("int").alias("m")).select("m").distinct().collect()  # a row a class
    return kselect.grid(spark, [r[0] for r in tiles.select("preprocessing").distinct().collect()], [True, False], [r["m"] for r in sizes])


@query("WITH d AS (SELECT model, k, lead(inertia) OVER w - 2 * inertia + lag(inertia) OVER w AS d2 FROM kmetrics WINDOW w AS (PARTITION BY model ORDER BY k)), e AS (SELECT model, k AS elbow FROM d WHERE d2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY d2 DESC, k) = 1), c AS (SELECT model, k AS ch FROM kmetrics QUALIFY row_number() OVER (PARTITION BY model ORDER BY calinski_harabasz DESC, k) = 1), b AS (SELECT model, k AS db FROM kmetrics QUALIFY row_number() OVER (PARTITION BY model ORDER BY davies_bouldin, k) = 1) SELECT model, elbow, ch, db, abs(elbow - db) AS elbow_db_diff, row_number() OVER (ORDER BY abs(elbow - db), model) AS rank FROM e JOIN c USING (model) JOIN b USING (model)", "kmetrics")
def rank_runs(spark, sf_dir):
    return kselect.rank_runs(view(spark, sf_dir, "kmetrics"))


@query(f"WITH {PD}, v AS (SELECT slide_key, cluster_virtual FROM pairs WHERE vec_id % 3 <> 1) SELECT pd.slide_key, round(distance, 6) AS distance, pd.cluster AS cluster_stained, v.cluster_virtual FROM pd JOIN v USING (slide_key)", "pairs")
def chained_cluster_joins(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    stained, virtual = pairs.select("slide_key", "cluster"), pairs.where("vec_id % 3 <> 1").select("slide_key", F.col("cluster_virtual").alias("cluster"))
    got = paired.pair_distances(paired.with_clusters(pairs.select("slide_key", "vector_chem", "vector_virt"), stained, virtual))
    return got.select("slide_key", F.round("distance", 6).alias("distance"), "cluster_stained", "cluster_virtual")


@query("WITH r AS (SELECT CASE WHEN vec_id % 9 = 0 THEN -2 WHEN vec_id % 9 = 1 THEN -1 ELSE cast(label as int) END AS cluster FROM tiles) SELECT cluster, cluster < 0 AS special, count(*) AS count FROM r GROUP BY 1, 2", "tiles")
def special_cluster_split(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("cluster", F.when(F.col("vec_id") % 9 == 0, -2).when(F.col("vec_id") % 9 == 1, -1).otherwise(F.col("cluster")))
    real, special = (d.groupBy("cluster").agg(F.count(F.lit(1)).alias("count")) for d in tissue.special_split(rows))
    return real.withColumn("special", F.lit(False)).unionByName(special.withColumn("special", F.lit(True)))


@query("WITH q AS (SELECT vec_id, CASE WHEN vec_id = 3 THEN '__query__' ELSE tile_key END AS slide_key FROM tiles), s AS (SELECT vec_id, slide_key, slide_key = '__query__' AS is_query FROM q) SELECT * FROM s WHERE is_query UNION ALL SELECT * FROM (SELECT * FROM s WHERE NOT is_query ORDER BY md5(slide_key), slide_key LIMIT 100)", "tiles")
def query_row_split(spark, sf_dir):
    rows = view(spark, sf_dir, "tiles").select("vec_id", F.when(F.col("vec_id") == 3, "__query__").otherwise(F.col("tile_key")).alias("slide_key"))
    return paired.query_split(rows, 100)


@query("SELECT vec_id, replace(slide_key || '_' || cast(box_id as string) || '_' || filename, '_' || cast(box_id as string) || '_', '_' || short_box_name || '_') AS swapped, '/img/' || tissue_type || '/' || block_id || '/' || slice_id || '/' || scan_date || '/' || cast(box_id as string) || '/' || filename || '-stained.tiff' AS stained, '/img/' || tissue_type || '/' || block_id || '/' || slice_id || '/' || scan_date || '/' || cast(box_id as string) || '/' || filename || '-stained-sr.tiff' AS virtual, replace(full_file_path, '/data/tiles', 'store://tiles') AS rebased, CASE WHEN vec_id % 7 = 0 THEN upper(modality) WHEN vec_id % 11 = 0 THEN 'other' ELSE modality END AS tile_type, 64 AS dimension FROM tiles", "tiles")
def path_functions(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    old = F.concat_ws("_", "slide_key", F.col("box_id").cast("string"), "filename")
    return tiles.select("vec_id", keys.swap_box(old, F.col("box_id"), F.col("short_box_name")).alias("swapped"), keys.image_path("/img", "stained").alias("stained"), keys.image_path("/img/", "virtual").alias("virtual"), keys.rebase(F.col("full_file_path"), "/data/tiles", "store://tiles").alias("rebased"), keys.tile_type_of(F.col("full_file_path")).alias("tile_type"), keys.dimension(F.col("vector")).alias("dimension"))


@query("SELECT vec_id, md5(modality || '|' || tile_key) AS unique_id, 'https://x/' || replace(tile_key, '_', '/') AS path FROM tiles", "tiles")
def caller_functions(spark, sf_dir):
    rows = keys.with_ids(view(spark, sf_dir, "tiles"), lambda: F.md5(F.concat_ws("|", "modality", "tile_key")))
    rows = keys.with_paths(rows, lambda key: F.concat(F.lit("https://x/"), F.replace(key, F.lit("_"), F.lit("/"))))
    return rows.select("vec_id", "unique_id", "path")


@query("SELECT count(*) AS n FROM tiles WHERE modality = 'unstained' AND tissue_type = 'skin'", "tiles")
def filtered_count(spark, sf_dir):
    n = documents.count(view(spark, sf_dir, "tiles"), documents.TermFilter(modality="unstained", tissue_type="skin").build())
    return spark.createDataFrame([(n,)], "n long")


@query("SELECT vec_id, unique_id FROM tiles WHERE tissue_type = 'lung' AND slice_id = '2' ORDER BY unique_id LIMIT 7", "tiles")
def tile_group_lookup(spark, sf_dir):
    return documents.tile_group(view(spark, sf_dir, "tiles"), 7, ["vec_id", "unique_id"], tissue_type="lung", slice_id="2", block_id=None)


@query("SELECT 'tissue_percentage' AS column, count(*) FILTER (tissue_percentage IS NULL) AS nulls FROM ext UNION ALL SELECT 'tile_key', count(*) FILTER (tile_key IS NULL) FROM ext", "ext")
def null_count_report(spark, sf_dir):
    return documents.null_counts(view(spark, sf_dir, "ext"), ["tissue_percentage", "tile_key"])


@query("SELECT cluster, sum(n) AS total FROM (SELECT cluster, slide_key, count(*) AS n FROM preds GROUP BY 1, 2) WHERE n > 0 GROUP BY 1", "preds")
def cluster_totals(spark, sf_dir):
    counts = view(spark, sf_dir, "preds").groupBy("cluster", "slide_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 0").groupBy("cluster").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "cluster")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS labels_in_documents, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS documents_in_labels")
def subset_test(spark, sf_dir):
    a, b = (view(spark, sf_dir, n).select("doc_id").distinct() for n in ("labels", "documents"))
    missing = lambda x, y: x.join(y, "doc_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("x"))
    return missing(a, b).select(F.col("x").alias("labels_in_documents")).crossJoin(missing(b, a).select(F.col("x").alias("documents_in_labels")))


@query("WITH d AS (SELECT vec_id, unique_id, CASE WHEN vec_id % 4 = 0 THEN '99' END AS cluster FROM tiles) SELECT d.unique_id, d.cluster AS before, cast(p.cluster as string) AS after FROM d JOIN preds p USING (unique_id) WHERE d.cluster IS NULL", "tiles", "preds")
def cluster_write_back_dry_run(spark, sf_dir):
    docs = view(spark, sf_dir, "tiles").withColumn("cluster", F.when(F.col("vec_id") % 4 == 0, "99"))
    return documents.write_back_changes(docs, view(spark, sf_dir, "preds")).select("unique_id", "before", "after")


@query("SELECT cluster, array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT cluster, id FROM preds QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5(id), id) <= 4) GROUP BY 1", "preds")
def cluster_grids(spark, sf_dir):
    """A few tiles for each cluster, as the cells of its grid."""
    got = sampling.per_group_sample(view(spark, sf_dir, "preds"), "cluster", "id", 4)
    return got.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


_NEAREST = f"SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS c FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id"


@query(f"WITH s AS ({_NEAREST}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank, id, round(c, 6) AS cosine FROM s QUALIFY rank <= 10")
def ivf_knn_exact(spark, sf_dir):
    """Exact neighbours from an index: bounds leave out what can't be among them."""
    rows = view(spark, sf_dir, "embeddings")
    index = ivf.Index.build(rows, f"{_scratch(spark)}/index", id_col="vec_id", vector="embedding")
    got = index.search(rows.where("vec_id % 100 = 0"), 10, exact=True)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("cosine", 6).alias("cosine"))


@query()
def ivf_knn_candidates(spark, sf_dir):
    """Neighbours among the thousand best by their codes, of stained tiles only."""
    rows = view(spark, sf_dir, "tiles")
    index = ivf.Index.build(rows, f"{_scratch(spark)}/index", ("modality",), "vec_id")
    return index.search(rows.where("vec_id % 100 = 0"), 50, num_candidates=1000, where=F.col("modality") == "stained")


_BUCKET = "cast(('0x' || substr(md5(unique_id), 1, 8)) as bigint) % 64"


def _upserted(spark, sf_dir):
    """A keyed table of tiles, after an upsert of every hundredth tile and of as many new ones."""
    tiles = view(spark, sf_dir, "tiles").select("unique_id", "tissue_type", "vec_id")
    table = KeyedTable.create(tiles, f"{_scratch(spark)}/tiles", "unique_id", 64)
    some = tiles.where("vec_id % 100 = 0")
    new = some.select("unique_id", F.lit("again").alias("tissue_type"), "vec_id").unionByName(some.select(F.md5("unique_id").alias("unique_id"), F.lit("new").alias("tissue_type"), "vec_id"))
    return table, table.upsert(new)


_UPSERTED = "t AS (SELECT unique_id, tissue_type, vec_id FROM tiles QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY vec_id) = 1), n AS (SELECT unique_id, 'again' AS tissue_type, vec_id FROM t WHERE vec_id % 100 = 0 UNION ALL SELECT md5(unique_id), 'new', vec_id FROM t WHERE vec_id % 100 = 0), u AS (SELECT * FROM t WHERE unique_id NOT IN (SELECT unique_id FROM n) UNION ALL SELECT * FROM n)"


@query(f"WITH {_UPSERTED} SELECT * FROM u", "tiles")
def keyed_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)[0].read()


@query(f"WITH {_UPSERTED}, b AS (SELECT DISTINCT {_BUCKET} AS bucket FROM n) SELECT 64 AS buckets, (SELECT count(*) FROM b) AS rewritten, (SELECT count(*) FROM u WHERE {_BUCKET} IN (SELECT bucket FROM b)) AS rows_written", "tiles")
def keyed_upsert_report(spark, sf_dir):
    """How many buckets an upsert rewrites, and how many rows they hold."""
    commit = _upserted(spark, sf_dir)[1]
    return spark.createDataFrame([(commit["buckets"], len(commit["rewritten"]), commit["rows"])], "buckets int, rewritten long, rows_written long")


@query(f"WITH {_UPSERTED} SELECT * FROM u WHERE vec_id % 50 = 0", "tiles")
def keyed_multi_get(spark, sf_dir):
    """Rows by key from a keyed table; the files of other buckets aren't read."""
    table = _upserted(spark, sf_dir)[0]
    return table.get(table.read().where("vec_id % 50 = 0").select("unique_id"))


@query()
def stream_state_equals_batch(spark, sf_dir):
    """Predictions by keyed state over the tiles in three files, then over all of them again with a new checkpoint."""
    path, tiles = _scratch(spark), view(spark, sf_dir, "tiles")
    once = sampling.keep_first(tiles, ["unique_id"], [F.col("vec_id")])
    once.repartition(3).write.parquet(f"{path}/in")
    centers = np.array([r["center"] for r in label_centers(spark, sf_dir).orderBy("cluster").collect()])
    for n in range(2):
        stream = micro.read_stream(spark, f"{path}/in", once.schema, 1)
        state.predict_once(stream, centers, f"{path}/out", f"{path}/state-{n}", view(spark, sf_dir, "ext")).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("unique_id", "cluster")


ORACLE_SQL["stream_state_equals_batch"] = ORACLE_SQL["stream_equals_batch"]


@query()
def projection_2d(spark, sf_dir):
    """A map of the embeddings: a layout of 600 rows of each label, and the places of all rows in it."""
    rows = view(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    layout = projection.fit_layout(rows, id_col="vec_id")
    return projection.place(rows, layout).select("vec_id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT cast(sum(least(n, 600)) as bigint) AS sample_rows, true AS more_than_components FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def projection_neighbours(spark, sf_dir):
    """Whether the map of the sample keeps more of its neighbours than two principal components do."""
    rows = view(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    layout = projection.fit_layout(rows, id_col="vec_id")
    kept, plane = projection.neighbours_kept(layout), projection.neighbours_kept(layout, layout.vectors[:, :2])
    return spark.createDataFrame([(len(layout.ids), kept > plane)], "sample_rows long, more_than_components boolean")


@query("SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN octet_length(encode(coalesce(text, ''))) END::bigint AS bytes, CASE WHEN doc_id % 50 <> 0 THEN md5(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 50 = 0 THEN 'missing' END AS error FROM documents")
def fetch_objects(spark, sf_dir):
    """Texts written as objects, but for every fiftieth, and fetched again: a row for each, also for what is missing."""
    folder = _scratch(spark)
    docs = view(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit(f"{folder}/objects/"), F.col("doc_id") % 100, F.lit("/"), F.col("doc_id")).alias("path"))

    def write(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fetch.FileStore().put(path, text.encode())
            yield batch.select(["path"])

    docs.where("doc_id % 50 <> 0").select("path", "text").mapInArrow(write, "path string").write.parquet(f"{folder}/written")
    got = fetch.latest(fetch.fetch_into(docs, fetch.FileStore(), f"{folder}/fetched"))
    return got.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "bytes", F.md5("content").alias("digest"), "error")


@query("SELECT vec_id, tissue_type, short_box_name FROM tiles WHERE tissue_type = 'skin' AND vec_id BETWEEN 100 AND 400", "tiles")
def clustered_lookup(spark, sf_dir):
    """Tiles laid out by class and number at once, and looked up by both."""
    path = f"{_scratch(spark)}/tiles"
    clustered.write_clustered(view(spark, sf_dir, "tiles").select("vec_id", "unique_id", "tissue_type", "short_box_name"), path, ["tissue_type", "vec_id"], ["unique_id"])
    return spark.read.parquet(path).where("tissue_type = 'skin' and vec_id between 100 and 400").select("vec_id", "tissue_type", "short_box_name")


@query("SELECT tissue_type, modality, count(*) AS count FROM tiles GROUP BY 1, 2", "tiles")
def cached_counts(spark, sf_dir):
    """Counts that the first call keeps and the second reads."""
    kept = cache.ResultCache(spark, _scratch(spark))
    for _ in range(2):
        got = kept.get("counts", view(spark, sf_dir, "tiles").groupBy("tissue_type", "modality").agg(F.count(F.lit(1)).alias("count")))
    return got


@query("WITH b AS (SELECT doc_id % 8 AS batch, count(*) AS rows FROM documents GROUP BY 1) SELECT batch, rows, round(avg(rows) OVER (ORDER BY batch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_rows FROM b")
def batch_rolling_mean(spark, sf_dir):
    """What a stream over the documents in eight files reports of its batches, and the mean of the last five."""
    folder, docs = _scratch(spark), view(spark, sf_dir, "documents").select("doc_id")
    for i in range(8):
        docs.where(F.col("doc_id") % 8 == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    log = monitor.ProgressLog(spark, f"{folder}/log")
    spark.streams.addListener(log)
    try:
        run = micro.run_batches(micro.read_stream(spark, f"{folder}/in/*", "doc_id long", 1), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/{n}"), f"{folder}/state")
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    rows = monitor.read_progress(spark, f"{folder}/log").where((F.col("event") == "batch") & (F.col("run_id") == str(run.runId)))
    return monitor.rolling(rows.where("rows > 0"), ["rows"]).select("batch", "rows", "rolling_rows")
