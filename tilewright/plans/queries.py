"""The registered queries over the engine's own operators, and the SQL that should give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, vectors
from ..operators import analysis, documents, kmeans, knn, kselect, paired, sampling, tissue
from ..sources import readers, sinks
from ..streaming import micro
from .fixtures import view, with_views
from .shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A tile key without its box segment, in the comparison's dialect (which replaces the first match only).
NORM = r"regexp_replace({}, '_[^_]+_tile_', '_tile_')"
#: Double-precision arithmetic on lists there.
DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: power(cast(z[1] as double) - cast(z[2] as double), 2))))"
COS = "list_cosine_similarity(cast({0} as double[]), cast({1} as double[]))"
DEDUP = f"dedup AS (SELECT {NORM.format('tile_key')} AS nk, max(tissue_percentage) AS tissue_percentage FROM ext GROUP BY 1)"
DEDUP_STAINED = f"dedup AS (SELECT {NORM.format('tile_key')} AS nk, max(tissue_percentage) AS tissue_percentage FROM ext WHERE modality = 'stained' GROUP BY 1)"
CENTERS = "parts AS (SELECT cast(label as int) AS cluster, i, avg(cast(embedding[i] as double)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2), centers AS (SELECT cluster, list(m ORDER BY i) AS center FROM parts GROUP BY 1)"
NEAREST = CENTERS + f", d AS (SELECT t.*, c.cluster, {DIST.format('t.vector', 'c.center')} AS dist FROM tiles t, centers c), nearest AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1)"


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return register


def label_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster and center: the mean vector of each label."""
    rows = view(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("cluster"), F.col("embedding").alias("vector"))
    return vectors.mean_vectors(rows, ["cluster"])


def nearest_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign_native(view(spark, sf_dir, "tiles"), label_centers(spark, sf_dir), "vec_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tiles").withColumn("cluster", F.col("label").cast("int"))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their tiles' class; unknown tissue counts as 100."""
    tiles = tissue.with_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"))
    return view(spark, sf_dir, "preds").select("unique_id", "cluster").join(tiles, "unique_id").withColumn("tissue_percentage", F.coalesce("tissue_percentage", F.lit(100.0)))


ANALYSED = f"{DEDUP}, a AS (SELECT p.cluster, t.vec_id, t.tissue_type, coalesce(d.tissue_percentage, 100.0) AS tissue_percentage FROM preds p JOIN tiles t USING (unique_id) LEFT JOIN dedup d ON d.nk = {NORM.format('t.tile_key')})"
ALPHA = "regexp_full_match(tissue_type, '\\p{L}+')"


@query(f"WITH {DEDUP}, {NEAREST}, r AS (SELECT n.tissue_type, CASE WHEN d.tissue_percentage < 5 THEN -2 WHEN d.tissue_percentage < 20 THEN -1 ELSE n.cluster END AS cluster FROM nearest n LEFT JOIN dedup d ON d.nk = {NORM.format('n.tile_key')}), c AS (SELECT cluster, tissue_type, count(*) AS count FROM r WHERE {ALPHA} GROUP BY 1, 2) SELECT cluster, tissue_type, count, round(count / sum(count) OVER (PARTITION BY cluster), 9) AS share FROM c", "tiles", "ext")
def cluster_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tissue.with_tissue(nearest_tiles(spark, sf_dir), view(spark, sf_dir, "ext"))
    rows = rows.withColumn("cluster", tissue.relabel(F.col("cluster"), F.col("tissue_percentage")))
    return analysis.shares(analysis.class_counts(rows, ["cluster", "tissue_type"], "tissue_type"), "cluster")


@query("SELECT vec_id, unique_id FROM tiles", "tiles")
def unique_id_md5(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles").withColumn("unique_id", F.when(F.col("vec_id") % 3 == 0, F.lit("")).when(F.col("vec_id") % 3 == 1, F.col("unique_id")))
    return tiles.select("vec_id", keys.fill_unique_id().alias("unique_id"))


@query("WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('/', tissue_type, block_id, slice_id, scan_date, cast(box_id as string), filename, tile_type, preprocessing))) AS h FROM tiles) SELECT vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h", "tiles")
def unique_id_uuid5(spark, sf_dir):
    return view(spark, sf_dir, "tiles").select("vec_id", keys.uuid5(keys.joined_key()).alias("uuid"))


@query(f"SELECT vec_id, {NORM.format('tile_key')} AS norm_key FROM tiles", "tiles")
def norm_tile_key(spark, sf_dir):
    return view(spark, sf_dir, "tiles").select("vec_id", keys.norm_tile_key(keys.tile_key()).alias("norm_key"))


@query(f"WITH {DEDUP} SELECT nk AS norm_key, tissue_percentage FROM dedup", "ext")
def tissue_dedup_max(spark, sf_dir):
    return tissue.dedup_tissue(view(spark, sf_dir, "ext"))


@query(f"WITH f AS (SELECT {NORM.format('tile_key')} AS k, CASE WHEN stained THEN 'stained' ELSE 'unstained' END AS m, max(tissue_percentage) AS t FROM blur GROUP BY 1, 2) SELECT e.vec_id, e.tile_key, coalesce(f.t, e.tissue_percentage) AS tissue_percentage FROM ext e LEFT JOIN f ON f.k = {NORM.format('e.tile_key')} AND f.m = e.modality", "ext", "blur")
def enrich_update_from(spark, sf_dir):
    return tissue.enrich(view(spark, sf_dir, "ext"), view(spark, sf_dir, "blur")).select("vec_id", "tile_key", "tissue_percentage")


def _inner(op: str) -> str:
    return f"WITH {DEDUP} SELECT t.vec_id, d.tissue_percentage FROM tiles t JOIN dedup d ON d.nk = {NORM.format('t.tile_key')} WHERE d.tissue_percentage {op} 20"


@query(_inner(">="), "tiles", "ext")
def tissue_inner_filter(spark, sf_dir):
    return tissue.filter_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"), 20).select("vec_id", "tissue_percentage")


@query(_inner(">"), "tiles", "ext")
def tissue_inner_filter_strict(spark, sf_dir):
    return tissue.filter_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext"), 20, strict=True).select("vec_id", "tissue_percentage")


@query(f"WITH {DEDUP} SELECT t.vec_id, d.tissue_percentage FROM tiles t LEFT JOIN dedup d ON d.nk = {NORM.format('t.tile_key')}", "tiles", "ext")
def stratified_extended_left(spark, sf_dir):
    return tissue.with_tissue(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "ext")).select("vec_id", "tissue_percentage")


@query("SELECT modality, tissue_type, count(*) AS count FROM tiles WHERE modality = 'stained' GROUP BY 1, 2", "tiles")
def modality_class_counts(spark, sf_dir):
    return analysis.class_counts(view(spark, sf_dir, "tiles").where("modality = 'stained'"), ["modality", "tissue_type"])


def _targets(per_class: int, most: int) -> str:
    return f"r AS (SELECT lang, count(*) AS n, least(count(*), {per_class}) AS raw FROM documents WHERE lang IS NOT NULL AND lang <> '' AND NOT regexp_full_match(lang, '[0-9]+') GROUP BY 1), t AS (SELECT *, sum(raw) OVER () AS total FROM r), p AS (SELECT *, CASE WHEN total > {most} THEN raw * {most} // total ELSE raw END AS low, CASE WHEN total > {most} THEN raw * {most} % total ELSE 0 END AS rest FROM t), targets AS (SELECT lang, n, cast(low + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= least({most}, total) - sum(low) OVER () THEN 1 ELSE 0 END as bigint) AS target FROM p)"


QUOTAS = "ci AS (SELECT lang, source, count(*) AS n_ci FROM documents GROUP BY 1, 2), q AS (SELECT ci.*, target, n_ci * target // n AS low, n_ci * target % n AS rest FROM ci JOIN targets USING (lang)), quotas AS (SELECT lang, source, cast(low + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rest DESC, source) <= target - sum(low) OVER (PARTITION BY lang) THEN 1 ELSE 0 END as bigint) AS quota FROM q)"


@query(f"WITH {_targets(150, 401)} SELECT lang, n, target FROM targets")
def quota_targets(spark, sf_dir):
    return sampling.class_targets(view(spark, sf_dir, "documents"), "lang", 150, 401)


@query(f"WITH {_targets(150, 401)}, {QUOTAS} SELECT lang, source, quota FROM quotas")
def quota_per_source(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    return sampling.source_quotas(docs, "lang", "source", sampling.class_targets(docs, "lang", 150, 401))


@query(f"WITH {_targets(150, 401)}, {QUOTAS}, k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(cast(doc_id as string)), doc_id) AS rn FROM documents) SELECT k.doc_id, k.lang, k.source FROM k JOIN quotas USING (lang, source) WHERE rn <= quota")
def quota_sample(spark, sf_dir):
    return sampling.quota_sample(view(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 150, 401)


@query("SELECT cluster, id FROM preds QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5(id), id) <= 5", "preds")
def per_cluster_sample(spark, sf_dir):
    return sampling.per_group_sample(view(spark, sf_dir, "preds"), "cluster", "id", 5).select("cluster", "id")


@query("WITH s AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id as string)), doc_id) <= 30) SELECT doc_id, lang FROM s ORDER BY md5(cast(doc_id as string)), doc_id LIMIT 100")
def greedy_min_per_class(spark, sf_dir):
    return sampling.greedy_sample(view(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 30, 100)


@query("SELECT event_id FROM events ORDER BY md5(cast(event_id as string)), event_id LIMIT 500")
def hashed_shuffle_sample(spark, sf_dir):
    return sampling.hashed_sample(view(spark, sf_dir, "events").select("event_id"), "event_id", 500)


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def dedup_keep_first(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])


@query(f"WITH {CENTERS} SELECT cluster, i AS dim, round(center[i], 6) AS value FROM centers, range(1, 65) AS r(i)")
def centroids_by_label(spark, sf_dir):
    return label_centers(spark, sf_dir).select("cluster", F.posexplode("center").alias("p", "x")).select("cluster", (F.col("p") + 1).alias("dim"), F.round("x", 6).alias("value"))


@query(f"WITH {NEAREST} SELECT vec_id, cluster, round(dist, 6) AS distance FROM nearest", "tiles")
def assign_nearest(spark, sf_dir):
    return nearest_tiles(spark, sf_dir).select("vec_id", "cluster", F.round(F.sqrt("d2"), 6).alias("distance"))


@query(f"WITH {NEAREST} SELECT vec_id, cluster, round(dist, 6) AS distance FROM nearest", "tiles")
def assign_nearest_arrow(spark, sf_dir):
    rows = label_centers(spark, sf_dir).orderBy("cluster").collect()  # k rows
    got = kmeans.assign(view(spark, sf_dir, "tiles"), np.array([r["center"] for r in rows]))
    return got.select("vec_id", F.element_at(F.array(*(F.lit(r["cluster"]) for r in rows)), F.col("cluster") + 1).alias("cluster"), F.round(F.sqrt("d2"), 6).alias("distance"))


@query("SELECT t.vec_id, t.unique_id FROM tiles t WHERE modality = 'stained' AND NOT EXISTS (SELECT 1 FROM preds p WHERE p.unique_id = t.unique_id)", "tiles", "preds")
def predict_resume_remaining(spark, sf_dir):
    return kmeans.remaining(view(spark, sf_dir, "tiles"), view(spark, sf_dir, "preds"), "stained").select("vec_id", "unique_id")


@query(f"WITH {DEDUP}, s AS (SELECT t.vec_id, coalesce(cast(d.tissue_percentage as float), 100) AS x, cast(t.label as int) AS label FROM tiles t LEFT JOIN dedup d ON d.nk = {NORM.format('t.tile_key')}) SELECT vec_id, CASE WHEN x < 5 THEN -2 WHEN x < 20 THEN -1 ELSE label END AS cluster FROM s", "tiles", "ext")
def predict_relabel(spark, sf_dir):
    rows = tissue.with_tissue(labelled(spark, sf_dir), view(spark, sf_dir, "ext"))
    return rows.select("vec_id", tissue.relabel_single(F.col("cluster"), F.col("tissue_percentage")).alias("cluster"))


CASE = "CASE WHEN tissue_percentage < 5 THEN -2 WHEN tissue_percentage < 20 THEN -1 ELSE cluster END AS cluster"


@query(f"WITH b AS (SELECT {NORM.format('tile_key')} AS nk, tissue_percentage FROM (SELECT DISTINCT tile_key, tissue_percentage FROM ext WHERE modality = 'stained')) SELECT p.unique_id, {CASE}, tissue_percentage FROM preds p LEFT JOIN b ON b.nk = {NORM.format('p.tile_key')}", "preds", "ext")
def postprocess_fanout(spark, sf_dir):
    return tissue.postprocess(view(spark, sf_dir, "preds"), view(spark, sf_dir, "ext"), fan_out=True).select("unique_id", "cluster", "tissue_percentage")


POST = f"{DEDUP_STAINED}, post AS (SELECT p.unique_id, {CASE}, tissue_percentage FROM preds p LEFT JOIN dedup d ON d.nk = {NORM.format('p.tile_key')})"


@query(f"WITH {POST} SELECT unique_id, cluster, tissue_percentage FROM post", "preds", "ext")
def postprocess_dedup(spark, sf_dir):
    return tissue.postprocess(view(spark, sf_dir, "preds"), view(spark, sf_dir, "ext")).select("unique_id", "cluster", "tissue_percentage")


@query(f"WITH {POST}, b AS (SELECT cluster, count(*) AS n FROM preds GROUP BY 1), a AS (SELECT cluster, count(*) AS n FROM post GROUP BY 1) SELECT coalesce(b.cluster, a.cluster) AS cluster, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.cluster = b.cluster", "preds", "ext")
def counts_before_after_delta(spark, sf_dir):
    preds = view(spark, sf_dir, "preds")
    return tissue.count_delta(preds, tissue.postprocess(preds, view(spark, sf_dir, "ext")))


@query(f"WITH {ANALYSED} SELECT cluster, vec_id, tissue_type, tissue_percentage FROM a", "preds", "ext")
def analysis_default_tissue(spark, sf_dir):
    return analysed(spark, sf_dir).select("cluster", "vec_id", "tissue_type", "tissue_percentage")


COUNTS = f"{ANALYSED}, c AS (SELECT cluster, tissue_type, count(*) AS count FROM a WHERE {ALPHA} GROUP BY 1, 2)"


def _counts(spark, sf_dir):
    return analysis.class_counts(analysed(spark, sf_dir), ["cluster", "tissue_type"], "tissue_type")


@query(f"WITH {COUNTS} SELECT * FROM c", "preds", "ext")
def cluster_class_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


LETTERS = ("adrenalgland", "ovary", "brain", "breast", "skin", "colon", "lung", "kidney")


@query(f"WITH {COUNTS} SELECT cluster, " + ", ".join(f"cast(coalesce(sum(count) FILTER (tissue_type = '{t}'), 0) as bigint) AS {t}" for t in LETTERS) + f", cast(coalesce(sum(count) FILTER (coalesce(tissue_type, '') NOT IN {LETTERS}), 0) as bigint) AS other FROM c GROUP BY cluster", "preds", "ext")
def pivot_cluster_class(spark, sf_dir):
    return analysis.pivot_counts(_counts(spark, sf_dir), "cluster", "tissue_type", list(LETTERS), "other")


@query(f"WITH {COUNTS} SELECT tissue_type, " + ", ".join(f'cast(coalesce(sum(count) FILTER (cluster = {k}), 0) as bigint) AS "{k}"' for k in range(10)) + ", cast(coalesce(sum(count) FILTER (coalesce(cluster, -1) NOT BETWEEN 0 AND 9), 0) as bigint) AS other FROM c GROUP BY tissue_type", "preds", "ext")
def pivot_class_cluster(spark, sf_dir):
    return analysis.pivot_counts(_counts(spark, sf_dir), "tissue_type", "cluster", list(range(10)), "other")


@query(f"WITH {COUNTS} SELECT *, round(count / sum(count) OVER (PARTITION BY cluster), 9) AS share FROM c", "preds", "ext")
def share_cluster_class(spark, sf_dir):
    return analysis.shares(_counts(spark, sf_dir), "cluster")


@query(f"WITH {COUNTS} SELECT *, round(count / sum(count) OVER (PARTITION BY tissue_type), 9) AS share FROM c", "preds", "ext")
def share_class_cluster(spark, sf_dir):
    return analysis.shares(_counts(spark, sf_dir), "tissue_type")


@query("WITH s AS (SELECT cluster, count(*) AS n FROM preds GROUP BY 1) SELECT (SELECT cluster FROM s ORDER BY n, cluster LIMIT 1) AS smallest, (SELECT cluster FROM s ORDER BY n DESC, cluster LIMIT 1) AS largest, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size, round(median(n), 6) AS median_size FROM s", "preds")
def cluster_sizes_summary(spark, sf_dir):
    return analysis.size_summary(view(spark, sf_dir, "preds"))


@query(f"WITH {ANALYSED} SELECT cluster, count(*) AS total, count(*) FILTER (tissue_percentage < 20) AS low, round(count(*) FILTER (tissue_percentage < 20) / count(*) * 100, 6) AS low_percent FROM a GROUP BY 1", "preds", "ext")
def low_tissue_summary(spark, sf_dir):
    return analysis.low_tissue(analysed(spark, sf_dir))


@query(f"WITH {ANALYSED} SELECT x.cluster, y.tissue_type, count(a.vec_id) AS count FROM (SELECT DISTINCT cluster FROM a) x CROSS JOIN (SELECT DISTINCT tissue_type FROM a) y LEFT JOIN a ON a.cluster = x.cluster AND a.tissue_type = y.tissue_type GROUP BY 1, 2", "preds", "ext")
def cross_counts_zero_filled(spark, sf_dir):
    return analysis.zero_filled_counts(analysed(spark, sf_dir), "cluster", "tissue_type")


def _describe(c: str, t: str) -> str:
    x = f"cast({c} as double)"
    return f"SELECT '{c}' AS column, count({c}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM {t}"


@query(" UNION ALL ".join(_describe(c, "lineitem") for c in ("l_quantity", "l_discount")))
def describe_numeric(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem")
    return analysis.describe_numeric(rows, "l_quantity").unionByName(analysis.describe_numeric(rows, "l_discount"))


def _top(c: str, k: int) -> str:
    return f"SELECT '{c}' AS column, (SELECT count(DISTINCT {c}) FROM part) AS n_unique, cast({c} as string) AS value, count(*) AS count FROM part GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= {k}"


@query(" UNION ALL ".join(f"({_top(c, 5)})" for c in ("p_brand", "p_type")))
def describe_categorical_topk(spark, sf_dir):
    return analysis.describe_categorical(view(spark, sf_dir, "part"), ["p_brand", "p_type"], 5)


@query("WITH e AS (SELECT cast(o_totalprice as double) AS x FROM orders), m AS (SELECT min(x) AS low, max(x) AS high FROM e) SELECT cast(least(floor((x - low) / (high - low) * 40), 39) as int) AS bin, count(*) AS count FROM e, m GROUP BY 1")
def histogram_bins(spark, sf_dir):
    return analysis.histogram(view(spark, sf_dir, "orders"), "o_totalprice")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return view(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT e.vec_id, round((1 + {COS.format('e.embedding', 'q.embedding')}) / 2, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 50")
def knn_cosine_topk(spark, sf_dir):
    got = knn.knn(view(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 50, id_col="vec_id", vector="embedding")
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT t.vec_id, t.block_id, {COS.format('t.vector', 'q.vector')} AS c FROM tiles t, tiles q WHERE q.vec_id = 0 AND t.modality = 'stained' AND t.vec_id <> 7), k AS (SELECT * FROM s ORDER BY c DESC, vec_id LIMIT 40) SELECT vec_id, block_id, round((1 + c) / 2, 6) AS score FROM k WHERE block_id <> 'b3'", "tiles")
def knn_filtered_excluded(spark, sf_dir):
    got = knn.knn(view(spark, sf_dir, "tiles"), first_vector(spark, sf_dir), 40, documents.TermFilter(modality="stained").build(), 7, "b3", id_col="vec_id")
    return got.select("vec_id", "block_id", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS c FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, id, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 10")
def knn_join_blocks(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings")
    got = knn.knn_join(rows.where("vec_id % 100 = 0"), rows, 10, "vec_id", "embedding")
    return got.select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query("SELECT vec_id FROM tiles WHERE tissue_type = 'skin' AND modality = 'stained' AND slice_id = '2'", "tiles")
def term_filter(spark, sf_dir):
    return documents.scan(view(spark, sf_dir, "tiles"), documents.TermFilter(tissue_type="skin", modality="stained").add("slice_id", "2").build(), ["vec_id"])


@query("SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def terms_agg_topn(spark, sf_dir):
    return analysis.top_values(view(spark, sf_dir, "documents"), "source", 10)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def multi_get(spark, sf_dir):
    ids = view(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return documents.multi_get(view(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_custkey")


_RULES = {1: "unique_id", 2: "block_id", 3: "box_id", 4: "created_at", 5: "filename", 6: "tile_type", 7: "preprocessing", 8: "scan_date", 9: "slice_id", 10: "tissue_type", 12: "modality"}


@query("SELECT vec_id, CASE vec_id % 14 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in _RULES.items()) + " ELSE CASE WHEN NOT regexp_full_match(tissue_type, '[A-Za-z]+') THEN 'tissue_type' WHEN vec_id % 14 = 11 THEN 'slide_key' END END AS reason FROM bad_docs", "bad_docs")
def validate_documents(spark, sf_dir):
    return documents.validate(view(spark, sf_dir, "bad_docs")).select("vec_id", "reason")


@query("SELECT vec_id, unique_id FROM tiles WHERE vec_id % 3 = 0 AND unique_id NOT IN (SELECT unique_id FROM tiles WHERE vec_id % 2 = 0)", "tiles")
def ingest_skip_existing(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    return documents.new_documents(tiles.where("vec_id % 3 = 0"), tiles.where("vec_id % 2 = 0")).select("vec_id", "unique_id")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 'new' WHEN vec_id % 4 = 0 AND model <> 'm2' THEN 'changed' ELSE 'same' END AS status FROM tiles", "tiles")
def compare_update(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    old = tiles.where("vec_id % 2 = 0").withColumn("model", F.when(F.col("vec_id") % 4 == 0, "m2").otherwise(F.col("model")))
    return documents.changed_documents(tiles, old, "unique_id", ["model", "filename"]).select("vec_id", "status")


def _write_back(force: bool) -> str:
    return f"WITH d AS (SELECT vec_id, unique_id, CASE WHEN vec_id % 4 = 0 THEN '99' END AS cluster FROM tiles) SELECT d.vec_id, CASE WHEN p.unique_id IS NOT NULL AND ({str(force).lower()} OR d.cluster IS NULL) THEN cast(p.cluster as string) ELSE d.cluster END AS cluster, p.unique_id IS NOT NULL AND ({str(force).lower()} OR d.cluster IS NULL) AND cast(p.cluster as string) IS DISTINCT FROM d.cluster AS updated FROM d LEFT JOIN preds p USING (unique_id)"


@query(_write_back(False), "tiles", "preds")
def cluster_write_back(spark, sf_dir):
    docs = view(spark, sf_dir, "tiles").withColumn("cluster", F.when(F.col("vec_id") % 4 == 0, "99"))
    return documents.write_back(docs, view(spark, sf_dir, "preds")).select("vec_id", "cluster", "updated")


@query(_write_back(True), "tiles", "preds")
def cluster_write_back_force(spark, sf_dir):
    docs = view(spark, sf_dir, "tiles").withColumn("cluster", F.when(F.col("vec_id") % 4 == 0, "99"))
    return documents.write_back(docs, view(spark, sf_dir, "preds"), force=True).select("vec_id", "cluster", "updated")


@query("SELECT vec_id, tissue_type FROM tiles WHERE tissue_type IN ('skin', 'lung', 'brain')", "tiles")
def delete_unapproved(spark, sf_dir):
    return documents.keep_approved(view(spark, sf_dir, "tiles"), "tissue_type", ["skin", "lung", "brain"]).select("vec_id", "tissue_type")


@query(f"SELECT slide_key, round({DIST.format('vector_chem', 'vector_virt')}, 6) AS distance FROM pairs", "pairs")
def paired_distance(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    both = paired.align(pairs.select("slide_key", F.col("vector_chem").alias("vector")), pairs.select("slide_key", F.col("vector_virt").alias("vector")))
    return paired.pair_distances(both).select("slide_key", F.round("distance", 6).alias("distance"))


PD = f"pd AS (SELECT *, {DIST.format('vector_chem', 'vector_virt')} AS distance FROM pairs)"
_STATS = "round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.75), 6) AS p75, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.99), 6) AS p99, round(stddev_samp(distance), 6) AS std"


def _pd(spark, sf_dir):
    return paired.pair_distances(view(spark, sf_dir, "pairs"))


@query(f"WITH {PD} SELECT cluster, {_STATS} FROM pd GROUP BY 1", "pairs")
def distance_stats_by_cluster(spark, sf_dir):
    return paired.group_stats(_pd(spark, sf_dir), "cluster", "distance")


_BOTH = f"{PD}, b AS (SELECT 'stained' AS type, cluster AS cluster_id, distance FROM pd UNION ALL SELECT 'virtual', cluster_virtual, distance FROM pd), s AS (SELECT type, cluster_id, {_STATS} FROM b GROUP BY 1, 2)"


def _both_stats(spark, sf_dir):
    both = F.inline(F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("cluster_id")) for t, c in (("stained", "cluster"), ("virtual", "cluster_virtual")))))
    return paired.group_stats(_pd(spark, sf_dir).select("distance", both), ["type", "cluster_id"], "distance")


@query(f"WITH {_BOTH} SELECT type, round(avg(mean), 5) AS avg_mean, round(avg(std), 5) AS avg_std FROM s GROUP BY 1", "pairs")
def model_summary_avg_std(spark, sf_dir):
    return _both_stats(spark, sf_dir).groupBy("type").agg(F.round(F.avg("mean"), 5).alias("avg_mean"), F.round(F.avg("std"), 5).alias("avg_std"))


@query(f"WITH {_BOTH}, r AS (SELECT *, round(CASE WHEN mean > 1e-6 THEN std / mean END, 6) AS std_ratio FROM s) SELECT type, cluster_id, std_ratio FROM r WHERE std_ratio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type ORDER BY std_ratio DESC, cluster_id) <= 5", "pairs")
def std_ratio_topn(spark, sf_dir):
    return paired.std_ratio_ranking(_both_stats(spark, sf_dir), ["type"], "cluster_id", 5).select("type", "cluster_id", "std_ratio")


@query(f"WITH {_BOTH} SELECT x.cluster_id, round(abs(x.std - y.std), 6) AS difference FROM s x JOIN s y ON x.cluster_id = y.cluster_id AND x.type = 'stained' AND y.type = 'virtual' ORDER BY 2 DESC, 1 LIMIT 5", "pairs")
def std_diff_topn(spark, sf_dir):
    s = _both_stats(spark, sf_dir)
    return paired.std_difference(s.where("type = 'stained'"), s.where("type = 'virtual'"), "cluster_id", 5).select("cluster_id", "difference")


@query("WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(cast(l_extendedprice as double), 0.25) AS q1, quantile_cont(cast(l_extendedprice as double), 0.75) AS q3 FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag, q.n, round(q1, 4) AS q1, round(q3, 4) AS q3, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY outliers DESC, l_returnflag) <= floor(count(*) OVER () * 0.4) AS is_top FROM o")
def iqr_outliers_topn(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    got = paired.top_outlier_groups(paired.outliers(rows, "l_returnflag", "price"), "l_returnflag", 0.4)
    return got.withColumn("q1", F.round("q1", 4)).withColumn("q3", F.round("q3", 4))


@query("SELECT cluster, cluster_virtual, count(*) AS count, cluster <> cluster_virtual AS mismatch FROM pairs GROUP BY 1, 2", "pairs")
def cluster_mismatch_matrix(spark, sf_dir):
    return paired.mismatch_matrix(view(spark, sf_dir, "pairs"), "cluster", "cluster_virtual")


@query("WITH p AS (SELECT string_split(tile_key, '_') AS p FROM tiles), v AS (SELECT unnest(['tissue', 'block', 'slice', 'date', 'box', 'file']) AS part, unnest([p[1], p[2], p[3], p[4], p[5], array_to_string(p[6:], '_')]) AS value FROM p WHERE len(p) >= 6) SELECT part, value, count(*) AS count FROM v GROUP BY 1, 2", "tiles")
def slide_key_part_counts(spark, sf_dir):
    return analysis.part_counts(view(spark, sf_dir, "tiles"), "tile_key", ["tissue", "block", "slice", "date", "box", "file"])


@query("SELECT cluster, round(avg(cast(ssim as double)), 6) AS ssim, round(avg(psnr), 6) AS psnr, round(avg(cast(mse as double)), 6) AS mse FROM quality GROUP BY 1", "quality")
def quality_by_cluster(spark, sf_dir):
    return view(spark, sf_dir, "quality").groupBy("cluster").agg(*(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("ssim", "psnr", "mse")))


@query("SELECT i AS cluster, coalesce(s.sample_count, 0) AS sample_count FROM range(0, 16) AS r(i) LEFT JOIN sampling s ON s.cluster = i", "sampling")
def spine_join_fill(spark, sf_dir):
    return analysis.spine_fill(view(spark, sf_dir, "sampling"), 16, "cluster", ["sample_count"])


@query("WITH s AS (SELECT avg(sample_count) AS m, stddev_samp(sample_count) AS s FROM sampling) SELECT cluster, sample_count, CASE WHEN sample_count < m - s.s THEN 'low' WHEN sample_count > m + s.s THEN 'high' ELSE 'mid' END AS category FROM sampling, s", "sampling")
def sampling_category(spark, sf_dir):
    return analysis.deviation_category(view(spark, sf_dir, "sampling"), "sample_count")


@query("WITH j AS (SELECT s.sample_count, cast(q.ssim as double) AS ssim, q.psnr, cast(q.mse as double) AS mse FROM quality q JOIN sampling s USING (cluster)) SELECT 'ssim' AS metric, round(corr(sample_count, ssim), 6) AS correlation FROM j UNION ALL SELECT 'psnr', round(corr(sample_count, psnr), 6) FROM j UNION ALL SELECT 'mse', round(corr(sample_count, mse), 6) FROM j", "sampling")
def metric_correlation(spark, sf_dir):
    rows = view(spark, sf_dir, "quality").join(view(spark, sf_dir, "sampling"), "cluster")
    return analysis.correlation(rows.select("sample_count", *(F.col(c).cast("double").alias(c) for c in ("ssim", "psnr", "mse"))), "sample_count", ["ssim", "psnr", "mse"])


@query(f"WITH {CENTERS}, cn AS (SELECT cast(label as int) AS cluster, count(*) AS n FROM embeddings GROUP BY 1), mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(cast(embedding[i] as double)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY 1)), d AS (SELECT c.cluster, {DIST.format('e.embedding', 'c.center')} AS d FROM embeddings e JOIN centers c ON c.cluster = e.label), w AS (SELECT cluster, sum(d * d) AS within, avg(d) AS s FROM d GROUP BY 1), b AS (SELECT cluster, center, n, within, s, n * power({DIST.format('center', 'mu')}, 2) AS between FROM centers JOIN cn USING (cluster) JOIN w USING (cluster), mu), r AS (SELECT x.cluster, max((x.s + y.s) / {DIST.format('x.center', 'y.center')}) AS r FROM b x JOIN b y ON x.cluster <> y.cluster GROUP BY 1) SELECT cast((SELECT count(*) FROM embeddings) as bigint) AS n, count(*) AS k, round(sum(within), 6) AS inertia, round(sum(between) / (count(*) - 1) / (sum(within) / ((SELECT count(*) FROM embeddings) - count(*))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM b")
def inertia_chi_dbi_fixed(spark, sf_dir):
    return kselect.cluster_metrics(labelled(spark, sf_dir))


@query(f"WITH x AS (SELECT a.vec_id AS i, a.label AS c, b.label AS c2, avg({DIST.format('a.embedding', 'b.embedding')}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), ab AS (SELECT i, c, min(d) FILTER (c = c2) AS a, min(d) FILTER (c <> c2) AS b FROM x GROUP BY 1, 2) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab")
def silhouette_exact(spark, sf_dir):
    return kselect.silhouette_of_all(labelled(spark, sf_dir), "vec_id")


@query("WITH d AS (SELECT model, k, lead(inertia) OVER w - 2 * inertia + lag(inertia) OVER w AS d2 FROM kmetrics WINDOW w AS (PARTITION BY model ORDER BY k)) SELECT model, k AS elbow_k FROM d WHERE d2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY d2 DESC, k) = 1", "kmetrics")
def elbow_second_difference(spark, sf_dir):
    return kselect.elbow(view(spark, sf_dir, "kmetrics"))


@query("SELECT model, k, round(inertia / first_value(inertia) OVER w, 6) AS inertia_norm, round(abs(inertia / lag(inertia) OVER w - 1) / (k - lag(k) OVER w) * 100, 6) AS inertia_roc FROM kmetrics WINDOW w AS (PARTITION BY model ORDER BY k)", "kmetrics")
def inertia_norm_roc(spark, sf_dir):
    return kselect.inertia_rates(view(spark, sf_dir, "kmetrics"))


@query("WITH l AS (SELECT model, k, 'calinski_harabasz' AS metric, calinski_harabasz AS score, -calinski_harabasz AS o FROM kmetrics UNION ALL SELECT model, k, 'davies_bouldin', davies_bouldin, davies_bouldin FROM kmetrics UNION ALL SELECT model, k, 'silhouette', silhouette, -silhouette FROM kmetrics) SELECT model, metric, k AS best_k, score, CASE WHEN metric = 'davies_bouldin' THEN 'min' ELSE 'max' END AS direction FROM l WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model, metric ORDER BY o, k) = 1", "kmetrics")
def best_k_per_metric(spark, sf_dir):
    return kselect.best_k(view(spark, sf_dir, "kmetrics"))


@query("WITH l AS (SELECT model, k, -calinski_harabasz AS o, 1 AS m FROM kmetrics UNION ALL SELECT model, k, davies_bouldin, 2 FROM kmetrics UNION ALL SELECT model, k, -silhouette, 3 FROM kmetrics), p AS (SELECT k FROM l WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model, m ORDER BY o, k) = 1), n AS (SELECT k, count(*) AS n FROM p GROUP BY 1) SELECT (SELECT k FROM n ORDER BY n DESC, k LIMIT 1) AS mode_k, (SELECT count(*) FROM n) AS distinct_k, cast(floor(median(k)) as int) AS median_k, count(*) AS proposals FROM p", "kmetrics")
def consensus_recommendation(spark, sf_dir):
    return kselect.consensus(kselect.best_k(view(spark, sf_dir, "kmetrics")).select(F.col("best_k").alias("k")))


@query()
def knee_point(spark, sf_dir):
    rows = view(spark, sf_dir, "kmetrics").collect()  # a point per model and k
    found = [(m, kselect.knee([r["k"] for r in rows if r["model"] == m], [r["inertia"] for r in rows if r["model"] == m])) for m in sorted({r["model"] for r in rows})]
    return spark.createDataFrame(found, "model string, knee_k double")


@query()
def kmeans_fit_sizes(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    return kmeans.assign(tiles, kmeans.fit(tiles, 8)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("inertia"))


@query()
def minibatch_fit_sizes(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    return kmeans.assign(tiles, kmeans.mini_batch_fit(tiles, 8)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("inertia"))


@query()
def pca_fixed(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    mean, axes, _ = kmeans.pca(tiles, 3)
    got = kmeans.project(tiles, mean, axes)
    return got.select("vec_id", *(F.round(F.col("projected")[i], 6).alias(f"pc{i + 1}") for i in range(3)))


@query()
def pca_variance(spark, sf_dir):
    _, _, ratio = kmeans.pca(view(spark, sf_dir, "tiles"), variance=0.95)
    return spark.createDataFrame([(i + 1, float(round(r, 9))) for i, r in enumerate(ratio)], "component int, ratio double")


@query()
def subclusters(spark, sf_dir):
    return kmeans.sub_clusters(labelled(spark, sf_dir), 3, rounds=5, id_col="vec_id")


@query(f"WITH {CENTERS} SELECT c.cluster, e.vec_id, round({DIST.format('e.embedding', 'c.center')}, 6) AS distance FROM embeddings e JOIN centers c ON c.cluster = e.label QUALIFY row_number() OVER (PARTITION BY c.cluster ORDER BY {DIST.format('e.embedding', 'c.center')}, e.vec_id) = 1")
def nearest_exemplar(spark, sf_dir):
    rows = labelled(spark, sf_dir).join(F.broadcast(label_centers(spark, sf_dir)), "cluster").withColumn("distance", vectors.distance(F.col("vector"), F.col("center")))
    return sampling.keep_first(rows, ["cluster"], [F.col("distance"), F.col("vec_id")]).select("cluster", "vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT 'matched' AS kind, count(*) AS n FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents) UNION ALL SELECT 'unmatched', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents) UNION ALL SELECT 'both_tables', count(*) FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents) UNION ALL SELECT 'labels_not_in_documents', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_match_unmatch(spark, sf_dir):
    a, b = (view(spark, sf_dir, n).select("doc_id") for n in ("labels", "documents"))
    kinds = {"matched": a.intersect(b), "unmatched": b.subtract(a), "either": a.union(b).distinct(), "both_tables": a.unionByName(b), "labels_not_in_documents": a.subtract(b)}
    out = None
    for k, d in kinds.items():
        one = d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT slide_key || '_' || short_box_name || '_' || filename AS slide_key, modality, preprocessing, cast(dimension as int) AS dimension, model, id, tissue_type, round(cast(vector[1] as double), 6) AS first_value FROM tiles", "tiles")
def flatten_nested(spark, sf_dir):
    tiles = view(spark, sf_dir, "tiles")
    meta = F.struct("tissue_type", "block_id", "slice_id", "scan_date", F.col("short_box_name").alias("box_id"), "filename", "tile_type")
    one = F.struct(F.struct("preprocessing", F.col("dimension").cast("int").alias("dimension"), "model").alias("metadata"), F.lit("2025-10-01").alias("created_at"), "vector")
    samples = tiles.groupBy("modality", "block_id").agg(F.collect_list(F.struct("id", F.lit("2025-10-01").alias("created_at"), meta.alias("metadata"), F.array(one).alias("embeddings"))).alias("s"))
    nested = samples.select(F.create_map("modality", "s").cast(readers.NESTED).alias("data"))
    got = readers.flatten_nested(nested)
    return got.select("slide_key", "modality", "preprocessing", "dimension", "model", "id", "tissue_type", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"))


@query("SELECT doc_id, lang, cast((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64 as bigint) AS chunk FROM documents")
def chunk_assignment(spark, sf_dir):
    return sampling.chunk_numbers(view(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 64)


@query("SELECT vec_id, tissue_type, block_id, slice_id, scan_date, short_box_name, filename || CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 = 0 THEN '-other' ELSE '' END AS filename, CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 = 0 THEN 'unknown' ELSE modality END AS modality, '/data/out/' || tissue_type || '/' || block_id || '/' || slice_id || '/' || scan_date || '/' || short_box_name || '/' || filename || '.tiff' AS built FROM tiles", "tiles")
def path_parse(spark, sf_dir):
    return view(spark, sf_dir, "tiles").select("vec_id", *keys.parse_path(F.col("full_file_path")), keys.object_path(F.col("tile_key"), "/data/out/", ".tiff").alias("built"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN cast(vec_id % 100 as int) END AS k, CASE WHEN vec_id % 3 = 0 THEN 1000 END AS min_samples, 'run_' || cast(vec_id % 4 as string) AS run_name, vec_id % 2 = 0 AS apply_pca FROM embeddings")
def filename_metadata(spark, sf_dir):
    path = F.expr("'/out/run_' || vec_id % 4 || '/metrics' || case when vec_id % 2 = 0 then '_with_pca' else '' end || case when vec_id % 3 = 0 then '_min_samples_1000' else '' end || case when vec_id % 5 <> 0 then '_k' || vec_id % 100 else '' end || '.csv'")
    return view(spark, sf_dir, "embeddings").select("vec_id", path.alias("p")).select("vec_id", *readers.file_metadata(F.col("p")))


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; in a temp folder only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
    return f"{base}/scratch-{uuid.uuid4().hex}"


@query(f"WITH {DEDUP_STAINED}, {NEAREST} SELECT n.unique_id, CASE WHEN coalesce(cast(d.tissue_percentage as float), 100) < 5 THEN -2 WHEN coalesce(cast(d.tissue_percentage as float), 100) < 20 THEN -1 ELSE n.cluster END AS cluster FROM nearest n LEFT JOIN dedup d ON d.nk = {NORM.format('n.tile_key')} WHERE n.modality = 'stained' QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY n.vec_id) = 1", "tiles", "ext")
def stream_equals_batch(spark, sf_dir):
    """Predictions by a stream over the tiles in three files, twice over the same input; the second pass adds nothing."""
    path, tiles = _scratch(spark), view(spark, sf_dir, "tiles")
    once = sampling.keep_first(tiles, ["unique_id"], [F.col("vec_id")])
    once.repartition(3).write.parquet(f"{path}/in")
    centers = np.array([r["center"] for r in label_centers(spark, sf_dir).orderBy("cluster").collect()])
    out = f"stream_{uuid.uuid4().hex}"
    for n in range(2):
        stream = micro.read_stream(spark, f"{path}/in", once.schema, 1)
        micro.predict_stream(stream, centers, out, f"{path}/state-{n}", view(spark, sf_dir, "ext")).awaitTermination()
    got = spark.table(out).select("unique_id", "cluster")
    got.write.parquet(f"{path}/out")
    spark.sql(f"DROP TABLE {out}")
    return spark.read.parquet(f"{path}/out")


@query("SELECT unique_id, min(vec_id) AS vec_id FROM tiles GROUP BY 1", "tiles")
def stream_ingest(spark, sf_dir):
    path = _scratch(spark)
    once = sampling.keep_first(view(spark, sf_dir, "tiles"), ["unique_id"], [F.col("vec_id")]).select("unique_id", "vec_id")
    once.repartition(3).write.parquet(f"{path}/in")
    out = f"ingest_{uuid.uuid4().hex}"
    for n in range(2):
        micro.ingest_stream(micro.read_stream(spark, f"{path}/in", once.schema, 1), out, f"{path}/state-{n}").awaitTermination()
    spark.table(out).write.parquet(f"{path}/out")
    spark.sql(f"DROP TABLE {out}")
    return spark.read.parquet(f"{path}/out")


@query()
def lsh_knn_recall(spark, sf_dir):
    rows, q = view(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)
    true = knn.knn(rows, q, 10, id_col="vec_id", vector="embedding").select("vec_id")
    near = knn.lsh_candidates(rows, q, vector="embedding").select("vec_id")
    return near.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(rows.agg(F.count(F.lit(1)).alias("rows"))).crossJoin(true.join(near, "vec_id").agg(F.count(F.lit(1)).alias("found_of_10"))).select("candidates", "rows", "found_of_10", F.round(F.col("candidates") / F.col("rows"), 6).alias("share"))


@query("WITH m AS (SELECT slide_key, list_sum(list_transform(list_zip(vector_chem, vector_virt), lambda z: power(cast(z[1] as double) - cast(z[2] as double), 2))) / 64 AS mse FROM pairs) SELECT slide_key, round(mse, 6) AS mse, round(10 * log10(1.0 / mse), 6) AS psnr FROM m", "pairs")
def image_metrics(spark, sf_dir):
    return paired.image_metrics(view(spark, sf_dir, "pairs"), "vector_chem", "vector_virt", 1.0).select("slide_key", "mse", "psnr")


@query()
def image_ssim(spark, sf_dir):
    return paired.ssim(view(spark, sf_dir, "pairs"), "vector_chem", "vector_virt", 8, peak=1.0).select("slide_key", F.round("ssim", 6).alias("ssim"))


@query("SELECT vec_id, modality, tissue_type FROM tiles", "tiles")
def sink_round_trip(spark, sf_dir):
    """Tiles written in bounded files by modality, and read again with the folders as columns."""
    path = _scratch(spark)
    sinks.write_parquet(view(spark, sf_dir, "tiles").select("vec_id", "modality", "tissue_type"), path, ["modality"], 100, "vec_id")
    return readers.read_parquet(spark, path, partitions_as_columns=True).select("vec_id", "modality", "tissue_type")
