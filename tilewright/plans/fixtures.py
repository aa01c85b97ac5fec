"""Deterministic views over the driver's tables, as DataFrames and as the common table expressions of the comparison SQL.

The select lists are written once, in SQL that both engines read; DIV(a, b) stands for whole-number division, AT(a, i) for
an element, from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TISSUES = ("adrenalgland", "ovary", "brain", "breast", "skin", "colon", "lung", "7", "t2", "kidney")
_ID = "tissue_type || '/' || block_id || '/' || slice_id || '/' || scan_date || '/' || cast(box_id as string) || '/' || filename || '/' || tile_type || '/' || preprocessing"
_PARTS = {
    "vec_id": "vec_id",
    "label": "label",
    "vector": "embedding",
    "id": "cast(vec_id as string)",
    "tissue_type": "CASE label " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TISSUES)) + " END",
    "block_id": "'b' || cast(vec_id % 20 as string)",
    "slice_id": "cast(vec_id % 3 + 1 as string)",
    "scan_date": "'2025-10-' || lpad(cast(vec_id % 28 + 1 as string), 2, '0')",
    "short_box_name": "cast((vec_id % 4) * 4100 as string) || '-' || cast((vec_id % 5) * 16400 as string)",
    "box_id": "64000 + vec_id % 4",
    "filename": "'tile_' || cast(512 * (vec_id % 25) as string) || '-' || cast(512 * DIV(vec_id, 25) as string) || '-' || cast(512 * (vec_id % 25) + 512 as string) || '-' || cast(512 * DIV(vec_id, 25) + 512 as string)",
    "modality": "CASE WHEN vec_id % 5 = 0 THEN 'unstained' ELSE 'stained' END",
    "preprocessing": "'resize'",
    "model": "'path_foundation'",
    "dimension": "64",
}
_SLIDE = "tissue_type || '_' || block_id || '_' || slice_id || '_' || scan_date"
_MORE = {
    "tile_type": "modality",
    "slide_key": _SLIDE,
    "tile_key": f"{_SLIDE} || '_' || short_box_name || '_' || filename",
    "full_file_path": "'/data/tiles/' || tissue_type || '/' || block_id || '/' || slice_id || '/' || scan_date || '/' || short_box_name || '/' || filename || '-' || CASE WHEN vec_id % 7 = 0 THEN upper(modality) WHEN vec_id % 11 = 0 THEN 'other' ELSE modality END || CASE WHEN vec_id % 6 = 0 THEN '.TIFF' ELSE '.tiff' END",
}
_EXT = f"SELECT vec_id, modality, {_SLIDE} || '_' || cast(box_id as string) || '_' || filename AS tile_key, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE cast((vec_id * 37) % 101 as double) END AS tissue_percentage FROM tiles WHERE vec_id % 13 <> 0 UNION ALL SELECT vec_id, modality, {_SLIDE} || '_' || cast(box_id + 1 as string) || '_' || filename AS tile_key, cast((vec_id * 53) % 101 as double) AS tissue_percentage FROM tiles WHERE vec_id % 13 <> 0 AND vec_id % 7 = 0"

#: Metrics of k clusterings of the embeddings (by label modulo k), of the first and of the second half of the components.
_KMETRICS = """
WITH ks AS (SELECT k FROM (VALUES (2), (3), (4), (5), (6), (8), (10)) AS t(k)),
x AS (SELECT vec_id, cast(label as int) AS label, CASE WHEN i <= 32 THEN 'front' ELSE 'back' END AS model, i, cast(AT(embedding, cast(i as int)) as double) AS v FROM embeddings, range(1, 65) AS r(i) WHERE label IS NOT NULL),
c AS (SELECT model, k, label % k AS c, i, avg(v) AS m FROM x, ks GROUP BY 1, 2, 3, 4),
d AS (SELECT vec_id, x.model, k, label % k AS own, c, sum((v - m) * (v - m)) AS d2 FROM x JOIN c ON c.model = x.model AND c.i = x.i GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT model, k, c, count(*) AS n, sum(d2) AS within, avg(sqrt(d2)) AS s FROM d WHERE own = c GROUP BY 1, 2, 3),
mu AS (SELECT model, i, avg(v) AS mu FROM x GROUP BY 1, 2),
b AS (SELECT c.model, k, c, sum((m - mu) * (m - mu)) AS away FROM c JOIN mu ON mu.model = c.model AND mu.i = c.i GROUP BY 1, 2, 3),
t AS (SELECT w.model, w.k, sum(n) AS n, sum(within) AS inertia, sum(n * away) AS apart FROM w JOIN b ON b.model = w.model AND b.k = w.k AND b.c = w.c GROUP BY 1, 2),
cd AS (SELECT p.model, p.k, p.c, q.c AS c2, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS far FROM c p JOIN c q ON p.model = q.model AND p.k = q.k AND p.i = q.i AND p.c <> q.c GROUP BY 1, 2, 3, 4),
e AS (SELECT cd.model, cd.k, cd.c, max((p.s + q.s) / far) AS worst FROM cd JOIN w p ON p.model = cd.model AND p.k = cd.k AND p.c = cd.c JOIN w q ON q.model = cd.model AND q.k = cd.k AND q.c = cd.c2 GROUP BY 1, 2, 3),
f AS (SELECT model, k, avg(worst) AS dbi FROM e GROUP BY 1, 2),
ab AS (SELECT vec_id, model, k, min(CASE WHEN own = c THEN sqrt(d2) END) AS a, min(CASE WHEN own <> c THEN sqrt(d2) END) AS b FROM d GROUP BY 1, 2, 3),
g AS (SELECT model, k, avg((b - a) / greatest(a, b)) AS sil FROM ab GROUP BY 1, 2)
SELECT t.model, t.k, round(inertia, 6) AS inertia, round(apart / (t.k - 1) / (inertia / (n - t.k)), 6) AS calinski_harabasz, round(dbi, 6) AS davies_bouldin, CASE WHEN t.model = 'front' THEN round(sil, 6) END AS silhouette
FROM t JOIN f ON f.model = t.model AND f.k = t.k JOIN g ON g.model = t.model AND g.k = t.k
"""

#: name: (what it reads, its SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tiles": (("embeddings",), f"SELECT *, md5({_ID}) AS unique_id FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _MORE.items())} FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM embeddings) AS p) AS q"),
    "ext": (("tiles",), _EXT),
    "blur": (("ext",), "SELECT tile_key, modality = 'stained' AS stained, cast((vec_id * 29) % 97 as double) AS tissue_percentage FROM ext WHERE vec_id % 2 = 0"),
    "preds": (("tiles",), "SELECT unique_id, id, slide_key, tile_key, short_box_name, cast(box_id as string) AS box_id, cast(label as int) AS cluster FROM tiles WHERE modality = 'stained' AND vec_id % 3 <> 0"),
    "pairs": (("embeddings",), "SELECT a.vec_id, 'slide_' || cast(a.vec_id as string) AS slide_key, a.embedding AS vector_chem, b.embedding AS vector_virt, cast(a.label as int) AS cluster, cast((a.label + a.vec_id % 2) % 10 as int) AS cluster_virtual FROM embeddings a CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % c.n"),
    "quality": (("part",), "SELECT cast(p_partkey as string) AS slide_key, cast(p_partkey % 12 as int) AS cluster, p_size / 50.0 AS ssim, cast(20 + p_size % 17 as double) AS psnr, p_retailprice / 100.0 AS mse FROM part"),
    "sampling": (("quality",), "SELECT cluster, cast(count(*) * (1 + cluster % 5) as bigint) AS sample_count FROM quality GROUP BY cluster"),
    "kmetrics": (("embeddings",), _KMETRICS),
    "bad_docs": (("tiles",), "SELECT vec_id, CASE WHEN vec_id % 14 = 1 THEN 'no-id' ELSE unique_id END AS unique_id, CASE WHEN vec_id % 14 = 2 THEN 'B 1' ELSE block_id END AS block_id, CASE WHEN vec_id % 14 = 3 THEN '17' ELSE short_box_name END AS box_id, CASE WHEN vec_id % 14 = 4 THEN 'yesterday' ELSE '2025-10-01 12:00:00' END AS created_at, CASE WHEN vec_id % 14 = 5 THEN 'tile_1-2-3' ELSE filename END AS filename, CASE WHEN vec_id % 14 = 12 THEN 'virtual' WHEN vec_id % 14 = 13 THEN 'stained-sr' ELSE modality END AS modality, CASE WHEN vec_id % 14 = 6 THEN 'inferred' WHEN vec_id % 14 = 13 THEN 'stained-sr' ELSE tile_type END AS tile_type, CASE WHEN vec_id % 14 = 7 THEN 'none' ELSE preprocessing END AS preprocessing, CASE WHEN vec_id % 14 = 8 THEN '25-10-01' ELSE scan_date END AS scan_date, CASE WHEN vec_id % 14 = 9 THEN 'x' ELSE slice_id END AS slice_id, CASE WHEN vec_id % 14 = 10 THEN NULL ELSE tissue_type END AS tissue_type, tissue_type || '_' || block_id || '_' || slice_id || '_' || scan_date || '_' || short_box_name || '_' || filename || CASE WHEN vec_id % 14 = 11 THEN 'z' ELSE '' END AS slide_key, CASE WHEN vec_id % 14 = 0 THEN '' ELSE model END AS model FROM tiles"),
}


def needed(name: str) -> list[str]:
    """The views that a view reads, in order, itself last."""
    out: list[str] = []
    for n in VIEWS.get(name, ((), ""))[0]:
        out += [x for x in needed(n) if x not in out]
    return [*out, name] if name in VIEWS else out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, sql = VIEWS[name]
    frames = {n: view(spark, sf_dir, n) for n in reads}
    for n in reads:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(re.sub(r"\bAT\(", "element_at(", re.sub(r"DIV\(([^,]+), (\d+)\)", r"(\1 div \2)", sql)), **frames)


def with_views(sql: str, *names: str) -> str:
    """SQL for the comparison: the views as common table expressions before it."""
    order: list[str] = []
    for n in names:
        order += [x for x in needed(n) if x not in order]
    ctes = [f"{n} AS ({re.sub(r'\bAT\(', 'list_element(', re.sub(r'DIV\(([^,]+), (\d+)\)', r'(\1 // \2)', VIEWS[n][1]))})" for n in order]
    lead = sql.lstrip()
    if lead.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, lead[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + lead
