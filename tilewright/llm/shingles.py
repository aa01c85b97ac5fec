"""N-gram Jaccard join of documents by MinHash banding, verified on the full sets of n-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_batch, unique_ids
from .graph import components, link
from .tokens import MIX, Words, grams_of, mixed

def plan_bands(similarity: float, recall: float) -> tuple[int, int]:
    """Bands and rows: the most rows for which the bands that give the recall at the similarity take 100 hashes at most."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 12):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows <= 100:
            best = (bands, rows)
    return best


class MinHash:
    """Band keys of sets of 64-bit numbers."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul, self.add = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) for _ in range(2))
        self.mul |= np.uint32(1)

    def keys(self, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """sets x bands keys of the sets that begin at starts (none is empty)."""
        x = (mixed(items) >> np.uint64(32)).astype(np.uint32)
        out, now, low = np.empty((self.bands, len(starts)), np.uint64), np.empty_like(x), np.empty(len(starts), np.uint32)
        for band in range(self.bands):
            key = np.full(len(starts), band + 1, np.uint64)
            for j in range(band * self.rows, (band + 1) * self.rows):
                np.multiply(x, self.mul[j], out=now)
                now += self.add[j]
                np.minimum.reduceat(now, starts, out=low)
                key *= MIX
                key += low
            out[band] = mixed(key)
        return np.ascontiguousarray(out.T).view(np.int64)


def gram_sets(texts: list, n: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text; null texts have none."""
    words = Words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    g, at = grams_of(words.hash, words.starts, n, whole=True)
    return [np.unique(g[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def jaccard_join(docs: DataFrame, similarity: tuple[int, int] = (4, 5), n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, component_id and kept.

    Documents are linked if the Jaccard similarity of their sets of word n-grams is at least similarity (a fraction). class_id is the smallest
    doc_id with the same set; component_id the smallest that links lead to; kept says that the row is the first of its component. A text of
    fewer than n words has one n-gram, of all its words; null texts and texts without words have none and link with nothing. Each row is a
    document of its own: rows of one doc_id, or without one, come in the order of their texts (nulls last), and only the first of a component
    is kept; a null doc_id gives null ids. Copies are compared once and count as a link each. An empty table gives an empty one; other columns
    are ignored. N-grams are named by 64-bit hashes.

    The bands are chosen for the recall at the threshold; pairs of equal band hashes are candidates, and every candidate is verified.
    """
    up, down = similarity
    bands, rows = plan_bands(up / down, recall)
    texts, back = unique_ids(docs, id_col, text_col)

    def encode(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            for part in split_batch(batch, 1, 1 << 19):
                sets = gram_sets(part.column(1).to_pylist(), n)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(size)
                keys = minhash.keys(np.concatenate(sets), (np.cumsum(size) - size)[some]) if len(some) else np.zeros((0, bands), np.int64)
                lists = np.zeros((len(sets), bands), np.int64)
                lists[some] = keys
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(lists.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()), column], names=["doc_id", "n_grams", "print", "keys"])

    coded = cut(texts.mapInArrow(encode, "doc_id long, n_grams long, print binary, keys array<long>"))
    some = coded.where("n_grams > 0")
    classes = cut(some.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.min("n_grams").alias("n_grams"), F.min("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()))

    def sets(batches):
        for batch in batches:
            for part in split_batch(batch, 1, 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tobytes() for g in gram_sets(part.column(1).to_pylist(), n)], pa.binary())], names=["id", "grams"])

    def full_sets(ids: DataFrame) -> DataFrame:
        """The n-grams of the classes asked for, from the text of one document each."""
        want = ids.join(classes.select("id", "class_id"), "id").select("id", F.col("class_id").alias("doc_id"))
        return texts.join(want, "doc_id").select("id", "text").mapInArrow(sets, "id long, grams binary")

    def linked(a: int | np.ndarray, b: int | np.ndarray, both: int | np.ndarray) -> bool | np.ndarray:
        return both * (up + down) >= up * (a + b)

    def pairs(a: list, b: list) -> np.ndarray:
        out = np.zeros(len(a[0]), bool)
        for i, (x, y) in enumerate(zip(a[0].to_pylist(), b[0].to_pylist())):
            p, q = len(x) // 8, len(y) // 8
            if min(p, q) * down >= up * max(p, q):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                out[i] = linked(p, q, int((both[1:] == both[:-1]).sum()))
        return out

    def blocks(a: list, b: list) -> np.ndarray:
        """Intersections as products of 0/1 matrices, some columns at a time; of n-grams that one row has no column is made."""
        (x, p), (y, q) = (([np.frombuffer(v, np.uint64) for v in s[0].to_pylist()], np.array([len(v) // 8 for v in s[0].to_pylist()])) for s in (a, b))
        kinds, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
        often = np.bincount(at) > 1
        place = np.where(often, np.cumsum(often) - 1, -1)[at]
        row = np.repeat(np.arange(len(x) + len(y)), np.concatenate([p, q]))
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        both = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, int(often.sum()), 4096):
            s, e = np.searchsorted(place, [low, low + 4096])
            m = np.zeros((len(x) + len(y), 4096), np.float32)
            m[row[s:e], place[s:e] - low] = 1
            both += m[: len(x)] @ m[len(x) :].T
        return linked(p[:, None], q[None, :], both)

    counts, edges = link(classes.select("id", "copies", "keys", "n_grams"), pairs, blocks, ["grams"], lazily=full_sets, weight="n_grams", block_weight=1 << 21)
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(edges).withColumnRenamed("node", "id")
    named = classes.select("id", "print", "class_id", "copies").join(counts, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select("print", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = coded.select("doc_id", F.when(F.col("n_grams") > 0, F.col("print")).alias("print")).join(named, "print", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if back is None:
        return out
    for c in ("doc_id", "class_id", "component_id"):
        out = out.join(back.select(F.col("_row").alias(c), F.col("doc_id").alias("_id")), c).withColumn(c, F.col("_id")).drop("_id")
    return out.select("doc_id", "class_id", "n_links", "component_id", "kept")
