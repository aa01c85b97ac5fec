"""How sources of a language differ: smoothed shares of terms, compared between all sources of the language, and the terms that mark each source.

Groups (language and source) are dealt into blocks, the terms of a language into slices; a cell holds a block's vectors of one slice, compressed, and stays in
its partition. Blocks meet as in a round-robin tournament: in each round the vectors of one of two blocks travel to the other's cell, where both directions of all
their pairs are settled at once. So a round shuffles half of the vectors, once, and no task holds more than two cells. Terms are ranked by a heap in each cell
and merged over slices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, split_batch

#: A term's bytes: ASCII letters and all of characters beyond ASCII; and each byte with A-Z in lower case.
_INSIDE = np.array([65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms of a slice and groups of a block, on average.
SLICE_TERMS, BLOCK_GROUPS = 1 << 14, 8


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / size) for counts of at most size, exact for sizes up to 9 * 10 ** 15."""
    out, rest = np.zeros(np.broadcast(count, size).shape, np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digit
    return out + 1


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each pair of a text and a term in it: text, number of the term, occurrences."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    solid = _INSIDE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    ends = np.concatenate([[0], np.cumsum(last - first)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[buf[solid]])]).dictionary_encode()
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.searchsorted(text_ends, first, side="right")
    t = max(1, len(words.dictionary))
    pair, n = np.unique(text * t + words.indices.to_numpy(), return_counts=True)
    return words.dictionary, pair // t, pair % t, n


def count_terms(docs: DataFrame, group_cols: list[str], text_col: str) -> DataFrame:
    """The group columns, term, n (occurrences) and docs (rows that hold it); of each group a row without a term besides. Counted by batches of
    text first, then by Spark."""
    width = len(group_cols)
    schema = ", ".join([*(f"{c} string" for c in group_cols), "term string", "n long", "docs long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, width, 1 << 22):
                numbers: dict[tuple, int] = {}
                group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(*(part.column(i).to_pylist() for i in range(width)))], np.int64)
                terms, text, term, n = terms_of(part.column(width).cast(pa.binary()).to_pylist())
                t = max(1, len(terms))
                key, at = np.unique(group[text] * t + term, return_inverse=True)
                total, rows = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                groups = pa.array(np.concatenate([key // t, np.arange(len(numbers))]))
                none = pa.array([None] * len(numbers), pa.string())
                found = pa.concat_arrays([terms.take(pa.array(key % t)).cast(pa.large_string()).cast(pa.string()), none])
                zero = np.zeros(len(numbers), np.int64)
                columns = [pa.array([g[i] for g in numbers], pa.string()).take(groups) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, found, pa.array(np.append(total, zero)), pa.array(np.append(rows, zero))], names=[*group_cols, "term", "n", "docs"])

    return docs.select(*group_cols, text_col).mapInArrow(run, schema).groupBy(*group_cols, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- vectors


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: places in ascending order as differences, and counts, compressed."""
    import zstandard

    return zstandard.compress(np.diff(places, prepend=0).astype("<i4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data) if data else b""
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


class Block:
    """The groups of a cell: names, and of each vector the places and shares of its terms, and the share of any other term."""

    def __init__(self, groups: list[dict]):
        self.names = [g["source"] for g in groups]
        self.size = np.array([g["size"] for g in groups], np.int64)
        parts = [unpack(g["data"]) for g in groups]
        self.counts = [c for _, c in parts]
        self.at = [a for a, _ in parts]
        known = self.size > 0  # a language without terms has nothing to share
        self.rest = np.where(known, share(np.full(len(groups), SMOOTH), np.where(known, self.size, SMOOTH)), 0)
        self.p = [share(c + SMOOTH, m) for c, m in zip(self.counts, self.size.tolist())]


def meet(a: Block, b: Block, terms: int) -> np.ndarray:
    """The sum over all `terms` places of the difference between each vector of a and each of b."""
    out = np.zeros((len(a.names), len(b.names)), np.int64)
    lengths = np.array([len(x) for x in b.at])
    held = np.flatnonzero(lengths)
    at, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (b.at, b.p))
    rest = np.repeat(b.rest, lengths)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1][held]
    for i in range(len(a.names)):
        dense = np.full(terms, a.rest[i], np.int64)
        dense[a.at[i]] = a.p[i]
        ordered = np.sort(a.p[i])  # against what b has of terms that it doesn't hold
        total = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, b.rest)
        out[i] = b.rest * k - total[k] + (total[-1] - total[k]) - b.rest * (len(ordered) - k) + (terms - len(ordered)) * np.abs(a.rest[i] - b.rest)
        if len(at):
            own = dense[at]
            out[i, held] += np.add.reduceat(np.abs(own - p) - np.abs(own - rest), begins)
    return out


def opponent(block: Column, turn: int, blocks: int) -> Column:
    """Whom a block meets in a round: of an even number of blocks, each meets each other one in one of blocks - 1 rounds."""
    last = blocks - 1
    other = F.pmod(F.lit(2 * turn) - block, F.lit(last))
    return F.when(block == last, turn % last).when(other == block, last).otherwise(other).cast("int")


def hosts(block: Column, other: Column) -> Column:
    """Whether a block stays where it is when it meets the other: each does in about half of its rounds."""
    return F.when((block + other) % 2 == 0, block < other).otherwise(block > other)


def _pairs(cells: DataFrame, mine: str, theirs: str | None) -> DataFrame:
    """lang, a, b and f for the pairs of groups of two columns of a cell, or of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, terms, *groups = (c[row].as_py() for c in batch.columns)
                a, b = Block(groups[0]), Block(groups[-1])
                f = meet(a, b, terms)
                i, j = np.triu_indices(len(a.names), 1) if len(groups) == 1 else (x.ravel() for x in np.indices(f.shape))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(a.names, pa.string()).take(pa.array(i)), pa.array(b.names, pa.string()).take(pa.array(j)), pa.array(f[i, j])], names=["lang", "a", "b", "f"])

    return cells.select("lang", "terms", mine, *([theirs] if theirs else [])).mapInArrow(run, "lang string, a string, b string, f long")


def _marking(cells: DataFrame, most: int) -> DataFrame:
    """lang, source, item and value: of each group and cell the `most` terms whose share exceeds the language's most, by a heap (ties: the
    first in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, size, words, totals, groups = (c[row].as_py() for c in batch.columns)
                q, block = share(np.array(totals, np.int64) + SMOOTH, np.int64(size)), Block(groups)
                out = []
                for name, at, p in zip(block.names, block.at, block.p):
                    f = p - q[at]
                    out += [(name, words[k], v) for v, k in ((-x, k) for x, k in heapq.nsmallest(most, zip((-f[f > 0]).tolist(), at[f > 0].tolist())))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "item", "value"])

    return cells.select("lang", "lang_size", "words", "totals", "groups").mapInArrow(run, "lang string, source string, item string, value long")


def resident(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, computed once and partitioned by keys, so that joins by them move the other side only: an adaptive plan doesn't say how it partitions."""
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(rows.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top_terms: int = 50, slice_terms: int = SLICE_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value and rank (from 1 for each group and part, by value descending, then item).

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those in least_docs of its rows. A group's share of a
    term is 1 + floor(10 ** 9 * (count + 5) / (N + 5 * V)), N being its occurrences of kept terms and V their number in the language. Part 'pair': each other source of the
    language, value the sum over all kept terms of the difference of shares. Part 'term': the top_terms terms of the group whose share exceeds the
    language's most, value the excess. Nulls count as empty strings; repeated rows are rows of their own; a group without terms has its pairs too;
    texts are taken whole; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = cut(count_terms(text, ["lang", "source"], "text"))
    kept = cut(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    groups = counts.select("lang", "source").distinct()
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    most_terms = per_lang.agg(F.max("v")).first()[0] or 1
    most_groups = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slices, blocks = -(-most_terms // slice_terms), 2 * max(1, -(-most_groups // (2 * block_groups)))

    placed = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")).withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)  # a slice's terms
    entries = counts.drop("docs").join(placed.drop("total"), ["lang", "term"]).groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("e"), F.sum("n").alias("n"))
    vectors = cut(_packed(entries))
    words = placed.groupBy("lang", "slice").agg(F.sort_array(F.collect_list(F.struct("place", "term", "total"))).alias("e")).select("lang", "slice", F.col("e.term").alias("words"), F.col("e.total").alias("totals"))

    sizes = groups.join(vectors.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    seats = sizes.select("lang", "source", (F.col("group_n") + SMOOTH * F.col("v")).alias("size"), (F.col("lang_n") + SMOOTH * F.col("v")).alias("lang_size"), F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    cells = seats.join(vectors.drop("n"), ["lang", "source", "slice"], "left").groupBy("lang", "slice", "block").agg(F.sort_array(F.collect_list(F.struct("source", "size", "data"))).alias("groups"), F.max("lang_size").alias("lang_size"))
    cells = cells.join(words.select("lang", "slice", F.size("words").alias("terms")), ["lang", "slice"], "left").na.fill(0, ["terms"])
    cells = resident(cells, "lang", "slice", "block")

    meetings = [scratch.table(_pairs(cells, "groups", None))]
    for turn in range(blocks - 1):
        other = opponent(F.col("block"), turn, blocks)
        visitors = cells.where(~hosts(F.col("block"), other)).select("lang", "slice", other.alias("block"), F.col("groups").alias("visiting"))
        meetings.append(scratch.table(_pairs(cells.join(visitors.hint("shuffle_hash"), ["lang", "slice", "block"]), "groups", "visiting")))
    total = reduce(DataFrame.unionByName, meetings).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = total.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    marking = _marking(cells.join(words, ["lang", "slice"]), top_terms)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(marking, "term").where(F.col("rank") <= top_terms))


def _packed(entries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(3)
            ends, flat = e.offsets.to_numpy(), e.values
            place, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            data = [pack(place[a:b], n[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary()), batch.column(4)], names=["lang", "source", "slice", "data", "n"])

    return entries.mapInArrow(run, "lang string, source string, slice int, data binary, n long")
