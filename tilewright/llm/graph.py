"""Connected components, and candidate pairs from buckets, without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 1 << 19) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the edges (longs; direction, loops and repeats don't matter).

    Each round every node joins the neighbour (or itself) that comes first in a hashed order, and the edges are contracted to those; the
    random order makes chains collapse in a logarithmic number of rounds. A minimum per node is a partial aggregate, so a node with very
    many neighbours costs no more than its rows; the renaming joins are plain equi-joins, whose hot keys Spark splits. Once no more than `few`
    edges are left (8 MB), packed, one task joins them up: a round is some ten exchanges, each of which costs the driver a thread for a minute. All is
    kept in checkpoints, nothing comes to the driver but how many edges are left.
    """
    both = lambda d: d.select("a", "b").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    rest = cut(given.mapInArrow(thinned, "a long, b long"))
    left, nodes, steps = rest.count(), None, []
    while left > few:
        if nodes is None:
            rest = cut(both(rest).distinct())
            nodes = rest.select(F.col("a").alias("node")).distinct()
            rest = rest.where("a <> b")
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        step = cut(rest.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(F.col("m"), order("a"))["id"].alias("to")))
        steps.append(step)
        moved = rest.join(step.select("a", F.col("to").alias("a2")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        rest = cut(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct())
        left = rest.count() // 2
    last = rest.mapInArrow(packed_edges, "data binary").repartition(1).mapInArrow(named, "node long, root long")
    if nodes is None:
        return last.select("node", F.col("root").alias("component"))
    names = nodes.select("node", F.col("node").alias("root"))
    for n, step in enumerate([*steps, cut(last).select(F.col("node").alias("a"), F.col("root").alias("to"))]):
        names = names.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = cut(names) if n % 6 == 5 else names
    least = names.groupBy("root").agg(F.min("node").alias("component"))
    return names.join(least, "root").select("node", "component")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a[i], b[i]), ascending, and the smallest one reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while not (up := root[root]).tobytes() == root.tobytes():  # chains by halves
            root = up
        i, j = root[i], root[j]
        i, j = i[i != j], j[i != j]
    return nodes, nodes[root]


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join up what those of a batch do: each node with the smallest one reachable, that one with itself."""
    for batch in batches:
        nodes, least = joined(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["a", "b"])


def packed_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]) for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["data"])


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.frombuffer(x, np.int64).reshape(2, -1) for batch in batches for x in batch.column(0).to_pylist()]
    if held:
        nodes, least = joined(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "root"])


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each of n items' group, for the linked pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            ri, rj = root[i], root[j]
            while True:
                up = root[ri], root[rj]
                if (up[0] == ri).all() and (up[1] == rj).all():
                    break
                ri, rj = up
            low, high = np.minimum(ri, rj), np.maximum(ri, rj)
            np.minimum.at(root, high, low)
            still = low != high
            i, j = i[still], j[still]
            if not still.any():
                break
    while not (root[root] == root).all():
        root = root[root]
    return root


def bucket_pairs(rows: DataFrame, most: int = 12) -> DataFrame:
    """From rows (id long, keys array<long>), where ids that share keys[t] lie in bucket (t, keys[t]): the pairs (t, k, a, b), a < b, of each
    bucket of up to `most` ids, and for a larger bucket one row with null a and b, for a method that splits it. An id with the same keys may
    come in several rows.

    Rows are thinned where they are: of a bucket, a batch passes on most + 1 ids at most, enough to show that it is large. The rest is dealt
    out by bucket and sorted; a bucket is read as a run, and of a large one most + 1 rows at a time are held.
    """

    def thin(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            size = np.diff(keys.offsets.to_numpy())
            k = keys.flatten().to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            i, t = np.repeat(ids, size), np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((i, k, t))
            again = (np.diff(t[order]) == 0) & (np.diff(k[order]) == 0) & (np.diff(i[order]) == 0)
            order = order[np.concatenate([[True], ~again])]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(k[order]) != 0) | (np.diff(t[order]) != 0)]))
            order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) <= most]
            yield pa.RecordBatch.from_arrays([pa.array(t[order].astype(np.int32)), pa.array(k[order]), pa.array(i[order])], names=["t", "k", "id"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            t, k, i = [np.concatenate(x) for x in zip(held, new)] if held else new
            if not len(t):
                continue
            new_row = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            t, k, i = t[new_row], k[new_row], i[new_row]
            starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            last = int(starts[-1])
            yield from pairs(t[:last], k[:last], i[:last], starts[:-1])
            last = max(last, len(t) - most - 1)  # of an open run no more than shows that it is large
            held = [t[last:], k[last:], i[last:]]
        if held:
            yield from pairs(*held, np.zeros(1, np.int64))

    def pairs(t, k, i, starts):
        sizes = np.diff(np.append(starts, len(t)))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for n in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
            at = starts[sizes == n]
            grid = i[at[:, None] + np.arange(n)]
            x, y = np.triu_indices(n, 1)
            low, high = np.minimum(grid[:, x], grid[:, y]).ravel(), np.maximum(grid[:, x], grid[:, y]).ravel()
            for c, v in zip(cols, (np.repeat(t[at], len(x)), np.repeat(k[at], len(x)), low, high, np.zeros(len(low), bool))):
                c.append(v)
        hot = starts[sizes > most]
        if len(hot):
            for c, v in zip(cols, (t[hot], k[hot], hot, hot, np.ones(len(hot), bool))):
                c.append(v)
        if cols[0]:
            tt, kk, low, high, skip = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(tt.astype(np.int32)), pa.array(kk), pa.array(low, mask=skip), pa.array(high, mask=skip)], names=["t", "k", "a", "b"])

    thinned = rows.select("id", "keys").mapInArrow(thin, "t int, k long, id long")
    return thinned.repartition("t", "k").sortWithinPartitions("t", "k", "id").mapInArrow(run, "t int, k long, a long, b long")


def link(payload: DataFrame, in_pairs: Callable, in_blocks: Callable, data: list[str], most: int = 12, block_rows: int = 1024, weight: str | None = None, block_weight: int = 1, lazily: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Which of the candidates are linked, counted and joined up, without a row for each pair of a large bucket.

    payload: id long, copies long (what a link to this id counts), keys array<long>, and the columns in `data`. in_pairs(a, b) and
    in_blocks(a, b) get the data of two sides as lists of columns and say for each pair of rows, or for each row of a against each row of b,
    whether they are linked. Returns rows (id, links), to be summed by id, and edges (a, b) that join what is linked.

    lazily: gives the columns in `data` by id for a frame of ids, where payload doesn't hold them; only candidates are asked for.

    A pair that meets in several buckets counts in the first t where its keys agree, whether that bucket is small or large.
    """
    every = ["id", "copies", "keys", *data]
    found = cut(bucket_pairs(payload, most))
    hot = found.where("a is null").select("t", "k").distinct()
    spots = payload.select("id", *([weight] if weight else []), F.posexplode("keys").alias("t", "k")).join(hot, ["t", "k"])
    if lazily is not None:
        spots = cut(spots)
        in_play = found.where("a is not null").select(F.explode(F.array("a", "b")).alias("id")).unionByName(spots.select("id")).distinct()
        payload = cut(payload.select("id", "copies", "keys").join(lazily(in_play), "id"))
    small = found.where("a is not null").groupBy("a", "b").agg(F.min("t").alias("t"))
    side = lambda c: payload.select(F.col("id").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in every[1:]))
    small = small.join(side("a"), "a").join(side("b"), "b").select("t", "a", *(f"a_{n}" for n in every[1:]), "b", *(f"b_{n}" for n in every[1:]))

    def check(batches):
        n = len(every)
        for b in batches:
            t = b.column(0).to_numpy(zero_copy_only=False)
            x, y = [b.column(i) for i in range(1, 1 + n)], [b.column(i) for i in range(1 + n, 1 + 2 * n)]
            same = np.array([next((j for j, (p, q) in enumerate(zip(u, v)) if p == q), -1) for u, v in zip(as_rows(x[2]), as_rows(y[2]))])
            ok = np.flatnonzero((same == t) & in_pairs(x[3:], y[3:]))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok)) for c in (x[0], x[1], y[0], y[1])], names=["a", "a_copies", "b", "b_copies"])

    close = small.mapInArrow(check, "a long, a_copies long, b long, b_copies long")
    meet = blocks(spots, block_rows, weight, block_weight).select("t", "k", "i", "j", "own", "id")
    meet = meet.join(payload.select(*every), "id").select("t", "k", "i", "j", "own", *every).repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "own", "id")

    def compare(batches):
        for (t, _, i, j), g in runs_of(batches, 4):
            own = g[4].to_numpy()
            sides = [[c.filter(pa.array(own == s)) for c in g[5:]] for s in (0, 1)] if i < j else [g[5:], g[5:]]
            (xi, xc, xk), (yi, yc, yk) = ((s[0].to_numpy(), s[1].to_numpy(), as_rows(s[2])) for s in sides)
            if not len(xi) or not len(yi):
                continue
            ok = in_blocks(sides[0][3:], sides[1][3:])
            for u in range(t):
                ok &= xk[:, u][:, None] != yk[:, u][None, :]
            if i == j:
                np.fill_diagonal(ok, False)
            at, to = np.nonzero(ok)
            ids = np.concatenate([xi, yi]) if i < j else xi
            links = np.concatenate([ok @ yc, ok.T @ xc]) if i < j else ok @ yc
            root = forest(len(ids), [(at, to + (len(xi) if i < j else 0))])
            use = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(ids[root[use]]), pa.array(links[use].astype(np.int64))], names=["id", "root", "links"])

    joined = cut(meet.mapInArrow(compare, "id long, root long, links long").unionByName(close.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("root"), F.col("b_copies").alias("links")), F.struct(F.col("b").alias("id"), F.col("b").alias("root"), F.col("a_copies").alias("links")))).alias("x")).select("x.*")))
    return joined.select("id", "links"), joined.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def as_rows(lists: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def runs_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Groups of rows sorted by their first n_keys columns: the keys, and all columns of the group."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if not held.num_rows:
            continue
        keys = [held.column(i).to_numpy() for i in range(n_keys)]
        starts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()] if held.num_rows > 1 else [0]
        for a, b in zip(starts, starts[1:]):
            part = held.slice(a, b - a).combine_chunks()
            yield tuple(int(k[a]) for k in keys), [c.chunk(0) for c in part.columns]
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        part = held.combine_chunks()
        yield tuple(int(c[0].as_py()) for c in part.columns[:n_keys]), [c.chunk(0) for c in part.columns]


def blocks(members: DataFrame, block_rows: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """members (t, k, id, ...) of large buckets, dealt to pairs of blocks (i <= j): each pair of ids of a bucket meets in one (t, k, i, j).

    A bucket gets as many blocks as its ids need at block_rows each (and at block_weight each, by the sum of column weight); an id lies in
    one block, by its hash, and is sent to every pair of its block with another. `own` says which side it is on: 0 for i, 1 for j.
    """
    total = F.ceil(F.count(F.lit(1)) / block_rows) if weight is None else F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(weight) / block_weight))
    n = members.groupBy("t", "k").agg(total.cast("int").alias("_n"))
    placed = members.join(n, ["t", "k"]).withColumn("_b", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_n")).cast("int"))
    spread = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return spread.select("*", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).cast("int").alias("own")).drop("_n", "_b", "_o")
