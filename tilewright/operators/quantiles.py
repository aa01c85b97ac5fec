"""Exact percentiles of groups of any size: mergeable sketches narrow each one down to a bracket, whose values alone are ordered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut points that a sketch gives, and the share of ranks that it may be off by: a tenth of a cell.
CELLS = 200
ACCURACY = 10 * CELLS
#: Cells on either side of the one that should hold the rank.
SPARE = 2


def percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float], most: int = 1 << 16) -> DataFrame:
    """The group columns, n (values) and q, an array of the percentiles at `shares`, interpolated between the values at the ranks below and above.

    Nulls are no values; a group without values isn't returned (no group columns: one row, if there is a value). While a group has more than `most`
    values, a sketch of each bracket cuts it into CELLS parts, and those around the rank are kept: counting them, exactly, shows where the bracket begins. A
    bracket that misses its rank is not taken. So what one task orders is bounded by `most`, but for what a few last passes leave, and equal values count
    as one there. Groups that are all smaller than that are ordered as they are.
    """
    held = rows.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col(value).cast("double").alias("_v")).where("_v is not null")
    keys = [f"_g{i}" for i in range(len(group))]
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    passes = passes_for(sizes.agg(F.max("_n")).first()[0] or 0, most)
    if not passes:  # no group has more values than a task may order
        whole = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.array(*map(F.lit, map(float, shares)))).alias("q")).where("n > 0")
        return whole.select(*(F.col(k).alias(c) for k, c in zip(keys, group)), "n", "q")
    brackets = brackets_of(held, sizes, keys, shares, passes)
    inside = _inside(held, brackets, keys).groupBy(*keys, "_p", "_below", "_at", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v")) + F.col("_below")
    lower, upper = F.floor("_at"), F.ceil("_at")
    found = inside.withColumn("_to", up_to).groupBy(*keys, "_p", "_at", "_n").agg(F.min(F.when(F.col("_to") > lower, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_to") > upper, F.col("_v"))).alias("_b"))
    q = F.when(lower == upper, F.col("_a")).otherwise((upper - F.col("_at")) * F.col("_a") + (F.col("_at") - lower) * F.col("_b"))
    got = found.select(*keys, "_n", "_p", q.alias("_q")).groupBy(*keys, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_q"))), lambda x: x["_q"]).alias("q"))
    return got.select(*(F.col(k).alias(c) for k, c in zip(keys, group)), F.col("_n").alias("n"), "q")


def passes_for(largest: int, most: int) -> int:
    """How often brackets are narrowed until they hold `most` values, by the share that a pass leaves."""
    return 0 if largest <= most else math.ceil(math.log(largest / most) / math.log(CELLS / (2 * SPARE + 2)))


def brackets_of(held: DataFrame, sizes: DataFrame, keys: list[str], shares: list[float], passes: int) -> DataFrame:
    """For each group and share (numbered _p): _low and _high, between which the values at its rank _at are, _below, the number of values under _low,
    and _within, of those between."""
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("_p"), F.lit(float(s)).alias("_s")) for i, s in enumerate(shares)))).alias("_x")
    out = sizes.select(*keys, "_n", "_low", "_high", every).select(*keys, "_n", F.col("_x._p").alias("_p"), (F.col("_x._s") * (F.col("_n") - 1)).alias("_at"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_within"), "_low", "_high")
    for _ in range(passes):
        out = _narrowed(held, out, keys)
    return out


def _inside(held: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each bracket; groups are matched null for null."""
    right = brackets.withColumnsRenamed({k: f"{k}r" for k in keys})
    same: Column = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return held.join(right if keys else F.broadcast(right), same).drop(*(f"{k}r" for k in keys))  # without groups: a row a share


def _narrowed(held: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    grid = [i / CELLS for i in range(CELLS + 1)]
    of = [*keys, "_p", "_n", "_at", "_below", "_within", "_low", "_high"]
    cuts = _inside(held, brackets, keys).groupBy(*of).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_cuts"))
    place = (F.col("_at") - F.col("_below")) / F.greatest(F.col("_within") - 1, F.lit(1)) * CELLS
    first, last = F.greatest(F.floor(place) - SPARE, F.lit(0)), F.least(F.ceil(place) + SPARE, F.lit(CELLS))
    tried = cuts.withColumn("_a", F.when(first == 0, F.col("_low")).otherwise(F.get("_cuts", first.cast("int")))).withColumn("_b", F.when(last == CELLS, F.col("_high")).otherwise(F.get("_cuts", last.cast("int")))).drop("_cuts")
    v = F.col("_v")
    counted = _inside(held, tried, keys).groupBy(*of, "_a", "_b").agg(F.count_if(v < F.col("_a")).alias("_under"), F.count_if((v >= F.col("_a")) & (v <= F.col("_b"))).alias("_kept"))
    below = F.col("_below") + F.col("_under")
    holds = (below <= F.floor("_at")) & (F.ceil("_at") < below + F.col("_kept"))
    pick = lambda new, old: F.when(holds, new).otherwise(F.col(old)).alias(old)
    return counted.select(*keys, "_n", "_p", "_at", pick(below, "_below"), pick(F.col("_kept"), "_within"), pick(F.col("_a"), "_low"), pick(F.col("_b"), "_high"))
