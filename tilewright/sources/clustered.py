"""Tables laid out for look-ups by several columns: rows in the order of an interleaved key, small row groups, Bloom filters on ids."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that each column gives to the key: so many times its range is halved.
BITS = 8


def rank_cuts(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, tuple[int, list]]:
    """Of each column the length of what all its texts begin with, and values that part its rows into about 2 ** bits equal shares (fewer where
    values repeat)."""
    shares, cuts = [i / (1 << bits) for i in range(1, 1 << bits)], {}
    for c in columns:
        skip = 0
        if df.schema[c].dataType.simpleString() == "string":
            low, high = df.agg(F.min(c), F.max(c)).first()
            skip = len(os.path.commonprefix([low or "", high or ""]))
        got = df.select(_ordered(df, c, skip).alias("v")).agg(F.percentile_approx("v", shares, 20 << bits)).first()[0]
        cuts[c] = skip, sorted(set(got or []))
    return cuts


def _ordered(df: DataFrame, column: str, skip: int = 0) -> Column:
    """A column as a number that is ordered alike: of text, the six bytes behind its first `skip` characters; of other types, a hash."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(column).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(column).cast("timestamp").cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.substring(F.col(column), skip + 1, 6)), 1, 12), 12, "0"), 16, 10).cast("double")
    return F.xxhash64(column).cast("double")


def interleaved(df: DataFrame, columns: list[str], cuts: dict[str, tuple[int, list]], bits: int = BITS) -> Column:
    """A number whose bits are those of the columns' ranks in turn, so rows that agree in the first bits of all columns lie together. Nulls come first."""
    key = F.lit(0).cast("long")
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))

    def rank(c: str) -> Column:
        """How many cuts the value isn't below, by halving, spread over all bits, so that columns with few values count as much."""
        skip, values = cuts[c]
        at, many, value = F.array(*(F.lit(float(x)) for x in values)), len(values), _ordered(df, c, skip)
        place = F.aggregate(halves, F.lit(0), lambda low, half: F.when((low + half <= many) & (value >= F.get(at, low + half - 1)), low + half).otherwise(low))
        return F.floor(F.coalesce(place, F.lit(0)) * (1 << bits) / (many + 1)).cast("long")

    ranks = [rank(c) for c in columns]
    for b in range(bits):
        for i, r in enumerate(ranks):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(r, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + i))
    return key


def write_clustered(df: DataFrame, path: str, columns: list[str], bloom_on: list[str] = (), files: int | None = None, group_bytes: int = 1 << 20, bits: int = BITS, mode: str = "overwrite") -> None:
    """Parquet files whose row groups hold narrow ranges of all `columns` at once, so a filter on any of them skips most; and Bloom filters on ids.

    files: as many as the session shuffles to by default. group_bytes: of a row group, small so that there is something to skip.
    """
    if len(columns) * bits > 62:
        raise ValueError("too many columns for the bits of a key")
    keyed = df.withColumn("_key", interleaved(df, columns, rank_cuts(df, columns, bits), bits))
    dealt = keyed.repartitionByRange(files, "_key") if files else keyed.repartitionByRange("_key")
    writer = dealt.sortWithinPartitions("_key", *columns).drop("_key").write.mode(mode).option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 64)
    for c in bloom_on:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)
