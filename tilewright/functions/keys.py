"""Identities, keys and paths as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_FIELDS = ("tissue_type", "block_id", "slice_id", "scan_date", "box_id", "filename", "tile_type", "preprocessing")
#: The DNS name space of version 5 identifiers, the modalities that a file name can end in.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
MODALITIES = ("stained", "unstained", "inferred")


def joined_key(fields: tuple[str, ...] = ID_FIELDS) -> Column:
    """The fields with slashes between; null if one of them is."""
    parts: list[Column] = []
    for f in fields:
        parts += [F.lit("/"), F.col(f).cast("string")]
    return F.concat(*parts[1:])


def md5_unique_id(fields: tuple[str, ...] = ID_FIELDS) -> Column:
    return F.md5(joined_key(fields))


def fill_unique_id(column: str = "unique_id", fields: tuple[str, ...] = ID_FIELDS) -> Column:
    """The id that is there, or else (null or empty) the MD5 one."""
    return F.when(F.col(column).isNull() | (F.col(column) == ""), md5_unique_id(fields)).otherwise(F.col(column))


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """The version 5 identifier of a name, without a UDF: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def norm_tile_key(key: Column) -> Column:
    """A tile key without its box segment: only the first one goes."""
    return F.regexp_replace(key, r"^(.*?)_[^_]+_tile_", r"$1_tile_")


def slide_key() -> Column:
    return F.concat_ws("_", "tissue_type", "block_id", "slice_id", "scan_date")


def tile_key(box: str = "short_box_name") -> Column:
    return F.concat_ws("_", "tissue_type", "block_id", "slice_id", "scan_date", F.col(box).cast("string"), "filename")


def object_path(key: Column, prefix: str, suffix: str) -> Column:
    """prefix/tissue/block/slice/date/box/tile_xsuffix of a key of six parts before the tile's own underscore; null for any other key."""
    p = F.split(key, "_")
    return F.when(F.size(p) == 7, F.concat(F.lit(prefix), F.array_join(F.slice(p, 1, 5), "/"), F.lit("/"), F.array_join(F.slice(p, 6, 2), "_"), F.lit(suffix)))


def key_to_path(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("_"), F.lit("/")), F.lit("tile/"), F.lit("tile_"))


def infer_modality(path: Column) -> Column:
    got = F.regexp_extract(F.lower(path), rf"-({'|'.join(MODALITIES)})\.tiff$", 1)
    return F.when(got == "", F.lit("unknown")).otherwise(got)


def parse_path(path: Column) -> list[Column]:
    """Columns of the last six segments of an image path (null where a path has fewer) and its modality; the file name without suffix."""
    p = F.split(path, "/")
    names = ("tissue_type", "block_id", "slice_id", "scan_date", "short_box_name")
    modality = infer_modality(path)
    stem = F.regexp_replace(F.try_element_at(p, F.lit(-1)), r"(?i)(-(stained|unstained|inferred))?\.tiff$", "")
    return [*(F.when(F.size(p) >= 6, F.try_element_at(p, F.lit(-6 + i))).alias(n) for i, n in enumerate(names)), F.when(F.size(p) >= 6, stem).alias("filename"), modality.alias("modality")]


def first_five_and_rest(key: Column) -> Column:
    """tissue, block, slice, date, box and the rest (joined again) of a key; null below six parts."""
    p = F.split(key, "_")
    return F.when(F.size(p) >= 6, F.concat(F.slice(p, 1, 5), F.array(F.array_join(F.slice(p, 6, 1000), "_"))))


def row_id() -> Column:
    """A surrogate id from the row's place; stable only for a plan that is computed once."""
    return F.md5(F.monotonically_increasing_id().cast("string"))


def swap_box(key: Column, box_id: Column, short_name: Column) -> Column:
    """A tile key with the box id between underscores replaced by the box's short name, where it occurs."""
    old, new = (F.concat(F.lit("_"), c.cast("string"), F.lit("_")) for c in (box_id, short_name))
    return F.when(F.contains(key, old), F.replace(key, old, new)).otherwise(key)


def image_path(prefix: str, stain: str, box: str = "box_id") -> Column:
    """prefix/tissue/block/slice/date/box/file-stain.tiff; the stain "virtual" is written as stained-sr."""
    suffix = {"virtual": "stained-sr"}.get(stain, stain)
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.concat_ws("/", "tissue_type", "block_id", "slice_id", "scan_date", F.col(box).cast("string"), "filename"), F.lit(f"-{suffix}.tiff"))


def rebase(path: Column, old: str, new: str | None) -> Column:
    """A path with one prefix in place of another; unchanged where there is none to put."""
    return path if new is None else F.replace(path, F.lit(old), F.lit(new))


def tile_type_of(path: Column) -> Column:
    """What stands after the last dash of a path, up to a dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "-"), -1), r"\."), 1)


def with_ids(rows, make: Callable[[], Column], name: str = "unique_id"):
    """rows with ids by the caller's own expression."""
    return rows.withColumn(name, make())


def with_paths(rows, make: Callable[[Column], Column], key: str = "tile_key", name: str = "path"):
    """rows with paths by the caller's own expression of the key."""
    return rows.withColumn(name, make(F.col(key)))


def dimension(vector: Column) -> Column:
    """The length of a vector; 0 for none."""
    return F.size(F.coalesce(vector, F.array().cast("array<float>")))
