"""A keyed document table: term filters, validation, upsert, write-back, delete by predicate, look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable

#: The fields that can be filtered by, and the values that validation accepts.
FILTER_FIELDS = ("block_id", "box_id", "cluster", "created_at", "dimension", "dataset", "dataset_version", "filename", "id", "modality", "model", "preprocessing", "scan_date", "slice_id", "slide_key", "tile_type", "tissue_type", "unique_id")
VALID_MODALITIES = ("stained", "unstained", "stained-sr")
VALID_PREPROCESSING = ("resize", "center_crop")


class TermFilter:
    """A conjunction of equalities over known fields."""

    def __init__(self, **terms):
        self.terms: dict[str, object] = {}
        for k, v in terms.items():
            self.add(k, v)

    def add(self, field: str, value) -> TermFilter:
        if field not in FILTER_FIELDS:
            raise ValueError(f"unknown field: {field}")
        if value is not None:
            self.terms[field] = value
        return self

    def build(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in self.terms.items()), F.lit(True))


def scan(docs: DataFrame, where: Column | None = None, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    got = docs if where is None else docs.where(where)
    got = got if columns is None else got.select(*columns)
    return got if most is None else got.limit(most)


def multi_get(docs: DataFrame, ids: DataFrame, key: str = "unique_id") -> DataFrame:
    """The documents with one of these ids; Spark broadcasts the ids if they are few."""
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def count(docs: DataFrame, where: Column | None = None) -> int:
    """How many documents a filter leaves."""
    return scan(docs, where).count()


def tile_group(docs: DataFrame, size: int = 10_000, columns: list[str] | None = None, id_col: str = "unique_id", **terms) -> DataFrame:
    """The documents of a group of tiles, by any of its fields; `size` of them at most, the smallest ids first."""
    got = docs.where(TermFilter(**terms).build()).orderBy(id_col).limit(size)
    return got if columns is None else got.select(*columns)


def null_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column, how many rows lack a value."""
    return docs.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "column", "nulls")


#: Fixed value: dates and times in ISO 8601 as the validation takes them (days of months and weeks of years are looked at besides).
ISO_TIME = (
    r"\A(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W(?:0[1-9]|[1-4]\d|5[0-3])(?:-?[1-7])?)"
    r"(?:(?s:.)(?:(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?|(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?)?)?\z"
)


def is_iso_time(text: Column) -> Column:
    """Whether a string is a date, or a date and time, in ISO 8601; false for null."""
    digits = F.regexp_replace(F.substring(text, 1, 10), "[^0-9W]", "")
    year = F.substring(digits, 1, 4)
    day = lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd"))
    thursday = lambda d: F.dayofweek(day(F.concat(year, F.lit(d)))) == 5
    week = F.substring(digits, 5, 1) == "W"
    there = F.when(week, (F.substring(digits, 6, 2) != "53") | thursday("0101") | thursday("1231")).otherwise(day(F.substring(digits, 1, 8)).isNotNull())
    return F.coalesce(text.rlike(ISO_TIME) & (year != "0000") & there, F.lit(False))


def now_iso() -> Column:
    """The time of the query in ISO 8601, as created_at holds it."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def is_uuid(text: Column) -> Column:
    """Whether a string holds the 32 digits of a UUID, with or without hyphens, braces and the prefixes of a name; false for null."""
    digits = F.replace(F.btrim(F.replace(F.replace(text, F.lit("urn:")), F.lit("uuid:")), F.lit("{}")), F.lit("-"))
    return F.coalesce(digits.rlike(r"\A[0-9a-fA-F]{32}\z"), F.lit(False))


def reasons(columns: dict[str, str] | None = None, needs_model: bool = False) -> Column:
    """The name of the first rule that a document breaks, or null; needs_model: one without a model breaks a rule too. Patterns hold for whole
    values, line feeds included."""
    c = lambda n: F.col((columns or {}).get(n, n)).cast("string")
    bad = lambda n, pattern: ~F.coalesce(c(n).rlike(rf"\A(?:{pattern})\z"), F.lit(False))
    rules = [
        ("unique_id", ~is_uuid(c("unique_id"))),
        ("block_id", bad("block_id", "[a-z0-9]+")),
        ("box_id", bad("box_id", r"\p{Nd}+-\p{Nd}+")),
        ("created_at", ~is_iso_time(c("created_at"))),
        ("filename", bad("filename", r"tile_\p{Nd}+-\p{Nd}+-\p{Nd}+-\p{Nd}+")),
        ("modality", ~F.coalesce(c("modality").isin(*VALID_MODALITIES), F.lit(False))),
        ("tile_type", ~F.coalesce(c("tile_type").isin(*VALID_MODALITIES), F.lit(False))),
        ("preprocessing", ~F.coalesce(c("preprocessing").isin(*VALID_PREPROCESSING), F.lit(False))),
        ("scan_date", bad("scan_date", r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}")),
        ("slice_id", bad("slice_id", r"\p{Nd}+")),
        ("tissue_type", bad("tissue_type", "[A-Za-z]+")),
        ("slide_key", ~F.coalesce(c("slide_key") == F.concat_ws("_", c("tissue_type"), c("block_id"), c("slice_id"), c("scan_date"), c("box_id"), c("filename")), F.lit(False))),
        *([("model", c("model").isNull() | (c("model") == ""))] if needs_model else []),
    ]
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def validate(docs: DataFrame, needs_model: bool = False) -> DataFrame:
    """docs with reason, and valid."""
    return docs.withColumn("reason", reasons(needs_model=needs_model)).withColumn("valid", F.col("reason").isNull())


def with_defaults(docs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """docs with a value (or an expression, such as now_iso()) where they lack one, or the column."""
    for name, value in defaults.items():
        docs = docs.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in docs.columns else F.lit(value))
    return docs


def new_documents(new: DataFrame, old: DataFrame, key: str = "unique_id") -> DataFrame:
    """What isn't there yet; documents without a key are rejected."""
    return new.where(F.col(key).isNotNull()).join(old.select(key), key, "left_anti")


def changed_documents(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New documents, and those whose content differs from what is there; times of writing aren't content."""
    digest = F.md5(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns)))
    there = old.select(F.col(key).alias("_key"), digest.alias("_old"))
    got = new.withColumn("_new", digest).join(there, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_key").isNull(), "new").when(F.col("_new") != F.col("_old"), "changed").otherwise("same")
    return got.withColumn("status", status).drop("_key", "_old", "_new")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_back(docs: DataFrame, preds: DataFrame, key: str = "unique_id", force: bool = False) -> DataFrame:
    """docs with the clusters of preds where they have none (force: everywhere that preds has one), and with updated."""
    p = preds.select(F.col(key).alias("_key"), F.col("cluster").cast("string").alias("_p"))
    got = docs.join(p, F.col(key) == F.col("_key"), "left")
    take = F.col("_p").isNotNull() & (F.lit(force) | F.col("cluster").isNull())
    return got.withColumn("updated", take & ~F.col("_p").eqNullSafe(F.col("cluster"))).withColumn("cluster", F.when(take, F.col("_p")).otherwise(F.col("cluster"))).drop("_key", "_p")


def write_back_changes(docs: DataFrame, preds: DataFrame, key: str = "unique_id", force: bool = False) -> DataFrame:
    """What write_back() would change, and nothing written: key, cluster before and after."""
    after = write_back(docs, preds, key, force).where("updated").select(key, F.col("cluster").alias("after"))
    return docs.select(key, F.col("cluster").alias("before")).join(after, key)


def write_back_into(table: KeyedTable, preds: DataFrame, force: bool = False) -> dict:
    """write_back() into a keyed table: the documents of preds are read, and only buckets of those that change are rewritten; the commit."""
    key = table.state()["key"]
    changed = write_back(table.get(preds.where("cluster is not null")), preds, key, force).where("updated")
    return table.update(changed.select(key, "cluster"))


def keep_approved(docs: DataFrame, field: str, approved: list) -> DataFrame:
    return docs.where(F.col(field).isin(*approved))


def rejected_preview(docs: DataFrame, field: str, approved: list, n: int) -> DataFrame:
    return docs.where(~F.coalesce(F.col(field).isin(*approved), F.lit(False))).limit(n)
