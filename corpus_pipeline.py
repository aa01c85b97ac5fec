"""A corpus pipeline over the documents table: toxicity, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a frame; all but the last give the columns of documents, whatever others docs has. What a stage
gives is written as Parquet and read again by the next one, so a lost executor never costs more than the stage at hand; run() removes a stage's
table when the next one has been written, but for the one that its result reads.

Of every stage: an empty table gives an empty one; a null or empty text is a document without words, which no stage but the line dedup drops (see
there); texts of any length are taken whole; null ids and repeated rows are rows like others, except where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import lines, packing, pii, shingles, toxicity
from tilewright.llm.common import Scratch, cut, table
from tilewright.llm.queries import tokenizer
from tilewright.plans.shipping import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labels table, calls toxic. Each row is judged for itself by its text; without
    labels of both kinds none goes."""
    ship_package(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate_documents(docs, model).where(~F.col("toxic")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that come, or come similarly, earlier in the corpus, by doc_id (nulls last), text and line; a document that loses lines and has
    no word left goes, and no other does. Rows that are equal in doc_id and text keep the same lines."""
    ship_package(spark)
    left = lines.drop_repeats(docs, least_equal=1)
    return left.where("n_dropped = 0 or text rlike '[^ \\\\t-\\\\r]'").withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the smallest doc_id, of each group that five-word shingles link at a similarity of 0.8.

    Where doc_ids are repeated or missing, rows are numbered in the order of doc_id (nulls last), and the numbers take its place.
    """
    ship_package(spark)
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_row", F.monotonically_increasing_id()))
        gone = shingles.jaccard_join(rows, id_col="_row").where(~F.col("kept")).select(F.col("doc_id").alias("_row"))
        return rows.join(gone, "_row", "left_anti").select(*COLUMNS)
    gone = shingles.jaccard_join(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked by the name of its kind; n_chars follows where a text changes. Null texts stay null."""
    ship_package(spark)
    masked = docs.withColumn("_masked", pii.masked_text(pii.fit_field(docs))("text"))
    changed = F.col("_masked") != F.col("text")
    return masked.withColumn("n_chars", F.when(changed, F.char_length("_masked").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("_masked")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 4096 tokens at most; a null or empty text is one piece, its end token."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("near duplicates", drop_near_duplicates), ("personal data", mask_personal_data), ("packing", pack_sequences)]

#: Trained models and tokenizers aren't expressible in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.table(docs)
            scratch.drop(all_but=1)
    return docs
