"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, embeddings, lines, packing, passages, pii, quality, shingles, tandem, toxicity, warc
from ..plans.shipping import shipped
from .common import Scratch, table
from .oracles import ORACLE_SQL as ORACLE_SQL


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; the folder is installed beside the libraries and never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_itq_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeats(table(spark, sf_dir, "documents"), least_equal=1).select("doc_id", "n_dropped", "text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_join(table(spark, sf_dir, "documents"))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit_field(docs)).drop("masked")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_conversations(chat.added_conversation(table(spark, sf_dir, "conversations")))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history")


def op9_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = toxicity.rate_documents(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", "toxic", (~F.col("toxic")).alias("kept"), "severity", "grade", "p_toxic")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.digest_runs(tandem.find_runs(tandem.with_looped_tails(table(spark, sf_dir, "documents"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(table(spark, sf_dir, "pages"), Scratch(spark))
    return warc.read_pages(warc.read_archives(archives, payloads=False))


_ALL = (op1_itq_near_dup, op2_bpe_automaton, op3_quality_trees, op4_line_dedup, op5_jaccard_join, op6_pii_crf, op7_best_fit_packing, op8_chat_format, op9_collinear_chains, op10_ordinal_toxicity, op11_periodic_runs, op12_source_divergence, op13_warc_zstd)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: shipped(f) for f in _ALL}
