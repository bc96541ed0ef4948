"""Registered queries of the package: thin selections over the operators, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import fingerprint, language, packing, pieces, prefix_trie, quality, repair, secret_scan, shingle_join, suffix_dedup, toxicity, vector_join, warc
from .frames import fold

# Places of the public vocabulary files; parameters of the operators that use them.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Machine:
    """Fitted on the documents table and its labels outside the held-out fold."""
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0, metadata=("n_chars",))


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scale = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0)
    return toxicity.with_severity(docs, scale).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "grade", "severity", "p_toxic",
                                                      (F.col("p_toxic") >= 0.3).cast("int").alias("toxic"))


@query
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.with_scores(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    return (language.with_language(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_secrets(spark, sf_dir):
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op6_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, WORD_TOKENIZER).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_vector_join(spark, sf_dir):
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query
def op8_shingle_join(spark, sf_dir):
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_pieces(spark, sf_dir):
    found = pieces.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    return found.select("doc_id", *[name for name, _ in pieces.COLUMNS])


@query
def op12_warc(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), least=0)
    read = warc.records(warc.located(archives))
    return read.select(warc.page_key("record_id", "long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       warc.page_key("refers_to", "long").alias("refers_to"), "error")


@query
def op13_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return repair.with_all(repair.repair(repair.damaged(turns)), turns)


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), group=5)
