"""Corpus pipeline over `documents`, stage after stage; each stage's result is written and read again as the next one's input.

1. quality: documents that the quality classifier rejects (score below 0.3) go.
2. near_duplicates: of each group of near duplicates by 5-word shingles the document with the smallest doc_id stays.
3. repeats: bytes in 100-byte strings that start earlier in the corpus are cut out; documents with nothing but white space left go.
4. secrets: secrets, also inside encoded layers, are masked.
5. packing: every document, closed by a separator, gets places in sequences of 2048 tokens. Returns the pieces.

Stages 3 and 4 change `text`, and `n_chars` with it. Documents with a null doc_id pass through stage 2 alone. Rows that repeat a doc_id are one document. Rows are kept as they are otherwise,
repeated ones too. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.llm import packing, quality, secret_scan, shingle_join, suffix_dedup
from contractlake.llm.queries import WORD_TOKENIZER, quality_model
from contractlake.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return quality.with_scores(docs.select(*COLUMNS), quality_model(spark, sf_dir), "_score").where("_score >= 0.3").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near duplicates the one with the smallest doc_id. Rows that repeat a doc_id are one document: they stay or go together."""
    groups = shingle_join.near_duplicates(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that stand earlier too."""
    kept = suffix_dedup.without_repeats(docs.select(*COLUMNS), replace=True)
    cut = F.col("n_removed") > 0
    return (kept.where(~cut | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    found = secret_scan.with_spans(docs.select(*COLUMNS), mask=True)
    return (found.withColumn("n_chars", F.when(F.col("spans") != "", F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, WORD_TOKENIZER).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each_group), ("repeats", cut_repeats), ("secrets", mask_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "pipeline")  # deleted when the program ends
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
