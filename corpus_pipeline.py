"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, written as Parquet and read again; its decisions take
effect. All but the last return the columns of documents, with n_chars as the text's length. Rows are told by id and
text: a null id, or one that several texts share, costs no document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldstate.llm import best_fit_packing, common, language_id, line_dedup, ngram_jaccard, quality_rules

#: A document whose language is surer than this stays.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, least similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Rows of an Arrow batch: few where rows are whole texts, so that workers stay small; packing takes a batch's pieces as islands.
TEXTS, PIECES = 1000, 10000


def batches_of(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, or of no sure language, go."""
    batches_of(spark, TEXTS)
    found = language_id.fit_and_predict(docs, docs.where(~language_id.held_out()))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: texts that a rule rejects go."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated lines go, and documents that are nothing else."""
    batches_of(spark, TEXTS)
    left = line_dedup.dedup(docs).where("n_deleted = 0 or n_deleted < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies, that with the least id stays; without ids, one of them."""
    batches_of(spark, TEXTS)
    rows = ngram_jaccard.linked_rows(docs, SHINGLE, PERCENT)
    first = rows.groupBy("group").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("_key")).select("_key")
    keyed = docs.withColumn("_key", ngram_jaccard.row_key("doc_id", "text"))
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    batches_of(spark, PIECES)
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", languages), ("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("best_fit_packing", packing)]

#: SQL expresses neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name, clean=True)
    return docs
