"""The corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination,
byte-level BPE. Each stage reads what its predecessor kept; every stage but the last returns the
columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddy.config import ensure_checkpoint_dir, prepare
from eddy.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from eddy.llm.common import is_held_out, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and so a language; `lang` becomes the predicted one. Learns
    from the labels of the documents whose crc32 modulo 4 is not 2."""
    prepare(spark)
    model = language_id.fit_on(docs.where(~is_held_out("doc_id", 4, 2)))
    found = language_id.identify(docs, model, lang_col="__lang", score_col="__score").where(F.col("__lang") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier, equal or within two edits."""
    prepare(spark)
    return line_dedup.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest doc_id (a null one is the
    largest). Rows are judged by their own text, whatever id they have or share."""
    prepare(spark)
    return jaccard_join.first_of_copies(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark; one of which no word is left goes."""
    prepare(spark)
    bench = table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, bench, cut=True)
    hit = F.size("hit_words") > 0
    left = found.where(~hit | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    prepare(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]

# Language ID is learned, so SQL cannot express the pipeline; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
