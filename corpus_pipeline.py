"""Preparation of a training corpus from the documents table, stage by stage.

Each stage takes the rows that its predecessor kept, written as Parquet and read
again, and all but the last give back the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language_id, line_dedup, minhash_hamming, sentencepieces
from palimpsest.llm._store import drop_path, new_path, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = language_id.fit(language_id.training_rows(docs), key=F.col("doc_id"))
    return language_id.keep_identified(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows."""
    return line_dedup.remove_boilerplate(docs).drop("n_removed").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest id; rows with a null id and empty texts stay."""
    return minhash_hamming.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, however short an item is."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    ids = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return ids.select("doc_id", "lang", "source", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", tokens),
]

#: SQL has neither the language model nor MinHash nor pieces; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has parked goes when its rows are written
            rows = stage(spark, docs, sf_dir)
            path = new_path(spark, "stage")
            rows.write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.schema(rows.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
