"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens.

Each stage takes the documents that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages but the last
return the columns of `documents`.

- quality: documents scored below 0.3 by the factorisation machine go.
- line_dedup: recurring lines go from the texts of all documents but their first, unless only copies of one document hold
  them; n_chars follows.
- near_dedup: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
- mix: documents are drawn towards their source's target, some repeatedly, some not at all.
- tokens: per row its ids' number and digest and the digest of the decoded text.

Nulls, empty texts, repeated rows and empty tables have the results that the operators
define; a document without a text passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from factweave.llm.text import read_table
from factweave.session import stage

KEEP_FROM = 0.3


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = quality.train(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "n_chars", "quality", quality.Machine())
    scored = quality.with_score(docs.select(F.struct("*").alias("row"), "text", "n_chars"), models, name="score")
    return scored.filter(F.col("score") >= KEEP_FROM).select("row.*")


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(docs)
    length = F.when(F.col("lines_dropped") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    put = {"text": F.col("clean"), "n_chars": length}
    return clean.select(*[put.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_copies(docs).filter("stays").select("row.*")


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select("row.*")


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model())


STAGES = [("quality", _quality), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("mix", _mix), ("tokens", _tokens)]
ORACLE_SQL = None  # the classifier's training has no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
