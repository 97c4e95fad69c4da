"""Text expressions shared by the operators. Blanks are space, tab, line feed, vertical tab, form feed, carriage return."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.session import stage

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, _UPPER, _UPPER.lower())


def single_blanks(text: Column) -> Column:
    """Every run of blanks becomes one space; a single space is left alone, which spares most replacements."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo `n`; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def in_place(docs: DataFrame) -> DataFrame:
    """`row` (all columns) and `place`, which names the same row in every job: file and row number.

    A table that is not read from files is written to shared storage first.
    """
    placed = lambda df: df.select(F.struct(*[df[c] for c in docs.columns]).alias("row"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number")).alias("place"))
    try:
        return placed(docs)
    except AnalysisException:
        return placed(stage(docs, "placed"))
