"""Landed raw documents: content hashes, provenance and document pins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.functions.identity import content_id


def landed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per landed file with its hash; content is hashed where it is read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("source_file"), F.col("length").alias("byte_count"), F.col("modificationTime").alias("retrieved_at"),
                F.sha2("content", 256).alias("content_sha256"), "content")
    )


def with_content_hash(df: DataFrame, content: str, url: str | None = None, identity: Sequence[str] = ()) -> DataFrame:
    """Content hash, size and document identity of landed text."""
    return df.withColumns({
        "content_sha256": F.sha2(F.col(content), 256),
        "byte_count": F.octet_length(content),
        "document_id": content_id([*identity, *([url] if url else []), content], namespace="document"),
    })


def credential_leaks(df: DataFrame, columns: Sequence[str], marker: str = "apikey") -> DataFrame:
    """Rows whose URL or payload carries a credential marker; such rows are not landed."""
    leak: Column = F.lit(False)
    for c in columns:
        leak = leak | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(marker))
    return df.filter(leak)


def document_pins(landed: DataFrame, approved: DataFrame, key: str, digest: str = "content_sha256") -> DataFrame:
    """Landed documents against the approved list.

    Status per document: PINNED, HASH_MISMATCH, UNKNOWN (landed, not approved) or
    MISSING (approved, not landed). Works for approved lists of any size.
    """
    left = landed.select(F.col(key), F.col(digest).alias("landed_sha256"))
    right = approved.select(F.col(key), F.col(digest).alias("approved_sha256"))
    status = (
        F.when(F.col("approved_sha256").isNull(), F.lit("UNKNOWN"))
        .when(F.col("landed_sha256").isNull(), F.lit("MISSING"))
        .when(F.col("landed_sha256") == F.col("approved_sha256"), F.lit("PINNED"))
        .otherwise(F.lit("HASH_MISMATCH"))
    )
    return left.join(right, key, "full_outer").select(key, "landed_sha256", "approved_sha256", status.alias("status"))
