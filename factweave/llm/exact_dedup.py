"""Exact dedup as a stateful stream: keyed state on disk, no expiry, whole texts compared on hits.

The stream keeps one state row per digest of the normalised text: the row that stays
(smallest id, then place in its file) and the number of rows seen. State lives in RocksDB
on the executors and in the checkpoint folder, so it may outgrow memory and survives lost
executors; a restarted stream goes on from it. A digest is only a hint: every row that
hits a known digest is compared by the whole bytes of its text (grouping by the text
itself), and rows whose text differs from that of the digest's first row form groups of
their own.

Defined results: a null text is an empty text; a null id counts as larger than all ids;
rows repeated with the same id are ordered by file and row number, and one stays; an
empty table gives an empty result. Columns other than the id and the text are not read,
so their names may clash with the output's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.text import read_table, single_blanks
from factweave.session import new_folder, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Every store is closed when its task ends: one run leaves no open store on an executor, each of which holds megabytes of disk.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class DedupStream:
    """A drained or restartable deduplication of one table of documents.

    `path` is a Parquet file or folder; `digest` maps the normalised text to the state
    key; a micro-batch takes at most `batch_bytes` of files.
    """

    path: str
    checkpoint: str
    doc_id: str = "doc_id"
    text: str = "text"
    digest: Digest = sha256
    batch_bytes: int = 16 << 30

    def _keyed(self, docs: DataFrame) -> DataFrame:
        """Digest, normalised text, and the row's locator: id (nulls last), file and row number."""
        body = single_blanks(F.coalesce(F.col(self.text), F.lit("")))
        locator = F.struct(
            F.col(self.doc_id).isNull().alias("no_id"), F.col(self.doc_id).alias("id"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return docs.select(body.alias("body"), locator.alias("at")).withColumn("digest", self.digest(F.col("body")))

    def update(self, spark: SparkSession) -> None:
        """Bring the state up to all files of the path, and stop; files already seen are not read again."""
        held = {k: spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        try:
            source = (
                spark.readStream.schema(spark.read.parquet(self.path).schema).option("maxBytesPerTrigger", str(self.batch_bytes))
                .parquet(f"{self.path[:-1]}[{self.path[-1]}]")  # a pattern: the source takes a single file by no other way
            )
            state = self._keyed(source).groupBy("digest").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint) \
                .trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in held.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def state(self, spark: SparkSession) -> DataFrame:
        """The keyed state as a table: digest, locator of the row that stays, rows seen."""
        raw = spark.read.format("statestore").load(self.checkpoint)
        first, count = raw.schema["value"].dataType.names[:2]
        return raw.select(F.col("key.digest").alias("digest"), F.col(f"value.{first}").alias("first"), F.col(f"value.{count}").alias("n"))

    def groups(self, spark: SparkSession) -> DataFrame:
        """One row per input row: digest, `at`, the locator `keep` of the row that stays, and group_size."""
        state = stage(self.state(spark), "dedup-state")
        seen = state.filter("n > 1").select("digest", F.lit(True).alias("hit"))
        # One pass normalises and hashes all texts. Only rows that hit a digest seen more than once keep theirs.
        rows = stage(
            self._keyed(spark.read.parquet(self.path)).join(seen, "digest", "left").select("digest", "at", F.when(F.col("hit"), F.col("body")).alias("body")), "dedup-rows")
        texts = rows.filter("body IS NOT NULL").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
        # Digests that more than one text shares; as a rule there is none.
        clash = stage(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest"), "dedup-collisions")
        plain, none = rows.select("digest", "at"), clash.isEmpty()
        sound = (plain if none else plain.join(clash, "digest", "left_anti")).join(state, "digest").select("digest", "at", F.col("first").alias("keep"), F.col("n").alias("group_size"))
        if none:
            return sound
        shared = rows.join(clash, "digest")
        each = shared.groupBy("digest", "body").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        return sound.unionByName(shared.join(each, ["digest", "body"]).select("digest", "at", "keep", "group_size"))

    def kept_rows(self, spark: SparkSession) -> DataFrame:
        """The documents that stay, with all their columns."""
        at = self.groups(spark).filter(F.col("at") == F.col("keep")).select(F.col("at.file").alias("_file"), F.col("at.row").alias("_row"))
        docs = spark.read.parquet(self.path)
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return placed.join(at, ["_file", "_row"], "left_semi").select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = DedupStream(f"{sf_dir.rstrip('/')}/documents.parquet", new_folder(spark, "exact-dedup"))
    dedup.update(spark)
    return dedup.groups(spark).select(
        F.col("at.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
