"""Micro-batch merge: stored rows win, new keys are added, conflicts are kept aside.

Accepted rows live in a copy-on-write store: a batch reads and replaces only the buckets its keys fall
into, so files stay few after any number of batches and readers of an earlier version go on
undisturbed. A batch that runs again after a failure finds its rows stored and changes nothing; its conflicts go
to a folder of its own and overwrite themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factweave.operators.normalise import completed_sessions
from factweave.sources.store import Store


@dataclass(frozen=True)
class MergeTarget:
    """Where merged rows live and what identifies and compares them.

    `partition` deals rows to storage buckets and must depend on the key only; by default the whole key does.
    """

    root: str
    schema: StructType
    key: Sequence[str]
    compare: Sequence[str]
    partition: Column | None = None
    buckets: int = 64

    def path(self, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}"

    @property
    def store(self) -> Store:
        return Store(self.path("accepted"), self.schema, self.key, self.buckets, self.partition)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self.store.read(spark)

    def conflicts(self, spark: SparkSession) -> DataFrame:
        layout = StructType(list(self.schema.fields)).add("stream", "string").add("batch", "long")
        try:
            return spark.read.schema(layout).option("basePath", self.path("conflicts")).parquet(self.path("conflicts")).select(*self.schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # anything else must not look like an empty table
                raise
            return spark.createDataFrame([], self.schema)


def merge_batch(target: MergeTarget, batch: DataFrame, batch_id: int, stream: str) -> None:
    """Merge one micro-batch; running it again has no further effect."""
    _, refused = target.store.merge(batch, target.compare, strict=False)
    refused.write.mode("overwrite").option("compression", "zstd").parquet(f"{target.path('conflicts')}/stream={stream}/batch={batch_id}")


def incremental_merge(source: DataFrame, target: MergeTarget, checkpoint: str, stream: str, boundary: Column | None = None,
                      date: str = "reference_date") -> StreamingQuery:
    """Drain a streaming source into the target; rows on or after `boundary` wait for a later run of the source."""
    complete = completed_sessions(source, boundary, date) if boundary is not None else source
    return (
        complete.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(target, batch, batch_id, stream))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
