"""Session settings the operators rely on, and shared-storage staging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed lookups (one evidence id referenced by a third of all edges) are split
# at run time; partition counts and small build sides are decided at run time.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Plans are built from many column expressions; capturing a call site for each
    # one costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def recommended_builder(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a folder inside the warehouse, if that can be shared: on a cluster a
    path without a scheme, or of the `file` scheme, is a folder of the driver's machine and is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_staging"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to shared storage and read it back.

    For results that several later steps read: they are computed once, the steps keep
    column pruning and filter pushdown, and nothing is recomputed when an executor is
    lost, unlike a cache. The folder is the cluster's to expire.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_tasks(spark: SparkSession) -> int:
    """Tasks for rows that cost much more than their bytes tell: some for every core, and not fewer than the shuffle partitions.

    A repartition into a number of its own is kept by adaptive execution, which would else join small partitions.
    """
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
