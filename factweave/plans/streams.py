"""Query: a replayed and partly conflicting stream merged into one table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factweave.plans.registry import query
from factweave.session import shared_dir
from factweave.streaming.incremental import MergeTarget, incremental_merge

BOUNDARY = "2001-06-01"


@query("incremental_merge", f"""
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS reference_date, o_totalprice AS value, o_orderpriority = '1-URGENT' AS conflicted
FROM orders WHERE o_orderdate < '{BOUNDARY}'
""")
def _(t):
    spark = t.spark
    root = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    source = spark.readStream.schema(t.orders.schema).parquet(f"{t.root}/orders.parquet*")
    columns = ["o_orderkey", "o_orderdate", "o_totalprice"]
    shape = lambda df, value: df.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("reference_date"), value.alias("value"))
    rows = shape(source, F.col("o_totalprice"))
    target = MergeTarget(root, shape(t.orders.select(*columns), F.col("o_totalprice")).schema, ["order_id", "reference_date"], ["value"], F.year("reference_date").cast("string"))
    boundary = F.lit(BOUNDARY).cast("date")
    # The same orders arrive three times: first, replayed, and with urgent orders revised.
    revised = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    for name, df in (("first", rows), ("replay", rows), ("revised", shape(source, revised))):
        incremental_merge(df, target, f"{root}/checkpoint-{name}", name, boundary).awaitTermination()
    refused = target.conflicts(spark).select("order_id", "reference_date", F.lit(True).alias("conflicted"))
    return target.accepted(spark).join(refused, ["order_id", "reference_date"], "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(False)))
