"""Metrics that follow a stream: each micro-batch adds to a table of months, and only the series it touches are computed anew.

The months are a log of counts by batch and bucket of the key.  A batch that runs again replaces its own part and recomputes
from the batches up to it, so results do not depend on how often or where it ran.  Of the buckets of the log a batch
reads those of its own series only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import month_index

BUCKETS = 64


def upsert(batch: DataFrame, batch_id: int, keys: list[str], folder: str, compute: Callable[[DataFrame], DataFrame], ts: str = "ts") -> None:
    """Adds the batch to ``folder``/months and writes the metrics of its series to ``folder``/metrics.

    batch: the keys and a timestamp, a row per view; rows without a timestamp count for nothing.  compute: from (keys,
    month, views) to a row per series that has the keys.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = batch.where(F.col(ts).isNotNull()).groupBy(*keys, month_index(F.col(ts)).alias("month")).agg(F.count("*").alias("views")).withColumn("bucket", bucket)
    place = f"{folder}/months/batch={batch_id}"
    counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    touched = [r["bucket"] for r in spark.read.schema(counts.schema).parquet(place).select("bucket").distinct().collect()]  # at most BUCKETS
    own = spark.read.schema(counts.schema).parquet(place).select(*keys).distinct()
    log = months(spark, folder, counts).where((F.col("batch") <= batch_id) & F.col("bucket").isin(touched))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    rows = log.alias("l").join(own.alias("o"), same, "left_semi").groupBy(*keys, "month").agg(F.sum("views").alias("views"))
    compute(rows).write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch_id}")


def months(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The log of counts, with columns batch and bucket; like: a frame with its other columns."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields if f.name != "bucket")
    return spark.read.schema(f"{kinds}, batch bigint, bucket int").parquet(f"{folder}/months")


def current(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows in ``folder``/metrics the newest of each series."""
    values = [c for c in metrics.columns if c not in (*keys, "batch")]
    return metrics.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_m")).select(*keys, "_m.*")


def follow(events: DataFrame, keys: list[str], folder: str, compute: Callable[[DataFrame], DataFrame], ts: str = "ts") -> StreamingQuery:
    """Runs ``upsert`` on all that the stream offers now; the next call goes on from there."""
    writer = events.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, i: upsert(batch, i, keys, folder, compute, ts)).start()
