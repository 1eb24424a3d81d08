"""Order over whole tables: numbers along a global order, and the nearest points of each value.

Rows are dealt out by ranges of the order, so equal ranks of a coarse score or a crowded stretch of numbers are split
among tasks; what a range must know of the others is one row per range (and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable

IN_PARTITION = (1 << 33) - 1


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt out evenly among tasks: narrow rows lie in few files, however much work each of them makes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, in an order that ends in a column that tells rows apart.

    The rows are computed once; ranges are cut from the written rows, counted, and numbered from the sum of those before.
    """
    kept = durable(rows)
    spread = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    held = durable(spread.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("_at")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def nearest(asked: DataFrame, points: DataFrame, by: list[str], on: str) -> DataFrame:
    """Each row of ``asked`` with the nearest point of its key at or below (``below``) and at or above (``above``) its value.

    points: the keys and ``on``.  Both tables are put in one order of key and value; every range looks within itself, and
    beyond its ends at the outermost points of the ranges before and after it.  Rows with a null key or value find none.
    """
    own = [c for c in asked.columns if c not in (*by, on)]
    row = F.struct(*own) if own else F.struct(F.lit(1).alias("_"))
    queries = asked.select(*by, F.col(on).alias("_v"), row.alias("_row"), F.lit(True).alias("_asked"))
    marks = points.select(*by, F.col(on).alias("_v")).distinct().withColumns({"_row": F.lit(None).cast(queries.schema["_row"].dataType), "_asked": F.lit(False)})
    spread = queries.unionByName(marks).repartitionByRange(*by, "_v").select("*", F.spark_partition_id().alias("_range"))
    held = durable(spread)
    point = F.when(~F.col("_asked"), F.col("_v"))
    ends = held.groupBy("_range", *by).agg(F.min(point).alias("_least"), F.max(point).alias("_most"))
    ranges = Window.partitionBy(*by).orderBy("_range")
    ends = ends.select("_range", *by, F.max("_most").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    within = Window.partitionBy("_range", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = held.withColumns({"_below": F.max(point).over(within.orderBy("_v", "_asked")), "_above": F.min(point).over(within.orderBy(F.desc("_v"), "_asked"))}).where("_asked")
    out = seen.join(ends, ["_range", *by], "left")
    return out.select(*by, F.col("_v").alias(on), *[F.col(f"_row.{c}").alias(c) for c in own], F.coalesce("_below", "_before").alias("below"), F.coalesce("_above", "_after").alias("above"))
