"""Monthly activity: the schema of the source tables, and the driver's orders read as such a source.

Orders stand in for page views: a market segment is a topic, a nation an edition ("lang"), the month of an
order a month, and its whole price the views.  Orders in process ('P') are the automated traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import month_index

VIEWS = T.StructType([T.StructField("topic", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("month", T.IntegerType()), T.StructField("views", T.LongType())])
WIRE = T.StructType([T.StructField(c, T.StringType()) for c in ("project", "article", "granularity", "timestamp", "access", "agent")] + [T.StructField("views", T.LongType())])
SEARCH_HITS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("query", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("snippet", T.StringType())])
LANGLINKS = T.StructType([T.StructField(c, T.StringType()) for c in ("src_lang", "src_title", "dst_lang", "dst_title")])
PAGE_PROPS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("title", T.StringType()), T.StructField("is_disambiguation", T.BooleanType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pageviews(wire: DataFrame, project: str, agent: str = "user", access: str = "all-access", granularity: str = "monthly", articles: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of one project, agent, access and granularity as (article, month, views); the filters reach the scan.

    articles: titles with spaces, all if None; first, last: months as "YYYY-MM", inclusive.  An article without rows
    does not appear.
    """
    month = F.substring("timestamp", 1, 4).cast("int") * 12 + F.substring("timestamp", 5, 2).cast("int") - 1
    chosen = (F.col("project") == project) & (F.col("agent") == agent) & (F.col("access") == access) & (F.col("granularity") == granularity)
    if articles is not None:
        chosen &= F.col("article").isin([a.replace(" ", "_") for a in articles])
    if first is not None:
        chosen &= F.col("timestamp") >= first.replace("-", "")
    if last is not None:
        chosen &= F.col("timestamp") < last.replace("-", "") + "~"
    return wire.where(chosen).select(F.regexp_replace("article", "_", " ").alias("article"), month.cast("int").alias("month"), "views")


def edition_totals(wire: DataFrame, agent: str = "user", granularity: str = "monthly") -> DataFrame:
    """(lang, month, views) of whole editions: the rows of ``wire`` without an article; several rows of a month are summed."""
    rows = wire.where(F.col("article").isNull() & (F.col("agent") == agent) & (F.col("granularity") == granularity))
    month = F.substring("timestamp", 1, 4).cast("int") * 12 + F.substring("timestamp", 5, 2).cast("int") - 1
    lang = F.regexp_extract("project", r"^([^.]+)\.", 1)
    return rows.groupBy(lang.alias("lang"), month.cast("int").alias("month")).agg(F.sum("views").alias("views"))


def search_hits(hits: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` hits of each query, snippets without tags."""
    return hits.where(F.col("rank") <= limit).withColumn("snippet", F.regexp_replace("snippet", "<[^>]+>", ""))


def order_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, lang, month, automated, views, records): one row per month of a series with activity."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", month_index(F.col("o_orderdate")).alias("month"), (F.col("o_orderstatus") == "P").alias("automated"), F.floor("o_totalprice").alias("v"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("topic"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("lang"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("topic", "lang", "month", "automated").agg(F.sum("v").cast("long").alias("views"))


def series_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user, automated, editions) views of the stand-in source."""
    views = order_views(spark, sf_dir)
    user = views.where(~F.col("automated")).select("topic", "lang", "month", "views")
    automated = views.where("automated").select("topic", "lang", "month", "views")
    editions = user.groupBy("lang", "month").agg(F.sum("views").alias("views"))
    return user, automated, editions


def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's orders in the shape of wire rows: a row per order, and a row per edition and month without an article."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMMdd00").alias("timestamp"), F.when(F.col("o_orderstatus") == "P", "automated").otherwise("user").alias("agent"), F.floor("o_totalprice").alias("views"), F.concat(F.lit("Order_"), F.col("o_orderpriority")).alias("article"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("x"), F.col("c_nationkey").cast("string"), F.lit(".wikipedia")).alias("project"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("project", "article", F.lit("monthly").alias("granularity"), "timestamp", F.lit("all-access").alias("access"), "agent", "views")
    totals = rows.groupBy("project", "granularity", F.concat(F.substring("timestamp", 1, 6), F.lit("0100")).alias("timestamp"), "access", "agent").agg(F.sum("views").cast("long").alias("views"))
    return rows.unionByName(totals.withColumn("article", F.lit(None).cast("string")))
