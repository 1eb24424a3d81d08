"""Analysis documents: all tables of a run as one nested, ordered row, and back.

A run's series, ranking, exclusions and warnings are brought together by one shuffle on the run; a document is as large as
its series (135 months each at most).  Tables read from documents carry the place of each row, so the way there and back
gives the same tables, whatever order files and rows are read in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import ANALYSIS

PARTS = ["series", "ranking", "excluded", "warnings"]


def series_fields(metrics: DataFrame, name: Column, keep: list[str], project: Column | None = None, article: Column | None = None) -> DataFrame:
    """Metrics under the field names of a document's series, after the columns ``keep``."""
    c = F.col
    project = F.concat(F.col("lang"), F.lit(".wikipedia")) if project is None else project
    point = lambda name_, views: F.transform(name_, lambda p: F.struct(p["month"].alias("month"), p[views].cast("double").alias("views")))
    no_note = F.lit(None).cast("struct<key:string,vars:map<string,string>>")
    return metrics.select(
        *keep, name.alias("name"), c("topic"), c("lang"), project.alias("project"), (c("topic") if article is None else article).alias("article"), c("months"), c("completeness"), c("total_last12").cast("double").alias("totalLast12"), c("avg_last12").cast("double").alias("avgMonthlyLast12"),
        c("per_million").alias("perMillionLast12"), c("yoy"), c("robust_growth").alias("robustGrowth"), c("relative_growth").alias("relativeGrowth"), c("edition_growth").alias("editionGrowth"), c("trend_annual").alias("trendAnnual"), c("r2"), c("spike_share").alias("spikeShare"),
        F.struct(c("peak_month").alias("month"), c("peak_views").cast("double").alias("views")).alias("peakMonth"), c("bot_share").alias("botShare"),
        F.struct(c("trust").alias("score"), c("trust_label").alias("label"), c("reasons"), F.transform("note_keys", lambda k: F.struct(k.alias("key"), F.lit(None).cast("map<string,string>").alias("vars"))).alias("notes")).alias("trust"),
        F.struct(c("verdict").alias("label"), c("basis"), no_note.alias("note")).alias("verdict"), point("points", "views").alias("points"),
        F.when(c("level_shift").isNotNull(), F.struct(c("level_shift.month"), c("level_shift.from").cast("double").alias("from"), c("level_shift.to").cast("double").alias("to"))).alias("levelShift"),
        point("per_million_points", "per_million").alias("perMillionSeries"), c("spikes"),
    )


def _nested(part: str) -> T.ArrayType:
    return next(f.dataType for f in T._parse_datatype_string(ANALYSIS).fields if f.name == part)


def _gathered(rows: DataFrame, part: str) -> DataFrame:
    """run and the ordered array of its rows."""
    kind = _nested(part)
    held = F.col("text") if part == "warnings" else F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
    ordered = F.array_sort(F.collect_list(F.struct("position", held.alias("_row"))), lambda a, b: (a["position"] - b["position"]).cast("int"))
    return rows.groupBy("run").agg(F.transform(ordered, lambda x: x["_row"]).cast(kind).alias(part))


def analysis_documents(runs: DataFrame, series: DataFrame, ranking: DataFrame | None = None, excluded: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row per run under the document's schema, after the column ``run``.

    runs: run (unique) and any of topics, langs, period, normalized, outDir, files; the other tables: run, position
    (unique in the run) and the fields of the document (warnings: text).  A run without rows in a table has an empty list there; fields that a
    table lacks are null; rows of a run that ``runs`` does not have are left out.
    """
    tables = {"series": series, "ranking": ranking, "excluded": excluded, "warnings": warnings}
    gathered = [_gathered(t, part) for part, t in tables.items() if t is not None]
    rows = reduce(lambda a, b: a.join(b, "run", "left"), gathered, runs.select("run", *[c for c in runs.columns if c != "run" and c not in PARTS]))
    columns = []
    for f in T._parse_datatype_string(ANALYSIS).fields:
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        columns.append((F.coalesce(value, F.array().cast(f.dataType)) if f.name in PARTS else value).alias(f.name))
    return rows.select("run", *columns)


def document_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """runs, series, ranking, excluded and warnings of documents with a column ``run``; lists that a file lacks have no rows."""
    out = {"runs": documents.drop(*PARTS)}
    for part in PARTS:
        rows = documents.select("run", F.posexplode(part).alias("position", "_row"))
        out[part] = rows.select("run", "position", F.col("_row").alias("text")) if part == "warnings" else rows.select("run", "position", "_row.*")
    return out
