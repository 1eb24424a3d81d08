"""Readers of analysis, label, transcript and evaluation files, all with explicit schemas; and the writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<month:string,views:double>"
NOTE = "struct<key:string,vars:map<string,string>>"
SERIES = (
    "struct<name:string,topic:string,lang:string,project:string,article:string,months:int,completeness:double,totalLast12:double,avgMonthlyLast12:double,"
    "perMillionLast12:double,yoy:double,robustGrowth:double,relativeGrowth:double,editionGrowth:double,trendAnnual:double,r2:double,spikeShare:double,"
    f"peakMonth:{POINT},botShare:double,trust:struct<score:int,label:string,reasons:array<string>,notes:array<{NOTE}>>,"
    f"verdict:struct<label:string,basis:string,note:{NOTE}>,points:array<{POINT}>,levelShift:struct<month:string,`from`:double,`to`:double>,perMillionSeries:array<{POINT}>,spikes:array<string>>"
)
ANALYSIS = f"topics array<string>, langs array<string>, period struct<start:string,`end`:string>, normalized boolean, series array<{SERIES}>, ranking array<struct<name:string,score:double,why:string>>, excluded array<struct<topic:string,lang:string,reason:string,searchHits:array<string>>>, warnings array<string>, outDir string, files struct<chart:string,chartIndexed:string,csv:string,analysis:string>"
TRANSCRIPT = "type string, message string"
GRADING = "summary struct<pass_rate:double,passed:long,total:long>"
TURN = "duration_ms double, total_tokens double, tool_calls double"


def analyses(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """One row per analysis document, of files that hold one each or, with ``lines``, one per line; fields that older files lack are null."""
    return spark.read.schema(ANALYSIS).json(paths, multiLine=not lines)


def series_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("series").alias("s")).select("s.*")


def transcripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).json(paths)


def gradings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per grading file: file, pass_rate, passed, total."""
    return spark.read.schema(GRADING).json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "summary.*")


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per text file: file, text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def timings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per turn of each timing file, whether flat or with a list of turns."""
    raw = spark.read.schema(f"{TURN}, turns array<struct<duration_ms:double,total_tokens:double,tool_calls:double>>").json(paths, multiLine=True)
    one = F.array(F.struct("duration_ms", "total_tokens", "tool_calls"))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.coalesce("turns", one)).alias("turn", "t")).select("file", "turn", "t.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, template) of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "template"))


def label_problems(given: DataFrame, required: DataFrame) -> DataFrame:
    """(key, problem): required keys without a template, and templates whose placeholders differ."""
    holes = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), F.lit(1))))
    both = required.select("key", F.col("template").alias("_need")).join(given.select("key", "template"), "key", "left")
    problem = F.when(F.col("template").isNull() | (F.trim("template") == ""), "missing").when(holes(F.col("template")) != holes(F.col("_need")), "placeholders differ")
    return both.select("key", problem.alias("problem")).where("problem is not null")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One analysis document per line; null fields are left out."""
    documents.write.json(path)
