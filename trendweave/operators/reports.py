"""Parts of a report: texts held to their lengths with word of what was cut, and what stands in where nothing was written.

A report is one row; its lists have at most a handful of entries, so everything is expressions on arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes
from ..functions.numbers import local_number, signed_percent

# The greatest lengths and numbers of a report's texts, and the wording of what went over them.
LENGTHS = {"finding": 280, "title": 90, "verdict": 240, "caveat": 200}
MOST_FINDINGS, MOST_CAVEATS, ALL_CAVEATS, DRAFTED = 5, 3, 6, 5
CUT = '%s is %d chars (max %d) — shortened with "…"; rewrite it shorter'
TOO_MANY = "%d findings given (max 5) — kept the first 5"


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def _said(text: Column, most: int, what: Column) -> Column:
    """The problem of a text that is too long, else null."""
    return F.when(F.length(text) > most, F.format_string(CUT, what, F.length(text), F.lit(most)))


def listed(text: Column) -> Column:
    """Trimmed, non-empty parts of a text with bars; an empty list for null."""
    parts = F.filter(F.transform(F.split(text, r"\|"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def report_inputs(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title, verdict, findings, caveats as a report shows them, and problems: what was cut, in the order findings, title, verdict, caveats.

    reports: keys, title, verdict, findings, caveats; the last two with bars between their parts.  Nulls stay null, a missing
    list is empty.  Lengths are code points.
    """
    rows = reports.select(*keys, "title", "verdict", listed(F.col("findings")).alias("_f"), F.slice(listed(F.col("caveats")), 1, MOST_CAVEATS).alias("_c"))
    kept = F.slice("_f", 1, MOST_FINDINGS)
    number = lambda name: lambda i: F.concat(F.lit(f"{name} "), (i + 1).cast("string"))
    of_list = lambda array, name: F.transform(array, lambda t, i: _said(t, LENGTHS[name], number(name)(i)))
    problems = F.concat(
        F.array(F.when(F.size("_f") > MOST_FINDINGS, F.format_string(TOO_MANY, F.size("_f")))), of_list(kept, "finding"),
        F.array(_said(F.col("title"), LENGTHS["title"], F.lit("--title")), _said(F.col("verdict"), LENGTHS["verdict"], F.lit("--verdict"))), of_list(F.col("_c"), "caveat"),
    )
    return rows.select(
        *keys, *[_cut(F.col(c), LENGTHS[c]).alias(c) for c in ("title", "verdict")], F.transform(kept, lambda t: _cut(t, LENGTHS["finding"])).alias("findings"),
        F.transform("_c", lambda t: _cut(t, LENGTHS["caveat"])).alias("caveats"), F.array_compact(problems).alias("problems"),
    )


def report_content(documents: DataFrame, inputs: DataFrame, labels: dict[str, str], lang: str = "en") -> DataFrame:
    """run, verdict, findings, caveats and sources of each run's report in one language.

    documents: run and the fields of an analysis document; inputs: run, verdict, findings, caveats (``report_inputs``), of some
    runs.  Where no verdict or finding was written, the labels' drafts stand in: the first of the ranking if any series
    grows, and the first five series.  Caveats are those written, then excluded editions, series matched by search, and
    the standing ones, six at most.
    """
    given = inputs.select("run", F.col("verdict").alias("_verdict"), F.col("findings").alias("_findings"), F.col("caveats").alias("_caveats"))
    rows = documents.select("run", "series", "ranking", "excluded", "normalized").join(given, "run", "left")
    none = F.array().cast("array<string>")
    text = lambda key, **holes: notes.fill(F.lit(labels[key]), F.create_map(*[x for k, v in holes.items() for x in (F.lit(k), v)]) if holes else F.create_map(F.lit(""), F.lit("")), lang)
    label = lambda s: F.coalesce(*[F.when(s["verdict"]["label"] == k, F.lit(labels[f"verdict_{k.split('-')[0]}"])) for k in ("growing", "flat", "declining", "insufficient-data")])
    trust = lambda s: F.concat_ws(" ", F.coalesce(*[F.when(s["trust"]["label"] == k, F.lit(labels[f"trust_{k}"])) for k in ("high", "medium", "low")]), s["trust"]["score"].cast("string"))
    name = lambda s: F.concat_ws(" · ", s["lang"], s["article"])
    growing = F.exists("series", lambda s: s["verdict"]["label"] == "growing")
    drafted = F.when(growing & (F.size("ranking") > 0), text("draft_verdict_growing", name=F.get("ranking", F.lit(0))["name"])).otherwise(F.lit(labels["draft_verdict_none"]))
    finding = lambda s: text("draft_finding", name=name(s), verdict=label(s), rel=signed_percent(F.coalesce(s["relativeGrowth"], s["robustGrowth"]), lang), views=local_number(s["avgMonthlyLast12"], 0, lang), trust=trust(s))
    written = F.coalesce("_findings", none)
    langs = F.array_distinct(F.transform("excluded", lambda x: x["lang"]))
    searched = F.filter("series", lambda s: F.exists(F.array(s["match"]), lambda m: m != "high")) if "match" in _fields(documents) else F.filter("series", lambda _: F.lit(False))
    caveats = F.concat(
        F.coalesce("_caveats", none),
        F.array(F.when(F.size(langs) > 0, text("cav_excluded", list=F.array_join(langs, ", "))), F.when(F.size(searched) > 0, text("cav_search", list=F.array_join(F.transform(searched, name), ", "))), F.lit(labels["cav_curiosity"]), F.lit(labels["cav_human"])),
        F.when(F.col("normalized"), F.array(F.lit(labels["cav_relative"]), F.lit(labels["cav_perMillion"]))).otherwise(none),
        F.array(F.lit(labels["cav_basket"])),
    )
    return rows.select(
        "run", F.coalesce("_verdict", drafted).alias("verdict"), F.when(F.size(written) > 0, written).otherwise(F.transform(F.slice("series", 1, DRAFTED), finding)).alias("findings"),
        F.slice(F.array_compact(caveats), 1, ALL_CAVEATS).alias("caveats"), F.transform("series", lambda s: F.concat(s["project"], F.lit("/wiki/"), s["article"])).alias("sources"),
    )


def _fields(documents: DataFrame) -> list[str]:
    return documents.schema["series"].dataType.elementType.names
