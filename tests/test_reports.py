"""Texts of reports: what is cut and what is told of it, drafts where nothing was written, short numbers."""

from pyspark.sql import functions as F

from trendweave.functions.numbers import compact_number
from trendweave.operators import documents, reports

LABELS = {
    "verdict_growing": "up", "verdict_flat": "level", "verdict_declining": "down", "verdict_insufficient": "unclear", "trust_high": "sure", "trust_medium": "fair", "trust_low": "weak", "draft_verdict_growing": "Begin with {name}.", "draft_verdict_none": "Nothing grows.",
    "draft_finding": "{name}: {verdict} ({rel}), {views} a month, {trust}", "cav_excluded": "left out: {list}", "cav_search": "by search: {list}", "cav_curiosity": "c1", "cav_human": "c2", "cav_relative": "c3", "cav_perMillion": "c4", "cav_basket": "c5",
}


def test_what_is_cut_is_told(spark):
    rows = [(1, "t" * 91, "v" * 240, "|".join([" a ", "", "b" * 281, "c", "d", "e", "f"]), "x|y|z|w"), (2, None, None, None, None), (3, "ok", "w" * 241, " | ", "k" * 300)]
    got = {r["id"]: r for r in reports.report_inputs(spark.createDataFrame(rows, "id int, title string, verdict string, findings string, caveats string"), ["id"]).collect()}
    assert got[1]["title"] == "t" * 89 + "…" and got[1]["verdict"] == "v" * 240 and got[1]["findings"] == ["a", "b" * 279 + "…", "c", "d", "e"] and got[1]["caveats"] == ["x", "y", "z"]
    assert got[1]["problems"] == ["6 findings given (max 5) — kept the first 5", 'finding 2 is 281 chars (max 280) — shortened with "…"; rewrite it shorter', '--title is 91 chars (max 90) — shortened with "…"; rewrite it shorter']
    assert (got[2]["title"], got[2]["findings"], got[2]["problems"]) == (None, [], [])
    assert [p.split(" is ")[0] for p in got[3]["problems"]] == ["--verdict", "caveat 1"] and got[3]["findings"] == []


def test_drafts_stand_in(spark):
    kind = lambda field: documents._nested("series").elementType[field].dataType
    rows = [("a", i, lang, label, rel, avg) for i, (lang, label, rel, avg) in enumerate([("de", "growing", 12.34, 27791.0), ("fr", "flat", None, 5.0)])] + [("b", 0, "pl", "insufficient-data", -3.0, 1.0)]
    series = spark.createDataFrame(rows, "run string, position int, lang string, label string, relativeGrowth double, avgMonthlyLast12 double").select("*", F.from_json(F.to_json(F.struct("label")), kind("verdict")).alias("verdict"), F.from_json(F.lit('{"score": 80, "label": "high"}'), kind("trust")).alias("trust"), F.lit("Art").alias("article"), F.concat("lang", F.lit(".org")).alias("project"))
    runs = spark.createDataFrame([("a", True), ("b", False)], "run string, normalized boolean")
    ranking = spark.createDataFrame([("a", 0, "de", 3.0, "w")], "run string, position int, name string, score double, why string")
    excluded = spark.createDataFrame([("b", 0, "t", "it", "r"), ("b", 1, "t", "it", "r")], "run string, position int, topic string, lang string, reason string")
    docs = documents.analysis_documents(runs, series, ranking, excluded)
    inputs = spark.createDataFrame([("b", "Own words.", ["f"], ["mine"])], "run string, verdict string, findings array<string>, caveats array<string>")
    got = {r["run"]: r for r in reports.report_content(docs, inputs, LABELS).collect()}
    assert got["a"]["verdict"] == "Begin with de." and got["a"]["findings"] == ["de · Art: up (+12.3%), 27,791 a month, sure 80", "fr · Art: level (—), 5 a month, sure 80"]
    assert got["a"]["caveats"] == ["c1", "c2", "c3", "c4", "c5"] and got["a"]["sources"] == ["de.org/wiki/Art", "fr.org/wiki/Art"]
    assert (got["b"]["verdict"], got["b"]["findings"], got["b"]["caveats"]) == ("Own words.", ["f"], ["mine", "left out: it", "c1", "c2", "c5"])


def test_short_numbers(spark):
    cases = {0.0: "0", 12.34: "12.3", 999.94: "999.9", 999.95: "1K", 1234.0: "1.2K", 999949.0: "999.9K", 999950.0: "1M", 27_800_000.0: "27.8M", 3.25e9: "3.3B", 4e12: "4T", -1500.0: "-1.5K"}
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select("x", compact_number(F.col("x")).alias("en"), compact_number(F.col("x"), "uk").alias("uk")).collect()
    assert {r["x"]: r["en"] for r in rows} == cases and {r["uk"] for r in rows} >= {"1,2 тис.", "27,8 млн", "4 трлн"}
