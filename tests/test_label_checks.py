from pyspark.sql import functions as F

from trendweave.operators import label_checks
from trendweave.plans import catalog

VERDICTS = [("tr", "flat", "inside the band"), ("fr", "declining", "share"), ("id", "declining", "share of edition views")]
SAID = {
    "Turkish pages keep rising month by month.": ("tr", "growing"),
    "Two editions stand out (tr: readers are increasing)": ("tr", "growing"),
    "Турецька сторінка зросла вдвічі": ("tr", "growing"),
    "Турецьких читачів не зростає": None,
    "Demand in Turkish is not really increasing": None,
    "Growing in Turkish but declining in Indonesian": None,
    "Turkish and French are growing": None,
    "French is declining": None,
    "Turkish gains despite the platform-wide growing decline": None,
    "": None,
}


def test_contradictions(spark):
    docs = spark.createDataFrame(list(enumerate([*SAID, None])), "doc_id long, text string")
    verdicts = spark.createDataFrame(VERDICTS, "lang string, label string, basis string")
    got = {r["doc_id"]: (r["lang"], r["claim"]) for r in label_checks.label_contradictions(docs, verdicts, "doc_id").collect()}
    assert got == {i: w for i, w in enumerate(SAID.values()) if w}
    again = docs.unionByName(docs).unionByName(docs.where("doc_id = 0").withColumn("doc_id", docs["doc_id"] + 1))
    assert label_checks.label_contradictions(again, verdicts, "doc_id").count() == 2 * len(got) + 1
    twice = verdicts.unionByName(verdicts.where("lang = 'tr'"))
    assert label_checks.label_contradictions(docs, twice, "doc_id").isEmpty()
    assert label_checks.label_contradictions(docs, verdicts.where("false"), "doc_id").isEmpty()


def test_excuses_and_trust(spark):
    docs = spark.createDataFrame([(1, "It fell due to the platform. Fine."), (2, "Raw views fell due to the platform."), (3, "trust high (90%) | ok"), (4, "Спад через загальну втрату трафіку."), (5, None)], "doc_id long, text string")
    verdicts = spark.createDataFrame(VERDICTS, "lang string, label string, basis string")
    assert {r["doc_id"] for r in label_checks.edition_excuses(docs, verdicts, "doc_id").collect()} == {1, 4}
    assert label_checks.edition_excuses(docs, verdicts.where("lang = 'tr'"), "doc_id").isEmpty()
    assert [(r["doc_id"], r["said"]) for r in label_checks.trust_percentages(docs, "doc_id").collect()] == [(3, "trust high (90%")]


def test_language_problems(spark):
    rows = [
        ("Ринок растет", "uk", [], {"russian_words"}),
        ("Сторінки на wikipedia читають", "uk", [], {"latin_site_name"}),
        ("Meridian: verdict", "uk", ["Meridian"], {"tool_terms"}),
        ("пошук на французькому, keyword", "uk", [], {"speech_calque", "latin_words"}),
        ("доля переглядів", "uk", [], {"share_calque"}),
        ("Частка переглядів спадає, довіра висока (80).", "uk", [], set()),
        ("Markt growing", "de", [], {"tool_terms"}),
        ("The market is growing", "en", None, set()),
        (None, "uk", None, set()),
    ]
    d = spark.createDataFrame([r[:3] for r in rows], "text string, lang string, names array<string>")
    got = d.select(label_checks.language_problems(F.col("text"), F.col("lang"), F.col("names")).alias("p")).collect()
    assert [{p["kind"] for p in r["p"]} for r in got] == [r[3] for r in rows]


def test_stems_are_apart():
    stems = list(label_checks.STEM_CODES)
    assert len(stems) == sum(map(len, label_checks.LANGUAGE_STEMS.values()))
    assert not any(a != b and b.startswith(a) for a in stems for b in stems)


def test_languages_in_order(spark):
    said = spark.createDataFrame([("Polish, german and (fr) or Deutsch; en: none",), ("en-gb: türkish türkorean",), (None,)], "s string")
    got = [r[0] for r in said.select(label_checks.named_languages(F.col("s"))).collect()]
    assert got == [["de", "pl", "fr", "en"], ["tr", "ko", "en-gb"], None]


def test_narrow_rows_are_spread(spark, small):
    """A small file is one task's input, but the patterns run in many."""
    docs, _ = catalog._drafts(spark, small)
    assert docs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    for query in (catalog.label_contradictions, catalog.ukrainian_problems, catalog.trust_percentages, catalog.language_problems):
        assert "Repartition" in query(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_masked_text_is_computed_once(spark, small):
    plan = catalog.ukrainian_problems(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1
