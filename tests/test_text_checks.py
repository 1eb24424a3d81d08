import pytest
from pyspark.sql import functions as F

from trendweave.functions import notes
from trendweave.operators import resolve, text_checks
from trendweave.plans import catalog

SAID = {
    "In 2025 views grew 36.8% to 12 345": [(36.8, True), (12345.0, False)],
    "between 78–82% of 5 topics": [(78.0, True), (82.0, True)],
    "2024-2026, −14.5 % and 3k views per 1M": [(-14.5, True), (3000.0, False)],
    "rose 2.3x, then 4 times": [(2.3, False), (4.0, False)],
    "": [],
}


def test_claims(spark):
    docs = spark.createDataFrame(list(enumerate([*SAID, None])), "doc_id long, text string")
    got = {}
    for r in text_checks.claims(docs, "doc_id").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["value"], r["percent"]))
    assert [got.get(i, []) for i in range(len(SAID) + 1)] == [*SAID.values(), []]


def test_verified_equals_all_pairs(spark):
    known = [(True, 36.8), (True, 10.0), (False, 12345.0), (False, 2.5), (False, 9.9), (False, 10.4)]
    stated = [(1, i, str(v), v, s, p, False) for i, (v, s, p) in enumerate([(37.0, False, True), (-37.0, True, True), (12500.0, False, False), (13000.0, False, False), (10.0, False, False), (2.4, False, False), (10.2, True, True), (0.0, False, False)])]
    c = spark.createDataFrame(stated, "doc_id long, pos int, raw string, value double, signed boolean, percent boolean, ratio boolean")
    k = spark.createDataFrame(known, "percent boolean, known double")
    limit = lambda x, p: abs(x) * 0.025 if abs(x) >= 100 else 0.55 if p or abs(x) >= 10 else max(0.05, abs(x) * 0.02)
    want = {(v, s, p) for _, i, _, v, s, p, _ in stated if any(q == p and abs(abs(v) - abs(x)) <= limit(x, p) and not (s and v and x and (v > 0) != (x > 0)) for q, x in known)}
    assert {(r["value"], r["signed"], r["percent"]) for r in text_checks.verified(c, k).collect()} == want


@pytest.mark.parametrize(
    ("text", "unverified", "ratios"),
    [
        ("it is 4 times as many", [], ["4×"]),  # a known number 4.0 does not allow a ratio
        ("spikes are 2.5x their neighbours, a shift 20×", [], []),
        ("2.52x and 2.509x", [], ["2.52×"]),
        ("grew 77% and 78 %, then 77%", ["77%", "78 %"], []),
        ("about 4.0 of 37%", [], []),
        ("years 2024, 2025-09 and 2025–26; 3 languages; per 1M views", None, None),
        ("у 18 разів, на 5-кратн", [], ["18×", "5×"]),
    ],
)
def test_claim_report(spark, text, unverified, ratios):
    docs = spark.createDataFrame([(1, text), (1, text), (1, "fell 36.8 %"), (2, None), (3, "")], "doc_id long, text string")
    known = spark.createDataFrame([(True, 36.8), (False, 4.0), (False, 2.4)], "percent boolean, known double")
    got = [(r["doc_id"], r["unverified"], r["ratios"]) for r in text_checks.claim_report(text_checks.claims(docs, "doc_id"), known, "doc_id").collect()]
    assert sorted(got) == sorted([(1, [], [])] + ([] if unverified is None else 2 * [(1, unverified, ratios)]))


def test_claims_of_documents(spark, small):
    """The number pattern on whole texts at once, by another engine and without the cuts."""
    import regex

    space = "[\\s\u00a0\u202f]"
    number = regex.compile(rf"(?i)(?<![\p{{L}}\d.,])([-+−–]?)(\d{{1,3}}(?:[ \u00a0\u202f,]\d{{3}})+|\d+)(?:[.,](\d+))?{space}?(%|pp\b|п\.{space}?п\.|k\b|тис\.?|m\b|млн)?")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.collect():
        t = regex.sub(rf"(?<![\d.])(?:19|20)\d\d{space}?[-–—−]{space}?(?:(?:19|20)\d\d|\d\d)(?:-\d\d)?(?![\d%])", " ", r["text"] or "")
        t = regex.sub(r"(?<![\d.,])(?:19|20)\d\d(?![\d%])", " ", t)
        t = regex.sub(rf"(?i)(\d){space}?[-–—]{space}?(\d+(?:[.,]\d+)?){space}?(%|pp\b|п\.{space}?п\.)", r"\1\3 \2\3", t)
        t = regex.sub(rf"(\d){space}?[-–—]{space}?(?=\d)", r"\1; ", t)
        for m in number.finditer(t):
            value = float(regex.sub("[ \u00a0\u202f,]", "", m[2]) + ("." + m[3] if m[3] else ""))
            if m[4] or m[3] or value > 12:
                want[r["doc_id"]] = want.get(r["doc_id"], 0) + 1
    got = {r["doc_id"]: r["count"] for r in text_checks.claims(docs, "doc_id").where("not ratio").groupBy("doc_id").count().collect()}
    ratios = {r["doc_id"] for r in text_checks.claims(docs, "doc_id").where("ratio").select("doc_id").collect()}
    assert {i: n for i, n in got.items() if i not in ratios} == {i: n for i, n in want.items() if i not in ratios} and len(got) > 10


def test_notes(spark):
    d = spark.createDataFrame([("noisy", {"rsq": "0.12"})], "key string, vars map<string,string>").select(F.struct("key", "vars").alias("n"))
    en, uk = d.select(notes.render(d["n"]), notes.render(d["n"], "uk")).first()
    assert "R²=0.12" in en and "R²=0,12" in uk


@pytest.mark.parametrize(("topic", "title", "same"), [("Mercury", "Mercury (planet)", True), ("Solar Kite", "Solar (unit)", False), ("Rivers of Café", "The River Cafe", True)])
def test_title_matches(spark, topic, title, same):
    d = spark.createDataFrame([(topic, title)], "a string, b string")
    assert d.select(resolve.title_matches(F.col("a"), F.col("b"))).first()[0] is same


def test_resolution(spark):
    hits = spark.createDataFrame([("en", "chess", 1, "Chess", ""), ("de", "chess", 1, "Schach", ""), ("uk", "chess", 1, "Гра", "")], "lang string, query string, rank int, title string, snippet string")
    links = spark.createDataFrame([("en", "Chess", "fr", "Échecs"), ("de", "Schach", "en", "Chess")], "src_lang string, src_title string, dst_lang string, dst_title string")
    props = spark.createDataFrame([], "lang string, title string, is_disambiguation boolean")
    topics = spark.createDataFrame([("chess",)], "topic string")
    pins = spark.createDataFrame([("chess", "pl", "Szachy")], "topic string, lang string, title string")
    got = {r["lang"]: (r["article"], r["method"], r["confidence"]) for r in resolve.resolve(topics, ["en", "fr", "de", "uk", "pl", "it"], hits, links, props, pins).collect()}
    assert got == {"en": ("Chess", "langlink", "high"), "fr": ("Échecs", "langlink", "high"), "de": ("Schach", "search", "high"), "uk": ("Гра", "search", "low"), "pl": ("Szachy", "explicit", "high"), "it": (None, "none", "low")}


def test_lists_codes_and_pins(spark):
    d = spark.createDataFrame([(" de, fr ,,de", "pt-br", " de = Haus = Hof "), ("", "English", "no sign"), (None, "simple", None)], "a string, b string, c string")
    rows = d.select(text_checks.comma_list(F.col("a")).alias("a"), text_checks.is_lang_code(F.col("b")).alias("b"), text_checks.pinned(F.col("c")).alias("c")).collect()
    assert [r["a"] for r in rows] == [["de", "fr"], [], None] and [r["b"] for r in rows] == [True, False, True]
    assert tuple(rows[0]["c"]) == ("de", "Haus = Hof") and tuple(rows[1]["c"]) == ("", "")


def test_constants(spark):
    rows = [(10.4, False, True), (10.6, False, True), (2.5, True, False), (-2.5, True, False), (-2.5, False, False), (305.0, False, False), (308.0, False, False), (100.0, False, True)]
    d = spark.createDataFrame(rows, "v double, s boolean, p boolean")
    assert [r[0] for r in d.select(text_checks.allowed(F.col("v"), F.col("s"), F.col("p"))).collect()] == [True, False, True, False, True, True, False, False]


def test_snippets_without_tags(spark):
    from trendweave.sources import activity

    hits = spark.createDataFrame([("en", "q", 1, "T", 'a <b class="x">bold</b> word'), ("en", "q", 6, "U", "late"), ("en", "q", 2, "V", None)], "lang string, query string, rank int, title string, snippet string")
    assert sorted((r["title"], r["snippet"]) for r in activity.search_hits(hits).collect()) == [("T", "a bold word"), ("V", None)]


def test_each_pattern_runs_once(spark, small):
    """No filter on the parts of a number repeats the patterns that found them."""
    plan = catalog.statement_claims(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 0 and plan.count("regexp_replace(") == 6
