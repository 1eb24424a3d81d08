"""Documents there and back, readers on files that lack fields, exact decimals, redirect chains, global places, wording of warnings."""

import json
import random
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import functions as F

from trendweave.functions.numbers import fixed_text
from trendweave.operators import documents, resolve, series
from trendweave.sources import readers


def _plain(rows):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, ensure_ascii=False) for r in rows)


def test_tables_to_documents_and_back(spark, tmp_path):
    rng = random.Random(3)
    kind = documents._nested("series").elementType
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
    points = [("2024-01", 1.5), ("2024-02", None)]
    rows = []
    for run in "abcdefgh":
        for k in range(rng.randrange(4)):
            rows.append((run, k, f"n{k}", "t", rng.choice(["de", None]), "p", 'a "quoted" title', k, 0.5, 1e9, 2.0, None, 3.25, -4.0, None, 1.0, 2.0, 0.1, 0.0, ("2024-01", 9.0), None, (50, "medium", ["r1", "r2"], [("gaps", {"pct": "3"})]), ("flat", "b", None), points, None, [], ["2024-01"]))
    series_ = spark.createDataFrame(rows, f"run string, position int, {fields}").repartition(5)
    runs = spark.createDataFrame([(r, [r], ["de"], ("2024-01", "2024-02"), True, "out", None) for r in "abcdefgh"], "run string, topics array<string>, langs array<string>, period struct<start:string,end:string>, normalized boolean, outDir string, files struct<chart:string,chartIndexed:string,csv:string,analysis:string>")
    ranking = spark.createDataFrame([("a", 1, "x", 1.0, "w"), ("a", 0, "y", 2.0, None), ("zz", 0, "q", 0.0, "")], "run string, position int, name string, score double, why string")
    excluded = spark.createDataFrame([("b", 0, "t", "fr", "none", ["h", "i"])], "run string, position int, topic string, lang string, reason string, searchHits array<string>")
    warnings = spark.createDataFrame([("b", k, f"w{k}") for k in (2, 0, 1)], "run string, position int, text string")
    docs = documents.analysis_documents(runs, series_, ranking, excluded, warnings)
    readers.write_documents(docs, f"{tmp_path}/docs")
    read = spark.read.schema("run string, " + readers.ANALYSIS).json(f"{tmp_path}/docs")
    assert readers.analyses(spark, f"{tmp_path}/docs", lines=True).count() == 8
    back = documents.document_tables(read)
    assert _plain(back["series"].collect()) == _plain(series_.collect())
    assert _plain(back["runs"].collect()) == _plain(runs.collect())
    assert [(r["name"], r["score"]) for r in back["ranking"].orderBy("position").collect()] == [("y", 2.0), ("x", 1.0)]
    assert [r["text"] for r in back["warnings"].orderBy("position").collect()] == ["w0", "w1", "w2"]
    assert _plain(back["excluded"].collect()) == _plain(excluded.collect())


def test_readers_of_files(spark, tmp_path):
    old = {"topics": ["t"], "series": [{"name": "de", "lang": "de", "verdict": {"label": "flat"}, "points": [{"month": "2024-01", "views": 3}]}]}
    (tmp_path / "old.json").write_text(json.dumps(old, indent=2))
    (tmp_path / "new.json").write_text(json.dumps({**old, "warnings": ["w"], "later": 1, "ranking": [{"name": "de", "score": 4, "why": "x"}]}))
    docs = readers.analyses(spark, [f"{tmp_path}/old.json", f"{tmp_path}/new.json"])
    assert sorted((r["warnings"] or []) for r in docs.collect()) == [[], ["w"]]
    found = readers.series_of(docs).collect()
    assert [(r["lang"], r["verdict"]["label"], r["points"][0]["views"], r["yoy"]) for r in found] == [("de", "flat", 3.0, None)] * 2
    (tmp_path / "labels.json").write_text(json.dumps({"title": "{topics} in {langs}", "empty": " ", "odd": "{b}"}))
    given = readers.labels(spark, f"{tmp_path}/labels.json")
    need = spark.createDataFrame([("title", "{langs}: {topics}"), ("empty", "x"), ("odd", "{a}"), ("gone", "x")], "key string, template string")
    assert {(r["key"], r["problem"]) for r in readers.label_problems(given, need).collect()} == {("empty", "missing"), ("odd", "placeholders differ"), ("gone", "missing")}
    (tmp_path / "draft.md").write_text("one\ntwo")
    assert [r["text"] for r in readers.texts(spark, f"{tmp_path}/draft.md").collect()] == ["one\ntwo"]
    (tmp_path / "t.jsonl").write_text('{"type": "user", "message": {"content": "hi"}}\n{"type": "x"}\n')
    assert [(r["type"], r["message"]) for r in readers.transcripts(spark, f"{tmp_path}/t.jsonl").collect()] == [("user", '{"content": "hi"}'), ("x", None)]
    readers.write_lines(spark.createDataFrame([("a,b",)], "line string"), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").first()[0] == "a,b"


def test_decimals_by_the_exact_value(spark):
    rng = random.Random(1)
    numbers = [1.005, 1.125, -1.125, 0.0, 0.005, 8.575, 2.0**53 + 2, 2.0**60, 9.99e20, 0.5, -0.001, 5e-324] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 20.9) for _ in range(10000)] + [rng.randrange(10**7) / 8 for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", *[fixed_text(F.col("x"), k).alias(f"t{k}") for k in range(4)]).collect()
    for r in rows:
        for k in range(4):
            exact = str(Decimal(abs(r["x"])).quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP, Context(prec=60)))
            assert r[f"t{k}"] == ("-" if r["x"] < 0 else "") + exact
    assert rows[0]["t2"] == "1.00" and rows[1]["t2"] == "1.13"
    assert spark.createDataFrame([(None,)], "x double").select(fixed_text(F.col("x"))).first()[0] is None


def test_redirect_chains_and_cycles(spark):
    pairs = [("en", f"c{i}", f"c{i + 1}") for i in range(37)] + [("de", "c3", "Ende")] + [("en", "x", "y"), ("en", "y", "z"), ("en", "z", "x"), ("en", "in", "x"), ("en", "self", "self"), ("en", None, "a"), ("en", "b", None), ("en", "c0", "zz")]
    got = {(r["lang"], r["title"]): r["target"] for r in resolve.canonical(spark.createDataFrame(pairs, "lang string, title string, target string")).collect()}
    assert got == {("en", f"c{i}"): "c37" for i in range(37)} | {("de", "c3"): "Ende"}
    assert resolve.canonical(spark.createDataFrame([], "lang string, title string, target string")).count() == 0


def test_resolution_through_redirects(spark):
    hits = spark.createDataFrame([("en", "chess game", 1, "Chess game", ""), ("de", "chess game", 1, "Schachspiel", ""), ("en", "mercury", 1, "Merc", "")], "lang string, query string, rank int, title string, snippet string")
    links = spark.createDataFrame([("en", "Chess", "fr", "Échecs"), ("de", "Schach", "en", "Chess game")], "src_lang string, src_title string, dst_lang string, dst_title string")
    redirects = spark.createDataFrame([("en", "Chess game", "Chess (game)"), ("en", "Chess (game)", "Chess"), ("de", "Schachspiel", "Schach"), ("en", "Merc", "Mercury")], "lang string, title string, target string")
    props = spark.createDataFrame([("en", "Mercury", True)], "lang string, title string, is_disambiguation boolean")
    topics = spark.createDataFrame([("chess game",), ("mercury",)], "topic string")
    pins = spark.createDataFrame([("chess game", "pl", "Zuletzt", 2), ("chess game", "pl", "Anfang", 1)], "topic string, lang string, title string, ordinal int")
    got = {(r["topic"], r["lang"]): (r["article"], r["method"], r["confidence"], r["issue"]) for r in resolve.resolve(topics, ["en", "fr", "de", "pl"], hits, links, props, pins, redirects=redirects).collect()}
    assert got["chess game", "en"] == ("Chess", "langlink", "high", None) and got["chess game", "fr"] == ("Échecs", "langlink", "high", None)
    assert got["chess game", "de"] == ("Schachspiel", "search", "high", None) and got["chess game", "pl"] == ("Zuletzt", "explicit", "high", None)
    assert got["mercury", "en"][0] is None and got["mercury", "fr"][3] == "disambiguation"


def test_one_score_for_all_series(spark):
    rows = spark.range(20000).select(F.concat(F.lit("t"), (F.col("id") * 7919 % 20000)).alias("topic"), F.lit("x").alias("lang"), F.lit(5).cast("long").alias("score"), "id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.places(rows, ["id"])
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 6000
        assert got.where("place <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_series_names_by_what_was_asked(spark):
    asked = spark.createDataFrame([("a", "de"), ("a", "fr"), ("b", "de"), ("b", "fr")], "topic string, lang string")
    left = asked.where("topic = 'a' and lang = 'de'")
    assert [r["name"] for r in resolve.series_names(left, asked).collect()] == ["a (de)"] and [r["name"] for r in resolve.series_names(left).collect()] == ["de"]
    assert {r["name"] for r in resolve.series_names(asked.where("lang = 'de'")).collect()} == {"a", "b"}


def test_csv_lines_and_both_tables_of_the_report(spark, small):
    rows = spark.createDataFrame([("de", "2024-01", 5, "1.00"), ("de", "2024-02", 0, "")], "lang string, month string, views_user long, views_per_million string")
    assert [r["line"] for r in series.csv_lines(rows, F.lit('a "b"'), F.lit("c\\d")).collect()] == ['"a \\"b\\"",de,"c\\\\d",2024-01,5,1.00', '"a \\"b\\"",de,"c\\\\d",2024-02,0,']
    from trendweave.plans import catalog

    m = catalog._metrics(spark, small)
    absolute = {(r["topic"], r["lang"]): r for r in series.report_rows(m, False, "en").collect()}
    for r in m.collect():
        shown = absolute[r["topic"], r["lang"]]
        assert shown["total"] == f"{r['total_last12']:,}" and shown["trust"] == f"{r['trust_label']} {r['trust']}"
        assert shown["yoy"] == ("—" if r["yoy"] is None else f"{'+' if r['yoy'] > 0 else ''}{r['yoy']:,.1f}".removesuffix(".0") + "%")
