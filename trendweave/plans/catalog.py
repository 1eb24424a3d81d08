"""The registered queries of the engine and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notes
from ..functions.numbers import compact_number, median, month_text, pct_change, round_half_up, tail
from ..operators import charts, documents, drafts, evaluation, label_checks, periods, reports, resolve, series, text_checks, transcripts
from ..operators.ordering import spread
from ..sources import activity
from ..sources.durable import shared_folder
from ..streaming import incremental, monthly

LAST = 2001 * 12 + 6  # requested window of the stand-in: 1995-01 .. 2001-07
START = 1995 * 12


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_metrics(*activity.series_tables(spark, sf_dir), start=START, end=LAST)


def series_metrics(spark, sf_dir):
    flat = ["months", "completeness", "total_last12", "avg_last12", "per_million", "yoy", "robust_growth", "relative_growth", "edition_growth", "trend_annual", "r2", "spike_share", "peak_month", "peak_views", "bot_share", "trust", "trust_label", "verdict"]
    return _metrics(spark, sf_dir).select("topic", "lang", *flat)


def dense_points(spark, sf_dir):
    return series.points(series.densify(activity.series_tables(spark, sf_dir)[0], end=LAST))


def spikes(spark, sf_dir):
    d = series.densify(activity.series_tables(spark, sf_dir)[0], end=LAST)
    d = d.withColumn("f", series.spike_flags(F.col("views")))
    return d.select("topic", "lang", F.explode(F.arrays_zip("months", "views", "f")).alias("p")).where("p.f").select("topic", "lang", month_text(F.col("p.months")).alias("month"), F.col("p.views").alias("views"))


def level_shifts(spark, sf_dir):
    """Cumulative views stand in for a growing level, so that shifts occur."""
    d = series.densify(activity.series_tables(spark, sf_dir)[0], end=LAST)
    ramp = F.transform("views", lambda x, i: F.when(i < 50, F.floor(x / 100000)).otherwise(x).cast("double"))
    d = d.withColumn("views", ramp).withColumn("s", series.level_shift(F.col("months"), F.col("views")))
    return d.where("s is not null").select("topic", "lang", F.col("s.month").alias("month"), F.col("s.from").alias("level_from"), F.col("s.to").alias("level_to"))


def edition_growth(spark, sf_dir):
    _, _, editions = activity.series_tables(spark, sf_dir)
    g = editions.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", F.col("views").cast("double").alias("v")))), lambda e: e["v"]).alias("v"))
    return g.select("lang", round_half_up(series.yearly(F.col("v"), lambda a, b: pct_change(median(a), median(b)))).alias("edition_growth"), median(tail(F.col("v"), 12)).alias("median_last12"))


def ranked_series(spark, sf_dir):
    """All series in one order, with the reason for the score."""
    return series.places(series.ranking(_metrics(spark, sf_dir)))


def series_reasons(spark, sf_dir):
    """The reasons of the trust score and the basis of the verdict, as texts."""
    return _metrics(spark, sf_dir).select("topic", "lang", F.concat_ws(" | ", "reasons").alias("reasons"), "basis")


def summary_rows(spark, sf_dir):
    return series.summary_rows(_metrics(spark, sf_dir))


def report_rows(spark, sf_dir):
    return series.report_rows(_metrics(spark, sf_dir), True, "uk")


def indexed_points(spark, sf_dir):
    d = series.rebase(series.densify(activity.series_tables(spark, sf_dir)[0], end=LAST))
    p = d.select("topic", "lang", F.explode(F.arrays_zip("months", "indexed")).alias("p"))
    return p.select("topic", "lang", month_text(F.col("p.months")).alias("month"), round_half_up(F.col("p.indexed"), 2).alias("indexed"))


def export_rows(spark, sf_dir):
    """The long export with its rates as texts."""
    return series.long_rows(_metrics(spark, sf_dir)).select("topic", "lang", "month", "views_user", "views_per_million")


def statement_sentences(spark, sf_dir):
    docs = activity.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_checks.sentences(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_points"))


def claim_checks(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    docs = activity.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_checks.claim_report(text_checks.claims(docs, "doc_id"), text_checks.known_numbers(m), "doc_id").select("doc_id", "checked", F.size("unverified").alias("n_unverified"), F.size("ratios").alias("n_ratios"))


NATION_LANGS = ["de", "fr", "es", "pl", "tr", "uk", "cs", "sk", "id", "pt", "it", "ru", "ja", "zh", "ar", "nl", "sv", "ro", "hu", "ko", "el", "bg", "fi", "da", "he"]
NATION_WORDS = ["German", "French", "Spanish", "Polish", "Turkish", "Ukrainian", "Czech", "Slovak", "Indonesian", "Portuguese", "Italian", "Russian", "Japanese", "Chinese", "Arabic", "Dutch", "Swedish", "Romanian", "Hungarian", "Korean", "Greek", "Bulgarian", "Finnish", "Danish", "Hebrew"]


def _of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))


def _nation_verdicts(spark, sf_dir):
    at = F.col("n_nationkey")
    return activity.table(spark, sf_dir, "nation").select(_of(NATION_LANGS, at).alias("lang"), _of(("growing", "flat", "declining"), at % 3).alias("label"), F.col("n_name").alias("basis"))


def label_contradictions(spark, sf_dir):
    """A sentence for each customer, on the language that stands in for the nation, against verdicts made of all nations."""
    said = F.concat(F.lit("The "), _of(NATION_WORDS, F.col("c_nationkey")), F.lit(" audience is "), F.when(F.col("c_custkey") % 3 == 0, "not ").otherwise(""), F.when(F.col("c_acctbal") >= 0, "growing.").otherwise("declining."))
    docs = spread(activity.table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("doc_id"), said.alias("text"))
    return label_checks.label_contradictions(docs, _nation_verdicts(spark, sf_dir), "doc_id").select("doc_id", "said", "lang", "claim", "label", "basis")


def _drafts(spark, sf_dir):
    """Drafts made of customers on the nation that stands in for a language; the regions are the analyses, and every third draft cites two."""
    k = F.col("c_custkey")
    n = F.floor(F.col("c_acctbal") / 10) * 10
    tail_ = F.concat(F.when(k % 4 == 0, ", 3 times more.").otherwise("."), F.when(k % 5 == 0, " Trust high (90%).").otherwise(""), F.when(k % 6 == 0, " The change is due to the platform.").otherwise(""))
    said = F.concat(F.lit("The "), _of(NATION_WORDS, F.col("c_nationkey")), F.lit(" audience is growing: "), F.abs(n).cast("long").cast("string"), F.lit(" readers"), tail_)
    rows = spread(activity.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")).join(F.broadcast(activity.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = rows.select(k.alias("doc_id"), said.alias("text"), F.when(k % 7 == 0, "de").otherwise("en").alias("lang"), F.col("n_regionkey").alias("_region"))
    own = F.array(F.col("_region"), F.when(F.col("doc_id") % 3 == 0, (F.col("_region") + 1) % 5))
    return docs.drop("_region"), docs.select("doc_id", F.explode(F.array_compact(own)).alias("analysis"))


def draft_checks(spark, sf_dir):
    """Drafts against their own analyses: numbers of suppliers, verdicts of nations (one language twice), names of regions."""
    docs, cited = _drafts(spark, sf_dir)
    nation, at = activity.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    supplied = activity.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == at)
    known = supplied.select(F.col("n_regionkey").alias("analysis"), F.lit(False).alias("percent"), F.abs(F.floor("s_acctbal")).cast("double").alias("known"))
    known = known.unionByName(nation.select(F.col("n_regionkey").alias("analysis"), F.lit(True).alias("percent"), F.lit(90.0).alias("known")).where("analysis > 1"))
    basis = F.when(F.col("n_regionkey") == 1, "share of edition views").otherwise("raw views")
    verdicts = nation.select(F.col("n_regionkey").alias("analysis"), _of(NATION_LANGS, at % 24).alias("lang"), _of(("growing", "flat", "declining"), at % 3).alias("label"), basis.alias("basis"))
    names = nation.where("n_regionkey = 2").select(F.col("n_regionkey").alias("analysis"), F.lit("growing").alias("name"))
    checked = drafts.draft_verdicts(docs, cited, known, verdicts, names, "doc_id")
    sizes = [F.size(c).alias(f"n_{c}") for c in ("unverified", "ratios")]
    return checked.select("doc_id", "checked", *sizes, "n_trust", "n_excuse", "n_contradiction", F.size("language").alias("n_language"), "ok")


def periods_asked(spark, sf_dir):
    """A request for each customer: some with months, a start, an end or a mistake."""
    k = F.col("c_custkey")
    today = F.date_add(F.lit("2016-01-31").cast("date"), (k * 7 % 3000).cast("int"))
    months = F.when(k % 3 > 0, (k % 140).cast("int"))
    start = F.when(k % 5 == 0, F.lit("2014-03-01")).when(k % 7 == 0, F.lit("20170501")).when(k % 11 == 0, F.lit("last year"))
    end = F.when(k % 4 == 0, F.lit("2018-12-31"))
    p = periods.period(today, months, start, end)
    return activity.table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", *[F.coalesce(f"p.{c}", F.lit("")).alias(f"{c}_day") for c in ("start", "end")], F.coalesce("p.problem", F.lit("")).alias("problem"))


def _resolved_parts(spark, sf_dir):
    k = F.col("p_partkey")
    article = F.when(k % 5 > 0, F.col("p_name"))
    return activity.table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_type", k.cast("string")).alias("topic"), _of(("en", "uk", "de"), k % 3).alias("lang"), F.lit("en").alias("source"), F.col("p_brand").alias("anchor"),
        F.when(k % 7 == 0, "disambiguation").when(k % 7 == 1, "title-mismatch").alias("issue"), article.alias("article"), F.lit("search").alias("method"),
        _of(("high", "medium", "low"), k % 11 % 3).alias("confidence"), F.when(k % 2 == 0, F.array("p_brand", "p_type", "p_name")).alias("candidates"),
    )


def exclusions(spark, sf_dir):
    rows = resolve.exclusions(_resolved_parts(spark, sf_dir))
    return rows.select("topic", "lang", "reason", F.concat_ws("; ", "search_hits").alias("search_hits"))


def resolution_warnings(spark, sf_dir):
    """Kinds of warnings of each row; every 13th analysed row has no views."""
    rows = _resolved_parts(spark, sf_dir)
    viewed = rows.where(F.length("topic") % 13 > 0).select("topic", "lang")
    told = resolve.warnings(rows, viewed)
    return told.select("kind", "topic", F.coalesce("lang", F.lit("")).alias("lang"), "text")


def _lines(spark, sf_dir):
    """Conversations as transcript lines: assistants call a tool and write, users bring its result."""
    k = F.col("turn")
    use = F.struct(F.lit("tool_use").alias("type"), F.when(k % 4 == 1, "Bash").otherwise("Read").alias("name"), F.concat(F.lit("t"), k.cast("string")).alias("id"), F.struct(F.concat(F.lit("make  report --n "), k.cast("string")).alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), (k - 1).cast("string")).alias("tool_use_id"), (F.length("text") % 2 == 0).alias("is_error"), F.concat(F.lit("Exit "), F.length("text").cast("string")).alias("content"))
    message = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("m1").alias("model"), F.array(F.to_json(use), F.to_json(said)).alias("content")))).otherwise(F.to_json(F.struct(F.array(F.to_json(result)).alias("content"))))
    message = F.regexp_replace(F.replace(F.replace(message, F.lit('["{'), F.lit("[{")), F.lit('}"]'), F.lit("}]")), r'\}","\{', "},{")
    plain = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.replace(message, F.lit('\\"'), F.lit('"')))
    return activity.table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("run"), F.col("turn").alias("line"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), plain.alias("message"))


def tool_calls(spark, sf_dir):
    calls = transcripts.tool_calls(transcripts.blocks(_lines(spark, sf_dir)))
    return calls.select("run", "call", "tool", "id", "input", F.coalesce("error", F.lit("")).alias("error"))


def tool_results(spark, sf_dir):
    got = transcripts.results(transcripts.blocks(_lines(spark, sf_dir)), "report")
    return got.select("run", "id", F.coalesce("result", F.lit("")).alias("result"))


def transcript_summaries(spark, sf_dir):
    rows = transcripts.summary(transcripts.blocks(_lines(spark, sf_dir)))
    return rows.select("run", F.concat_ws(",", "models").alias("models"), "tool_calls", "failed_calls")


def _runs(spark, sf_dir):
    """A run for each type of event and configuration: events are checks, passed where their value is above the middle."""
    e = activity.table(spark, sf_dir, "events").where("value is not null").withColumn("config", F.when(F.col("user_id") % 2 == 0, "with").otherwise("without"))
    runs = e.groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("eval"), "config")
    return runs.agg(F.sum((F.col("value") > 50).cast("long")).alias("passed"), F.count("*").alias("total"), F.max("value").alias("seconds"), F.count_distinct("user_id").cast("double").alias("tokens"), F.when(F.count("*") % 5 > 0, F.min("value")).alias("calls"))


def benchmark_summary(spark, sf_dir):
    return evaluation.benchmark(_runs(spark, sf_dir).where("eval not like '%-6' or config = 'with'"))


def statement_claims(spark, sf_dir):
    """Claims of short statements made of line items, each with its number, sign and unit."""
    l = activity.table(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("Part "), F.when(F.col("l_linenumber") % 2 == 0, "fell -").otherwise("rose +"), F.col("l_quantity").cast("int").cast("string"), _of((" %", "k", " times", ""), F.col("l_partkey") % 4), F.lit(" of "), F.col("l_suppkey").cast("string"), F.lit("."))
    docs = l.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", said.alias("text"))
    keyed = docs.select(F.struct("doc_id", "l_linenumber").alias("k"), "text")
    return text_checks.claims(keyed, "k").select("k.doc_id", "k.l_linenumber", "pos", "raw", "value", "signed", "percent", "ratio")


def trust_percentages(spark, sf_dir):
    said = F.concat(F.lit("Fine; trust high ("), F.col("c_custkey") % 100, F.when(F.col("c_custkey") % 4 == 0, "%)").otherwise(")"))
    return label_checks.trust_percentages(spread(activity.table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), said.alias("text")), "doc_id")


def language_problems(spark, sf_dir):
    """Brands with and without a term of the tool, taken as German or English texts."""
    text = F.concat("p_brand", F.element_at(F.array(*map(F.lit, (" flat", " Views", " fein"))), F.col("p_size") % 3 + 1))
    lang = F.when(F.col("p_partkey") % 2 == 0, "de").otherwise("en")
    problems = label_checks.language_problems(text, lang, F.array(F.lit("Brand")))
    return spread(activity.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")).select("p_partkey", F.explode(problems).alias("p")).select("p_partkey", "p.kind", F.concat_ws(" ", "p.words").alias("words"))


def language_guesses(spark, sf_dir):
    return activity.table(spark, sf_dir, "documents").select("doc_id", text_checks.language_guess(F.coalesce("text", F.lit(""))).alias("guess"))


def slugs(spark, sf_dir):
    p = activity.table(spark, sf_dir, "part")
    return p.select("p_partkey", text_checks.slug(F.array("p_name", "p_brand")).alias("slug"), text_checks.capped(F.col("p_type"), 10).alias("short_type"))


def run_stats(spark, sf_dir):
    return evaluation.stats(activity.table(spark, sf_dir, "events"), ["event_type"], "value")


def config_delta(spark, sf_dir):
    e = activity.table(spark, sf_dir, "events").withColumn("config", F.when(F.col("user_id") % 2 == 0, "with").otherwise("without"))
    return evaluation.delta(evaluation.stats(e, ["event_type", "config"], "value"), ["event_type"])


def turn_segments(spark, sf_dir):
    t = evaluation.turns(activity.table(spark, sf_dir, "conversations"), marker="the")
    return t.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


def search_top_hits(spark, sf_dir):
    """Parts of a type stand in for the hits of a query, dearer ones first."""
    hits = activity.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lang"), F.col("p_type").alias("query"), (-F.col("p_retailprice")).alias("rank"), F.format_string("%s %d", "p_name", "p_partkey").alias("title"))
    return resolve.ranked_hits(hits, 5).select("lang", "query", "title")


def monthly_events(spark, sf_dir):
    days = monthly.monthly_views(activity.table(spark, sf_dir, "events"), ["event_type"])
    return monthly.to_months(days, ["event_type"]).select("event_type", month_text(F.col("month")).alias("month"), "views")


def _stand_in_wiki(spark, sf_dir):
    """Search, link and property tables made of parts: types are topics, brands are editions."""
    p = activity.table(spark, sf_dir, "part").select(F.substring("p_brand", -1, 1).alias("b"), F.col("p_type").alias("query"), F.col("p_partkey").alias("k"), "p_size")
    p = p.withColumn("lang", F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(("en", "uk", "de", "fr", "es", "pl", "it", "pt", "nl", "sv")) for x in (str(i), n)]), F.col("b"))).where("lang is not null")
    title = F.concat(F.when(F.col("k") % 7 == 0, F.lit("other")).otherwise(F.col("query")), F.lit(" ("), F.col("k").cast("string"), F.lit(")"))
    hits = p.withColumn("title", title).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "query").orderBy("p_size", "k"))).select("lang", "query", "rank", "title", "k")
    top = hits.where("rank = 1")
    links = top.where("lang = 'en'").select("query", F.col("title").alias("src_title")).join(top.where("lang <> 'en'").select("query", F.col("lang").alias("dst_lang"), F.col("title").alias("dst_title"), "k"), "query")
    forward = links.where("k % 3 = 0").selectExpr("'en' as src_lang", "src_title", "dst_lang", "dst_title")
    back = links.where("k % 3 = 1").selectExpr("dst_lang as src_lang", "dst_title as src_title", "'en' as dst_lang", "src_title as dst_title")
    props = hits.where("k % 11 = 0").selectExpr("lang", "title", "true as is_disambiguation")
    return p.select(F.col("query").alias("topic")).distinct(), hits.drop("k"), forward.unionByName(back), props


def topic_resolution(spark, sf_dir):
    topics, hits, links, props = _stand_in_wiki(spark, sf_dir)
    return resolve.resolve(topics, ["en", "uk", "de", "fr"], hits, links, props).drop("candidates")


def _sessions(spark, sf_dir):
    """Conversations as sessions: users bring results that name an analysis and end in JSON, assistants call, write and hand back."""
    k, n = F.col("turn"), F.length("text")
    result = F.concat(F.lit('noted {"analysis": "out/'), (n % 3).cast("string"), F.lit('/analysis.json", "ok": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "pages": '), (n % 5).cast("string"), F.lit("}"))
    block = lambda **x: F.to_json(F.struct(*[v.alias(c) for c, v in x.items()]))
    said = block(type=F.lit("text"), text=F.concat(F.when(n % 4 == 0, "again ").otherwise("so "), n.cast("string")))
    got = block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), (k - 1).cast("string")), content=result)
    use = block(type=F.lit("tool_use"), name=F.when(n % 7 == 0, "SubagentHandback").otherwise("Bash"), id=F.concat(F.lit("t"), k.cast("string")), input=F.struct(F.concat(F.lit("make report "), k.cast("string")).alias("command"), F.concat(F.lit("handed "), n.cast("string")).alias("message")))
    wrote = block(type=F.lit("text"), text=F.concat(F.lit("answer "), n.cast("string")))
    listed = F.when(F.col("role") == "assistant", F.concat_ws(",", use, wrote)).otherwise(F.concat_ws(",", said, got))
    return activity.table(spark, sf_dir, "conversations").where("text is not null and role <> 'system'").select(F.col("conv_id").alias("run"), k.alias("line"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.concat(F.lit('{"content":['), listed, F.lit("]}")).alias("message"))


def turn_checks(spark, sf_dir):
    """Turns of sessions: prompts, answers, calls, analyses so far and what reports said."""
    rows = transcripts.turn_rollup(transcripts.blocks(_sessions(spark, sf_dir)), "report", marker="again")
    report = lambda r: F.concat_ws(":", r["command"], F.coalesce(r["ok"].cast("string"), F.lit("-")), F.coalesce(r["pages"].cast("string"), F.lit("-")))
    return rows.select("run", "turn", "prompt", "answer", "tool_calls", *[F.concat_ws(",", c).alias(c) for c in ("analyses", "known")], F.array_join(F.transform("reports", report), ",").alias("reports"))


PHRASES = ["Ринок растет повільно", "Доля переглядів мала", "Пишуть на німецькій мові", "Цей артикль новий", "Сайт Wikipedia великий", "Потрібен keyword tool", "Показник flat або YoY", "Частка зростає", "Эта новина свіжа", "Шукають на польському, чеському"]


def ukrainian_problems(spark, sf_dir):
    """Two phrases for each customer, some of them with words that do not belong in a Ukrainian text."""
    k = F.col("c_custkey")
    text = F.concat(_of(PHRASES, k % 10), F.lit(". "), _of(PHRASES, k * 7 % 10), F.when(k % 4 == 0, ' «some quoted words»').otherwise(" `code here`"), F.lit("."))
    problems = label_checks.language_problems(text, F.lit("uk"), F.when(k % 3 == 0, F.array(F.lit("Keyword"))))
    return spread(activity.table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.explode(problems).alias("p")).select("c_custkey", "p.kind", F.array_join("p.words", "|").alias("words"))


def report_texts(spark, sf_dir):
    """Reports made of documents, some of their texts too long, some lists too; with their views in short form."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    flat = F.regexp_replace(t, r"[|\s]+", " ")
    findings = F.array_join(F.transform(F.sequence(F.lit(1), (k % 8 + 1).cast("int")), lambda i: F.concat(F.lit(" "), F.substring(flat, i, (k * 37 % 400).cast("int")), F.lit(" "))), "|")
    rows = activity.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.substring(flat, F.lit(1), (k % 120).cast("int")).alias("title"), F.when(k % 3 > 0, F.substring(flat, 5, 300)).alias("verdict"), findings.alias("findings"), F.concat(F.lit("a||"), F.substring(flat, 3, 250)).alias("caveats"))
    told = reports.report_inputs(rows, ["doc_id", "n_chars"])
    short = [compact_number((F.col("n_chars") * F.col("n_chars") * 7).cast("double"), lang).alias(f"views_{lang}") for lang in ("en", "uk")]
    size = lambda c: F.length(F.array_join(c, "")).alias(f"n_{c}")
    return told.select("doc_id", F.length("title").alias("n_title"), F.coalesce(F.length("verdict"), F.lit(-1)).alias("n_verdict"), size("findings"), size("caveats"), F.array_join("problems", " / ").alias("problems"), *short)


LATIN, GREEK_AND_CYRILLIC = [(0x21, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC)], [(0x370, 0x3FF), (0x400, 0x52F)]


def script_choices(spark, sf_dir):
    """The face that can draw each document: Latin ones in the base face, Greek and Cyrillic in the other."""
    s = charts.script_support(F.col("text"), LATIN, [*LATIN, *GREEK_AND_CYRILLIC])
    return activity.table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.choice", F.array_join("s.offending", "").alias("offending"))


def label_places(spark, sf_dir):
    """Customers as labels of a chart for each nation and segment, as high as their balance."""
    rows = activity.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", F.floor(F.col("c_acctbal") / 20).cast("double").alias("y"))
    return charts.placed_labels(rows, ["c_nationkey", "c_mktsegment"], "y", 500.0, ["c_custkey"])


def incremental_metrics(spark, sf_dir):
    """Events followed as a stream, a file at a time: months, views and the last month's views of each type."""
    folder = f"{shared_folder(spark)}/followed-{uuid.uuid4().hex}"
    given = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(given).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")

    def compute(rows):
        return rows.groupBy("event_type").agg(F.count("*").alias("months"), F.sum("views").alias("views"), F.max_by("views", "month").alias("last_views"))

    incremental.follow(events, ["event_type"], folder, compute).awaitTermination()
    return incremental.current(spark.read.parquet(f"{folder}/metrics"), ["event_type"])


def redirected_titles(spark, sf_dir):
    """Parts that lead to the next one: chains of up to eight, and cycles of six with what leads into them."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    to = F.when(k % 50 == 40, k - 5).when(k % 9 > 0, k + 1)
    redirects = activity.table(spark, sf_dir, "part").select(F.lit("en").alias("lang"), name(k).alias("title"), name(to).alias("target"))
    return resolve.canonical(redirects).select("title", "target")


def analysis_documents(spark, sf_dir):
    """A nested document for each topic, through JSON and back, as one flat table of its series and ranking."""
    m = _metrics(spark, sf_dir)
    order = Window.partitionBy("run")
    rows = m.withColumn("run", F.col("topic")).withColumn("position", F.row_number().over(order.orderBy("lang")) - 1)
    ranked = series.ranking(m).withColumn("run", F.col("topic")).withColumn("position", F.row_number().over(order.orderBy(F.desc("score"), "lang")) - 1)
    runs = m.groupBy(F.col("topic").alias("run")).agg(F.array(F.first("topic")).alias("topics"), F.array_sort(F.collect_set("lang")).alias("langs")).withColumn("normalized", F.lit(True))
    docs = documents.analysis_documents(runs, documents.series_fields(rows, F.col("lang"), ["run", "position"]), ranked.select("run", "position", F.col("lang").alias("name"), F.col("score").cast("double"), "why"))
    back = docs.select("run", F.to_json(F.struct(*[c for c in docs.columns if c != "run"])).alias("j")).select("run", F.from_json("j", documents.ANALYSIS).alias("d")).select("run", "d.*")
    tables = documents.document_tables(back)
    flat = tables["series"].select("run", F.lit("series").alias("part"), "position", "name", F.col("verdict.label").alias("said"), F.col("relativeGrowth").alias("value"), F.size("points").alias("n"))
    return flat.unionByName(tables["ranking"].select("run", F.lit("ranking").alias("part"), "position", "name", F.col("why").alias("said"), F.col("score").alias("value"), F.lit(0).alias("n")))


def wire_views(spark, sf_dir):
    """Views of one edition and two articles within some months, from wire rows."""
    rows = activity.pageviews(activity.wire_rows(spark, sf_dir), "x3.wikipedia", articles=["Order 1-URGENT", "Order 5-LOW"], first="1995-03", last="1997-11")
    return rows.groupBy("article", month_text(F.col("month")).alias("month")).agg(F.sum("views").alias("views"))


def edition_views(spark, sf_dir):
    rows = activity.edition_totals(activity.wire_rows(spark, sf_dir))
    return rows.select("lang", month_text(F.col("month")).alias("month"), "views")


def readers_notes(spark, sf_dir):
    k = F.col("n_nationkey")
    langs = F.array(_of(NATION_LANGS, k), _of(NATION_LANGS, k * 7 % 25), F.when(k % 3 == 0, "en").otherwise("zz"))
    return activity.table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(resolve.readers_note(langs), F.lit("")).alias("note"))


def term_hints(spark, sf_dir):
    k = F.col("p_partkey")
    words = F.array(_of([t.capitalize() for t in label_checks.UKRAINIAN_TERMS], k % 17), F.col("p_brand"), _of(list(label_checks.UKRAINIAN_TERMS), k % 5))
    return activity.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(label_checks.term_hints(words, F.when(k % 4 > 0, "uk").otherwise("de")), F.lit("")).alias("hints"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (series_metrics, dense_points, spikes, level_shifts, edition_growth, ranked_series, series_reasons, summary_rows, report_rows, indexed_points, export_rows, statement_sentences, statement_claims, claim_checks, draft_checks, label_contradictions, trust_percentages, language_problems, language_guesses, slugs, run_stats, config_delta, turn_segments, search_top_hits, monthly_events, topic_resolution, exclusions, resolution_warnings, periods_asked, tool_calls, tool_results, transcript_summaries, benchmark_summary, wire_views, edition_views, readers_notes, term_hints, redirected_titles, analysis_documents, turn_checks, script_choices, label_places, incremental_metrics, report_texts, ukrainian_problems)
}

_BASE = f"""
WITH o AS (
  SELECT c_mktsegment AS topic, n_name AS lang, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS mi, o_orderstatus = 'P' AS bot, floor(o_totalprice)::BIGINT AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
obs AS (SELECT topic, lang, mi, sum(v)::BIGINT AS v FROM o WHERE NOT bot GROUP BY ALL),
bots AS (SELECT topic, lang, mi, sum(v)::BIGINT AS v FROM o WHERE bot GROUP BY ALL),
ed AS (SELECT lang, mi, sum(v)::BIGINT AS v FROM obs GROUP BY ALL),
span AS (SELECT topic, lang, count(*) AS observed, min(mi) AS a, greatest(max(mi), {LAST}) AS b FROM obs GROUP BY ALL),
cal AS (SELECT topic, lang, observed, a, unnest(range(a, b + 1))::INT AS mi FROM span),
pts AS (
  SELECT cal.*, coalesce(obs.v, 0)::DOUBLE AS v, mi - a AS i, count(*) OVER (PARTITION BY topic, lang) AS n,
         row_number() OVER (PARTITION BY topic, lang ORDER BY mi DESC) AS back, lpad((mi // 12)::VARCHAR, 4, '0') || '-' || lpad((mi % 12 + 1)::VARCHAR, 2, '0') AS month
  FROM cal LEFT JOIN obs USING (topic, lang, mi)),
near AS (
  SELECT *, list(v) OVER (PARTITION BY topic, lang ORDER BY mi ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l,
         list(v) OVER (PARTITION BY topic, lang ORDER BY mi ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS r FROM pts),
flags AS (SELECT * EXCLUDE (l, r), coalesce(list_median(list_concat(coalesce(l, []), coalesce(r, []))) > 0 AND v > 2.5::DOUBLE * list_median(list_concat(coalesce(l, []), coalesce(r, []))), false) AS spike FROM near),
shares AS (
  SELECT topic, lang, flags.v / ed.v * 1e6 AS s, row_number() OVER (PARTITION BY topic, lang ORDER BY mi DESC) AS back, count(*) OVER (PARTITION BY topic, lang) AS m
  FROM flags JOIN ed USING (lang, mi)),
rel AS (
  SELECT topic, lang, avg(s) FILTER (back <= 12) AS pm,
         CASE WHEN any_value(m) >= 24 AND median(s) FILTER (back BETWEEN 13 AND 24) > 0
              THEN (median(s) FILTER (back <= 12) - median(s) FILTER (back BETWEEN 13 AND 24)) / median(s) FILTER (back BETWEEN 13 AND 24) * 100 END AS rg FROM shares GROUP BY ALL),
edr AS (SELECT lang, v::DOUBLE AS v, row_number() OVER (PARTITION BY lang ORDER BY mi DESC) AS back FROM ed),
edg AS (
  SELECT lang, median(v) FILTER (back <= 12) AS m12,
         CASE WHEN count(*) >= 24 AND median(v) FILTER (back BETWEEN 13 AND 24) > 0
              THEN (median(v) FILTER (back <= 12) - median(v) FILTER (back BETWEEN 13 AND 24)) / median(v) FILTER (back BETWEEN 13 AND 24) * 100 END AS eg FROM edr GROUP BY ALL),
agg AS (
  SELECT topic, lang, any_value(n) AS n, any_value(a) AS a, any_value(observed)::DOUBLE / any_value(n) AS comp, sum(v) FILTER (back <= 12) AS t12, sum(v) FILTER (back BETWEEN 13 AND 24) AS p12,
         median(v) FILTER (back <= 12) AS md12, median(v) FILTER (back BETWEEN 13 AND 24) AS mdp, avg(v) FILTER (back <= 12) AS av,
         avg(spike::INT) AS ss, arg_max(month, v * 1000 - i) AS pmo, max(v) AS pv,
         CASE WHEN any_value(n) >= 6 THEN (exp(regr_slope(ln(greatest(v, 1)), i) * 12) - 1) * 100 END AS tr,
         CASE WHEN any_value(n) >= 6 THEN CASE WHEN min(greatest(v, 1)) = max(greatest(v, 1)) THEN 0 ELSE regr_r2(ln(greatest(v, 1)), i) END END AS r2,
         median(v) FILTER (i < n // 2) AS m1, median(v) FILTER (back <= 3) AS m3
  FROM flags GROUP BY topic, lang),
bot AS (
  SELECT agg.topic, agg.lang, sum(CASE WHEN p.back <= 12 THEN bots.v ELSE 0 END) AS bv
  FROM agg JOIN (SELECT DISTINCT topic, lang FROM bots) USING (topic, lang) JOIN pts p USING (topic, lang) LEFT JOIN bots ON bots.topic = agg.topic AND bots.lang = agg.lang AND bots.mi = p.mi GROUP BY ALL),
x AS (
  SELECT agg.*, pm, rg, eg, CASE WHEN n >= 24 AND p12 > 0 THEN (t12 - p12) / p12 * 100 END AS yoy, CASE WHEN n >= 24 AND mdp > 0 THEN (md12 - mdp) / mdp * 100 END AS rob,
         coalesce(bv, 0) / nullif(t12 + coalesce(bv, 0), 0) * CASE WHEN bot.topic IS NOT NULL THEN 1 END AS bs,
         n >= 8 AND m3 >= 100 AND NOT (m1 > 0 AND m3 / m1 <= 20) AS shift, greatest(a - {START}, 0) AS late
  FROM agg LEFT JOIN rel USING (topic, lang) LEFT JOIN edg USING (lang) LEFT JOIN bot USING (topic, lang)),
y AS (
  SELECT *, coalesce(rg, rob, tr) AS g,
         greatest(0, 100 - CASE WHEN shift THEN 40 ELSE 0 END - CASE WHEN late >= 3 THEN 10 ELSE 0 END - CASE WHEN n < 6 THEN 60 WHEN n < 12 THEN 40 WHEN n < 24 THEN 15 ELSE 0 END
           - CASE WHEN comp < 0.95::DOUBLE THEN 15 ELSE 0 END - CASE WHEN ss > 0.15::DOUBLE THEN 25 WHEN ss > 0.05::DOUBLE THEN 10 ELSE 0 END - CASE WHEN yoy > 10 AND rob < 0 THEN 20 ELSE 0 END
           - CASE WHEN bs > 0.4::DOUBLE THEN 35 WHEN bs > 0.3::DOUBLE THEN 25 WHEN bs > 0.15::DOUBLE THEN 10 ELSE 0 END - CASE WHEN r2 < 0.2::DOUBLE THEN 15 ELSE 0 END - CASE WHEN av < 300 THEN 20 ELSE 0 END) AS base FROM x),
z AS (
  SELECT topic, lang, n AS months, floor(comp * 100 + 0.5) / 100 AS completeness, t12::BIGINT AS total_last12, floor(av + 0.5)::BIGINT AS avg_last12, floor(pm * 10 + 0.5) / 10 AS per_million,
         floor(yoy * 10 + 0.5) / 10 AS yoy, floor(rob * 10 + 0.5) / 10 AS robust_growth, floor(rg * 10 + 0.5) / 10 AS relative_growth, floor(eg * 10 + 0.5) / 10 AS edition_growth,
         floor(tr * 10 + 0.5) / 10 AS trend_annual, floor(r2 * 100 + 0.5) / 100 AS r2, floor(ss * 100 + 0.5) / 100 AS spike_share, pmo AS peak_month, pv::BIGINT AS peak_views, floor(bs * 100 + 0.5) / 100 AS bot_share,
         CASE WHEN abs(rg) > 10 AND abs(rob) > 10 AND sign(rg) <> sign(rob) THEN greatest(0, base - 10) ELSE base END::INT AS trust,
         CASE WHEN shift OR g IS NULL THEN 'insufficient-data' WHEN g > 10 THEN 'growing' WHEN g < -10 THEN 'declining' ELSE 'flat' END AS verdict FROM y)
"""
_LABEL = "CASE WHEN trust >= 70 THEN 'high' WHEN trust >= 40 THEN 'medium' ELSE 'low' END"


def _said(key: str, **parts: str) -> str:
    """SQL of a note's text; parts: SQL of its variables."""
    out = "'" + notes.NOTES["en"][key].replace("'", "''") + "'"
    for name, sql in parts.items():
        out = out.replace("{" + name + "}", f"' || ({sql}) || '")
    return out


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN ({x})::DECIMAL(38,0)::VARCHAR ELSE ({x})::DECIMAL(38,1)::VARCHAR END"


def _sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '+' WHEN {x} < 0 THEN '-' ELSE '' END || floor(abs({x}) + 0.5)::BIGINT::VARCHAR || '%'"


def _tenth(x: str) -> str:
    return f"floor({x} * 10 + 0.5) / 10"


def _local(x: str) -> str:
    """A number of at most one decimal as Ukrainian text."""
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || replace(format('{{:,}}', floor(abs({x}) + 0.01)::BIGINT), ',', chr(160)) || CASE WHEN round((abs({x}) - floor(abs({x}) + 0.01)) * 10) > 0 THEN ',' || round((abs({x}) - floor(abs({x}) + 0.01)) * 10)::INT ELSE '' END"


_PCT = "floor({} * 100 + 0.5)::BIGINT::VARCHAR"
_INNER = f"""CASE WHEN g IS NULL THEN {_said('basisNone')}
  WHEN rg IS NOT NULL THEN {_said('basisRelative', rel=_sign('rg'), ed=f"coalesce({_sign('eg')}, 'n/a')", raw=f"coalesce({_sign('rob')}, 'n/a')")}
  WHEN rob IS NOT NULL THEN {_said('basisMedian', raw=_sign('rob'))} ELSE {_said('basisTrend', g=_sign('g'))} END"""
_OPPOSITE = "abs(rg) > 10 AND abs(rob) > 10 AND sign(rg) <> sign(rob)"
_TEXTS = (
    _BASE
    + f""",
ends AS (SELECT topic, lang, i, month, v, median(v) OVER (PARTITION BY topic, lang ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS md FROM flags),
jump AS (
  SELECT topic, lang, coalesce(min(month) FILTER (v > greatest(5 * m1, 1) AND md > greatest(5 * m1, 1)), min(month)) AS jm, floor(any_value(m1) + 0.5)::BIGINT::VARCHAR AS jf, floor(any_value(m3) + 0.5)::BIGINT::VARCHAR AS jt
  FROM ends JOIN x USING (topic, lang) GROUP BY ALL),
words AS (
  SELECT topic, lang, CASE WHEN shift THEN {_said('basisShift', month='jm', to='jt', **{'from': 'jf'})} WHEN g BETWEEN -10 AND 10 THEN {_said('flat', g=_sign('g'), inner=_INNER)} ELSE {_INNER} END AS basis,
    array_to_string(list_filter([
      CASE WHEN shift THEN {_said('levelShift', month='jm', to='jt', **{'from': 'jf'})} END,
      CASE WHEN late >= 3 THEN {_said('lateStart', first="lpad((a // 12)::VARCHAR, 4, '0') || '-' || lpad((a % 12 + 1)::VARCHAR, 2, '0')", months='late::VARCHAR')} END,
      CASE WHEN n < 6 THEN {_said('months6', months='n::VARCHAR')} WHEN n < 12 THEN {_said('months12', months='n::VARCHAR')} WHEN n < 24 THEN {_said('months24', months='n::VARCHAR')} END,
      CASE WHEN comp < 0.95::DOUBLE THEN {_said('gaps', pct=_PCT.format('comp'))} END,
      CASE WHEN ss > 0.15::DOUBLE THEN {_said('spikesMany', pct=_PCT.format('ss'))} WHEN ss > 0.05::DOUBLE THEN {_said('spikesSome', pct=_PCT.format('ss'))} END,
      CASE WHEN yoy > 10 AND rob < 0 THEN {_said('spikeDriven')} END,
      CASE WHEN bs > 0.4::DOUBLE THEN {_said('bots40', pct=_PCT.format('bs'))} WHEN bs > 0.3::DOUBLE THEN {_said('bots30', pct=_PCT.format('bs'))} WHEN bs > 0.15::DOUBLE THEN {_said('bots15', pct=_PCT.format('bs'))} END,
      CASE WHEN r2 < 0.2::DOUBLE THEN {_said('noisy', rsq="printf('%.2f', r2)")} END,
      CASE WHEN av < 300 THEN {_said('lowVolume', n='floor(av + 0.5)::BIGINT::VARCHAR')} END,
      CASE WHEN {_OPPOSITE} THEN {_said('rawVsRelative', raw=_num(_tenth('rob')), rel=_num(_tenth('rg')), ed=f"coalesce({_num(_tenth('eg'))}, 'null')")} END
    ], lambda w: w IS NOT NULL), ' | ') AS reasons FROM y JOIN jump USING (topic, lang))
"""
)
_VIEWS = f"CASE WHEN per_million IS NOT NULL THEN {_num('per_million')} || ' views per 1M edition views' ELSE avg_last12 || ' views/month' END"

ORACLE_SQL: dict[str, str] = {
    "series_metrics": _BASE + f"SELECT *, {_LABEL} AS trust_label FROM z",
    "dense_points": _BASE + "SELECT topic, lang, month, v AS views FROM pts",
    "spikes": _BASE + "SELECT topic, lang, month, v AS views FROM flags WHERE spike",
    "level_shifts": _BASE
    + """,
ramp AS (SELECT topic, lang, month, i, n, back, CASE WHEN i < 50 THEN floor(v / 100000) ELSE v END AS v FROM pts),
rest AS (SELECT *, median(v) OVER (PARTITION BY topic, lang ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS md FROM ramp),
lv AS (SELECT topic, lang, any_value(n) AS n, median(v) FILTER (i < n // 2) AS m1, median(v) FILTER (back <= 3) AS m3, min(month) AS head FROM ramp GROUP BY topic, lang),
hit AS (SELECT topic, lang, min(month) AS month FROM rest JOIN lv USING (topic, lang) WHERE v > greatest(5 * m1, 1) AND md > greatest(5 * m1, 1) GROUP BY ALL)
SELECT topic, lang, coalesce(hit.month, head) AS month, floor(m1 + 0.5)::BIGINT AS level_from, floor(m3 + 0.5)::BIGINT AS level_to
FROM lv LEFT JOIN hit USING (topic, lang) WHERE n >= 8 AND m3 >= 100 AND NOT (m1 > 0 AND m3 / m1 <= 20)""",
    "edition_growth": _BASE + "SELECT lang, floor(eg * 10 + 0.5) / 10 AS edition_growth, m12 AS median_last12 FROM edg",
    "ranked_series": _TEXTS
    + f""",
s AS (
  SELECT topic, lang, floor((greatest(-50, least(coalesce(relative_growth, robust_growth, trend_annual, 0), 200)) + 50) * (trust / 100.0::DOUBLE) + log10(coalesce(per_million, 0) + 1) * 10 + 0.5)::BIGINT AS score,
         verdict || ' (' || basis || '), trust ' || {_LABEL} || ', ' || {_VIEWS} AS why FROM z JOIN words USING (topic, lang))
SELECT *, row_number() OVER (ORDER BY score DESC, topic, lang)::BIGINT AS place FROM s""",
    "series_reasons": _TEXTS + "SELECT topic, lang, reasons, basis FROM words",
    "summary_rows": _TEXTS
    + f""",
sp AS (SELECT topic, lang, string_agg(month, ', ' ORDER BY mi) AS m FROM flags WHERE spike GROUP BY ALL)
SELECT topic, lang, verdict || ' — ' || basis AS verdict, relative_growth, robust_growth, edition_growth, yoy, trend_annual, r2, avg_last12 AS human_views_per_month, per_million, bot_share,
       coalesce(sp.m, 'none') AS spike_months, peak_month || ': ' || peak_views AS peak, {_LABEL} || ' (' || trust || ')' AS trust
FROM z JOIN words USING (topic, lang) LEFT JOIN sp USING (topic, lang)""",
    "report_rows": _BASE
    + f"""
SELECT topic, lang, {_local('avg_last12')} AS views, coalesce({_local('per_million')}, '—') AS per_million,
       {', '.join(f"coalesce(CASE WHEN {c} > 0 THEN '+' ELSE '' END || {_local(c)} || '%', '—') AS {n}" for c, n in (('relative_growth', 'relative'), ('robust_growth', 'raw'), ('edition_growth', 'edition')))},
       verdict, {_LABEL} || ' ' || trust AS trust FROM z""",
    "indexed_points": _BASE
    + """,
m AS (SELECT topic, lang, CASE WHEN median(v) > 0 THEN median(v) ELSE median(v) FILTER (v > 0) END AS md FROM pts GROUP BY ALL)
SELECT topic, lang, month, floor((CASE WHEN md > 0 THEN v / md * 100 ELSE v END) * 100 + 0.5) / 100 AS indexed FROM pts JOIN m USING (topic, lang)""",
    "export_rows": _BASE + "SELECT topic, lang, month, pts.v::BIGINT AS views_user, coalesce(printf('%.2f', pts.v / ed.v * 1e6), '') AS views_per_million FROM pts LEFT JOIN ed USING (lang, mi)",
    "language_guesses": r"""
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[іїєґІЇЄҐ]') THEN 'uk' WHEN regexp_matches(coalesce(text, ''), '\p{Cyrillic}') THEN NULL
       WHEN NOT regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') THEN 'en' END AS guess FROM documents""",
    "slugs": r"""
WITH s AS (SELECT p_partkey, p_type, substr(regexp_replace(regexp_replace(lower(p_name || '_' || p_brand), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS s FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN 'analysis' ELSE s END AS slug, CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 9) || '…' ELSE p_type END AS short_type FROM s""",
    "run_stats": "SELECT event_type, floor(avg(value) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(value) * 100 + 0.5) / 100 AS stddev, count(value) AS n FROM events WHERE NOT isnan(value) GROUP BY 1",
    "config_delta": """
WITH m AS (SELECT event_type, user_id % 2 = 0 AS w, floor(avg(value) * 100 + 0.5) / 100 AS mean FROM events GROUP BY ALL)
SELECT a.event_type, floor((a.mean - b.mean) * 100 + 0.5) / 100 AS delta FROM m a JOIN m b USING (event_type) WHERE a.w AND NOT b.w""",
    "turn_segments": """
WITH f AS (SELECT *, role = 'user' AND trim(coalesce(text, '')) <> '' AS filled, contains(coalesce(text, ''), 'the') AS marked FROM conversations),
o AS (SELECT conv_id, min(turn) AS first FROM f WHERE filled GROUP BY 1),
s AS (SELECT f.*, sum((filled AND (turn = first OR marked))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM f LEFT JOIN o USING (conv_id))
SELECT conv_id, coalesce(segment, 0)::BIGINT AS segment, count(*) AS n, min(turn) AS first_turn FROM s GROUP BY 1, 2""",
    "search_top_hits": """
WITH h AS (SELECT p_brand AS lang, p_type AS query, p_name || ' ' || p_partkey AS title, -p_retailprice AS rank FROM part)
SELECT lang, query, title FROM h QUALIFY row_number() OVER (PARTITION BY lang, query ORDER BY rank, title) <= 5""",
    "monthly_events": "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS views FROM events GROUP BY ALL",
}

ORACLE_SQL |= {
    "label_contradictions": f"""
WITH v AS (SELECT n_nationkey AS k, {NATION_LANGS}[n_nationkey + 1] AS lang, ['growing', 'flat', 'declining'][n_nationkey % 3 + 1] AS label, n_name AS basis FROM nation),
c AS (SELECT c_custkey, c_nationkey AS k, CASE WHEN c_acctbal >= 0 THEN 'growing' ELSE 'declining' END AS claim FROM customer WHERE c_custkey % 3 <> 0)
SELECT c_custkey AS doc_id, 'The ' || {NATION_WORDS}[k + 1] || ' audience is ' || claim || '.' AS said, lang, claim, label, basis
FROM c JOIN v USING (k) WHERE (claim = 'growing') <> (label = 'growing')""",
    "draft_checks": f"""
WITH d AS (
  SELECT c_custkey AS doc_id, c_nationkey AS k, n_regionkey AS r, abs(floor(c_acctbal / 10) * 10)::BIGINT AS n, {NATION_LANGS}[c_nationkey + 1] AS named FROM customer JOIN nation ON c_nationkey = n_nationkey),
cited AS (SELECT doc_id, r AS analysis FROM d UNION SELECT doc_id, (r + 1) % 5 FROM d WHERE doc_id % 3 = 0),
pool AS (SELECT DISTINCT n_regionkey AS analysis, abs(floor(s_acctbal))::DOUBLE AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT r, x::DOUBLE FROM range(5) t(r), unnest([100, 2.5, 40, 70, 300, 1000]) u(x)),
near AS (
  SELECT DISTINCT doc_id FROM d JOIN cited USING (doc_id) JOIN pool USING (analysis)
  WHERE abs(n - x) <= CASE WHEN x >= 100 THEN x * 0.025::DOUBLE WHEN x >= 10 THEN 0.55::DOUBLE ELSE greatest(0.05::DOUBLE, x * 0.02::DOUBLE) END),
v AS (SELECT n_regionkey AS analysis, {NATION_LANGS}[n_nationkey % 24 + 1] AS lang, n_nationkey % 3 AS label FROM nation),
seen AS (SELECT doc_id, count(*) AS n_series, count(DISTINCT lang) AS n_langs, list(lang) AS langs, list(label) AS labels, max((analysis = 1)::INT) AS shared, max((analysis = 2)::INT) AS quoted, max((analysis > 1)::INT) AS ninety FROM cited JOIN v USING (analysis) GROUP BY 1),
r AS (
  SELECT d.doc_id, (n > 12 AND n NOT BETWEEN 1900 AND 2099)::INT AS said, doc_id IN (SELECT doc_id FROM near) AS fine, seen.*,
         CASE WHEN list_position(langs, named) > 0 THEN labels[list_position(langs, named)] END AS label FROM d JOIN seen USING (doc_id)),
f AS (
  SELECT doc_id, said::BIGINT + (doc_id % 4 = 0)::BIGINT + (doc_id % 5 = 0)::BIGINT AS checked, (said = 1 AND NOT fine)::INT + (doc_id % 5 = 0 AND ninety = 0)::INT AS n_unverified, (doc_id % 4 = 0)::INT AS n_ratios,
         (doc_id % 5 = 0)::INT AS n_trust, (doc_id % 6 = 0 AND shared = 1)::INT AS n_excuse, (n_series = n_langs AND coalesce(label <> 0, false))::INT AS n_contradiction,
         (doc_id % 7 = 0 AND (quoted = 0 OR doc_id % 5 = 0))::INT AS n_language FROM r)
SELECT *, n_unverified + n_ratios + n_trust + n_excuse + n_contradiction + n_language = 0 AS ok FROM f""",
    "statement_sentences": r"""
WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])[ \t\n\x0B\f\r\x{A0}\x{202F}]+', '\1' || chr(1), 'g'), '\n+|[|]', chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_points FROM t WHERE trim(s) <> '' GROUP BY 1""",
    "statement_claims": """
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity::INT AS q, l_partkey % 4 AS u, l_suppkey AS o, l_linenumber % 2 = 0 AS down FROM lineitem),
a AS (
  SELECT doc_id, l_linenumber, 0 AS pos, CASE WHEN down THEN '-' ELSE '+' END || q || [' %', 'k', '×', ''][u + 1] AS raw,
         q::DOUBLE * CASE WHEN u = 1 THEN 1000 ELSE 1 END * CASE WHEN down AND u <> 2 THEN -1 ELSE 1 END AS value, u <> 2 AS signed, u = 0 AS percent, u = 2 AS ratio
  FROM l),
b AS (SELECT doc_id, l_linenumber, 1 AS pos, o::VARCHAR AS raw, o::DOUBLE AS value, false AS signed, false AS percent, false AS ratio FROM l WHERE o NOT BETWEEN 1900 AND 2099)
SELECT * FROM a WHERE percent OR ratio OR abs(value) > 12 UNION ALL SELECT * FROM b WHERE value > 12""",
    "periods_asked": """
WITH r AS (
  SELECT c_custkey, date_trunc('month', DATE '2016-01-31' + (c_custkey * 7 % 3000)::INT)::DATE AS m, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 140)::INT END AS months,
         CASE WHEN c_custkey % 5 = 0 THEN '2014-03-01' WHEN c_custkey % 7 = 0 THEN '20170501' WHEN c_custkey % 11 = 0 THEN 'last year' END AS s, CASE WHEN c_custkey % 4 = 0 THEN '2018-12-31' END AS e FROM customer),
d AS (
  SELECT c_custkey, s = 'last year' AS bad, months, greatest('20150701', coalesce(replace(s, '-', ''), strftime(m - to_months(coalesce(months, 24)), '%Y%m%d'))) AS a, coalesce(replace(e, '-', ''), strftime(m - 1, '%Y%m%d')) AS b FROM r),
p AS (SELECT *, CASE WHEN bad THEN 'bad day' WHEN months < 1 OR months > 135 THEN 'bad number of months' WHEN a >= b THEN 'start not before end' ELSE '' END AS problem FROM d)
SELECT c_custkey, CASE WHEN problem = '' THEN a ELSE '' END AS start_day, CASE WHEN problem = '' THEN b ELSE '' END AS end_day, problem FROM p""",
    "exclusions": """
WITH r AS (
  SELECT p_partkey AS k, p_type || ' ' || p_partkey AS topic, ['en', 'uk', 'de'][p_partkey % 3 + 1] AS lang, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS article, p_partkey % 7 AS i, p_partkey % 11 % 3 = 2 AS low,
         CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type, p_name] END AS hits FROM part)
SELECT topic, lang,
  CASE WHEN article IS NULL AND i = 0 THEN '"' || topic || '" is ambiguous (disambiguation page) — re-run with a specific English title' WHEN article IS NULL THEN 'no article found'
       WHEN i = 1 THEN 'no article titled "' || topic || '" — the closest is "' || article || '" (a different subject?)' ELSE 'no article linked to the topic (text search only)' END AS reason,
  array_to_string(CASE WHEN article IS NULL AND i = 0 THEN coalesce(hits, []) WHEN article IS NULL THEN [] WHEN i = 1 THEN coalesce(hits, [article]) ELSE list_concat([article], coalesce(hits, [])) END, '; ') AS search_hits
FROM r WHERE article IS NULL OR low""",
    "resolution_warnings": """
WITH r AS (
  SELECT p_type || ' ' || p_partkey AS topic, ['en', 'uk', 'de'][p_partkey % 3 + 1] AS lang, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS article, p_partkey % 7 AS i, ['high', 'medium', 'low'][p_partkey % 11 % 3 + 1] AS c, p_brand, CASE WHEN p_partkey % 2 = 0 THEN '"' || p_brand || '", "' || p_type || '", "' || p_name || '"' ELSE '' END AS hits FROM part),
u AS (SELECT *, topic || '@' || lang AS w, length(topic) % 13 > 0 AS seen FROM r WHERE article IS NOT NULL AND c <> 'low')
SELECT 'matched_by_search' AS kind, topic, lang, w || ': "' || article || '" was matched by text search (' || c || ' confidence) — verify it is the topic, or pin a title with --articles ' || lang || '="<Title>"' AS text FROM u WHERE seen AND c <> 'high'
UNION ALL SELECT 'no_data', topic, lang, w || ': "' || article || '" has no pageview data in this period' FROM u WHERE NOT seen
UNION ALL SELECT 'disambiguation', topic, '', '"' || topic || '" is ambiguous: Wikipedia''s "' || p_brand || '" is a disambiguation page, so nothing was analysed. Re-run with the specific English title you mean, e.g. ' || hits || '.' FROM r WHERE i = 0
UNION ALL SELECT 'title-mismatch', topic, '', '"' || topic || '" has no Wikipedia article of its own: the closest is "' || p_brand || '", a different subject, so it was excluded. Tell the user there is no article for "' || topic || '"; only if they agree, analyse "' || p_brand || '" as a clearly labelled proxy (--topic "' || p_brand || '").' FROM r WHERE i = 1
UNION ALL SELECT 'excluded', topic, '', 'excluded ' || topic || '@' || lang || ': no article on this topic in those editions (Wikipedia cannot measure interest there; not proof of low demand).' FROM r WHERE (article IS NULL AND i <> 0) OR (article IS NOT NULL AND c = 'low' AND i <> 1)""",
    "tool_calls": """
WITH l AS (SELECT conv_id AS run, turn, role, length(text) AS n FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY run ORDER BY turn) AS call FROM l),
e AS (SELECT run, call, arg_max('Exit ' || n, turn) AS error FROM c WHERE role = 'user' AND n % 2 = 0 GROUP BY ALL)
SELECT run, call::BIGINT AS call, CASE WHEN turn % 4 = 1 THEN 'Bash' ELSE 'Read' END AS tool, 't' || turn AS id, 'make report --n ' || turn AS input, coalesce(error, '') AS error
FROM c LEFT JOIN e USING (run, call) WHERE role = 'assistant'""",
    "tool_results": """
WITH l AS (SELECT conv_id AS run, turn, role, length(text) AS n FROM conversations WHERE text IS NOT NULL)
SELECT a.run, 't' || a.turn AS id, coalesce('Exit ' || b.n, '') AS result FROM l a LEFT JOIN l b ON b.run = a.run AND b.turn = a.turn + 1 AND b.role = 'user' WHERE a.role = 'assistant'""",
    "transcript_summaries": """
WITH l AS (SELECT conv_id AS run, turn, role, length(text) AS n FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY run ORDER BY turn) AS call FROM l)
SELECT run, CASE WHEN bool_or(role = 'assistant') THEN 'm1' ELSE '' END AS models, count(*) FILTER (role = 'assistant') AS tool_calls, count(DISTINCT CASE WHEN role = 'user' AND n % 2 = 0 AND call > 0 THEN call END) AS failed_calls
FROM c GROUP BY run""",
    "benchmark_summary": """
WITH e AS (SELECT event_type || '-' || user_id % 7 AS eval, user_id % 2 = 0 AS w, user_id, value FROM events WHERE value IS NOT NULL),
r AS (
  SELECT eval, w, sum((value > 50)::INT) AS passed, count(*) AS total, max(value) AS seconds, count(DISTINCT user_id)::DOUBLE AS tokens, CASE WHEN count(*) % 5 > 0 THEN min(value) END AS calls
  FROM e GROUP BY ALL HAVING eval NOT LIKE '%-6' OR w),
k AS (SELECT *, passed::DOUBLE / total AS rate FROM r WHERE NOT w OR eval IN (SELECT eval FROM r WHERE NOT w)),
s AS (
  SELECT w, sum(passed)::BIGINT || '/' || sum(total)::BIGINT AS assertions, count(*) AS runs, """
    + ", ".join(f"floor(avg({c}) * 100 + 0.5) / 100 AS {n}_mean, floor(stddev_pop({c}) * 100 + 0.5) / 100 AS {n}_stddev" for c, n in (("rate", "pass_rate"), ("seconds", "seconds"), ("tokens", "tokens"), ("calls", "calls")))
    + """ FROM k GROUP BY w)
SELECT a.* EXCLUDE (w), """
    + ", ".join(f"b.{c} AS base_{c}" for c in ("assertions", "runs", *(f"{n}_{x}" for n in ("pass_rate", "seconds", "tokens", "calls") for x in ("mean", "stddev"))))
    + ", "
    + ", ".join(f"floor((a.{n}_mean - b.{n}_mean) * 100 + 0.5) / 100 AS {n}_delta" for n in ("pass_rate", "seconds", "tokens", "calls"))
    + " FROM s a, s b WHERE a.w AND NOT b.w",
    "trust_percentages": "SELECT c_custkey AS doc_id, 1 AS pos, 'trust high (' || (c_custkey % 100) || '%' AS said FROM customer WHERE c_custkey % 4 = 0",
    "language_problems": "SELECT p_partkey, 'tool_terms' AS kind, [ 'flat', 'Views'][p_size % 3 + 1] AS words FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 < 2",
}

_WIRE = "SELECT 'x' || c_nationkey AS lang, o_orderdate AS d, floor(o_totalprice)::BIGINT AS v, 'Order ' || o_orderpriority AS article FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"
_TERMS = list(label_checks.UKRAINIAN_TERMS.items())
ORACLE_SQL |= {
    "wire_views": f"""
WITH w AS ({_WIRE})
SELECT article, strftime(d, '%Y-%m') AS month, sum(v)::BIGINT AS views FROM w WHERE lang = 'x3' AND article IN ('Order 1-URGENT', 'Order 5-LOW') AND strftime(d, '%Y-%m') BETWEEN '1995-03' AND '1997-11' GROUP BY ALL""",
    "edition_views": f"WITH w AS ({_WIRE}) SELECT lang, strftime(d, '%Y-%m') AS month, sum(v)::BIGINT AS views FROM w GROUP BY ALL",
    "readers_notes": f"""
WITH r(lang, said) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in resolve.READERS.items())}),
l AS (SELECT n_nationkey AS k, unnest([{NATION_LANGS}[n_nationkey + 1], {NATION_LANGS}[n_nationkey * 7 % 25 + 1], CASE WHEN n_nationkey % 3 = 0 THEN 'en' ELSE 'zz' END]) AS lang, unnest([1, 2, 3]) AS i FROM nation),
n AS (SELECT k, string_agg(lang || ': ' || said, '; ' ORDER BY i) AS s FROM l JOIN r USING (lang) GROUP BY k)
SELECT n_nationkey, coalesce('Editions are not countries — ' || s || '. If the user asked about a country, say whose readers each edition mostly measures.', '') AS note FROM nation LEFT JOIN n ON k = n_nationkey""",
    "term_hints": f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 17 AS a, p_partkey % 5 AS b FROM part)
SELECT k AS p_partkey, CASE WHEN k % 4 = 0 THEN '' ELSE {[f'{a} → {b}' for a, b in _TERMS]}[a + 1] || CASE WHEN a = b THEN '' ELSE ', ' || {[f'{a} → {b}' for a, b in _TERMS]}[b + 1] END END AS hints FROM p""",
    "ukrainian_problems": rf"""
WITH r AS (SELECT c_custkey, {PHRASES}[c_custkey % 10 + 1] || '. ' || {PHRASES}[c_custkey * 7 % 10 + 1] || '.' AS raw FROM customer),
t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN replace(raw, 'keyword', ' ') ELSE raw END AS t FROM r),
k AS (
  SELECT c_custkey, 'share_calque' AS kind, regexp_extract_all(t, '(?i)(?:^|[^\p{{L}}])(дол[яіюе]) переглядів', 1) AS w FROM t
  UNION ALL SELECT c_custkey, 'speech_calque', list_concat(regexp_extract_all(t, '(на \p{{L}}+ькій мові)', 1), regexp_extract_all(t, '(на \p{{L}}+ькому),', 1)) FROM t
  UNION ALL SELECT c_custkey, 'article_calque', regexp_extract_all(t, '(артикл\p{{L}}*)', 1) FROM t
  UNION ALL SELECT c_custkey, 'russian_words', list_concat(regexp_extract_all(t, '(Эта)', 1), regexp_extract_all(t, '(растет)', 1)) FROM t
  UNION ALL SELECT c_custkey, 'latin_site_name', regexp_extract_all(t, '(Wikipedia)', 1) FROM t
  UNION ALL SELECT c_custkey, 'latin_words', list_filter(regexp_extract_all(t, '(?:^|[^A-Za-z])([a-z]+)', 1), lambda w: w <> 'flat') FROM t
  UNION ALL SELECT c_custkey, 'tool_terms', regexp_extract_all(t, '(flat|YoY)', 1) FROM t)
SELECT c_custkey, kind, array_to_string(list_distinct_in_order, '|') AS words
FROM (SELECT c_custkey, kind, list_reduce(list_transform(w, lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_in_order FROM k WHERE len(w) > 0)""",
    "report_texts": r"""
WITH d AS (SELECT doc_id, doc_id AS k, n_chars, regexp_replace(coalesce(text, ''), '[|\t\n\x0B\f\r ]+', ' ', 'g') AS f FROM documents),
p AS (
  SELECT *, substr(f, 1, k % 120) AS title, CASE WHEN k % 3 > 0 THEN substr(f, 5, 300) END AS verdict, list_filter(list_transform(range(1, k % 8 + 2), lambda i: trim(substr(f, i, k * 37 % 400))), lambda x: x <> '') AS fs,
         list_filter(['a', trim(substr(f, 3, 250))], lambda x: x <> '') AS cs FROM d),
q AS (
  SELECT *, fs[1:5] AS f5, list_filter(list_concat([CASE WHEN len(fs) > 5 THEN len(fs) || ' findings given (max 5) — kept the first 5' END],
    list_transform(fs[1:5], lambda x, i: CASE WHEN length(x) > 280 THEN 'finding ' || i || ' is ' || length(x) || ' chars (max 280) — shortened with "…"; rewrite it shorter' END),
    [CASE WHEN length(title) > 90 THEN '--title is ' || length(title) || ' chars (max 90) — shortened with "…"; rewrite it shorter' END, CASE WHEN length(verdict) > 240 THEN '--verdict is ' || length(verdict) || ' chars (max 240) — shortened with "…"; rewrite it shorter' END],
    list_transform(cs, lambda x, i: CASE WHEN length(x) > 200 THEN 'caveat ' || i || ' is ' || length(x) || ' chars (max 200) — shortened with "…"; rewrite it shorter' END)), lambda x: x IS NOT NULL) AS problems,
    (n_chars::DOUBLE * n_chars * 7) AS v FROM p),
u AS (SELECT *, CASE WHEN floor(v * 10 + 0.5) / 10 < 1000 THEN 0 WHEN floor(v / 1e3 * 10 + 0.5) / 10 < 1000 THEN 1 WHEN floor(v / 1e6 * 10 + 0.5) / 10 < 1000 THEN 2 ELSE 3 END AS w FROM q),
n AS (SELECT *, regexp_replace(printf('%.1f', floor(v / pow(1000.0, w) * 10 + 0.5) / 10), '\.0$', '') AS t FROM u)
SELECT doc_id, least(length(title), 90)::INT AS n_title, (CASE WHEN verdict IS NULL THEN -1 ELSE least(length(verdict), 240) END)::INT AS n_verdict, coalesce(list_sum(list_transform(f5, lambda x: least(length(x), 280))), 0)::INT AS n_findings,
       coalesce(list_sum(list_transform(cs, lambda x: least(length(x), 200))), 0)::INT AS n_caveats, array_to_string(problems, ' / ') AS problems, t || ['', 'K', 'M', 'B'][w + 1] AS views_en,
       replace(t, '.', ',') || ['', chr(160) || 'тис.', chr(160) || 'млн', chr(160) || 'млрд'][w + 1] AS views_uk FROM n""",
    "script_choices": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, list_sort(list_distinct(regexp_extract_all(t, '[^\x{21}-\x{7E}\x{A1}-\x{24F}\x{2010}-\x{2027}\x{20AC}\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))) AS lacks FROM t)
SELECT doc_id, array_to_string(lacks, '') AS offending,
       CASE WHEN regexp_matches(t, '[\x{590}-\x{DFF}\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') THEN 'none' WHEN len(lacks) = 0 THEN 'base'
            WHEN NOT regexp_matches(array_to_string(lacks, ''), '[^\x{370}-\x{52F}]') THEN 'fallback' ELSE 'none' END AS choice FROM o""",
    "label_places": """
WITH r AS (SELECT c_nationkey, c_mktsegment, c_custkey, floor(c_acctbal / 20) AS y FROM customer),
l AS (SELECT c_nationkey, c_mktsegment, list(c_custkey ORDER BY y, c_custkey) AS ks, list(y ORDER BY y, c_custkey) AS ys FROM r GROUP BY ALL),
d AS (SELECT *, list_reduce(list_transform(ys, lambda y: [y]), lambda a, y: list_append(a, greatest(y[1], a[-1] + 13))) AS down FROM l),
u AS (SELECT *, list_reduce(list_transform(list_prepend(507.0::DOUBLE, list_reverse(down)), lambda y: [y]), lambda a, y: list_append(a, least(y[1], a[-1] - 13))) AS up FROM d)
SELECT c_nationkey, c_mktsegment, unnest(ks) AS c_custkey, unnest(ys) AS y, unnest(list_reverse(up[2:])) AS label_y FROM u""",
    "incremental_metrics": """
WITH m AS (SELECT event_type, date_trunc('month', ts) AS month, count(*) AS views FROM events GROUP BY ALL)
SELECT event_type, count(*) AS months, sum(views)::BIGINT AS views, arg_max(views, month) AS last_views FROM m GROUP BY 1""",
    "turn_checks": """
WITH l AS (SELECT conv_id AS run, turn AS line, role = 'assistant' AS a, length(text) AS n FROM conversations WHERE text IS NOT NULL AND role <> 'system'),
o AS (SELECT *, NOT a AND (n % 4 = 0 OR row_number() OVER (PARTITION BY run, a ORDER BY line) = 1) AS opens FROM l),
t AS (SELECT *, sum(opens::INT) OVER (PARTITION BY run ORDER BY line)::BIGINT AS turn, lag(a) OVER (PARTITION BY run ORDER BY line) AND lag(line) OVER (PARTITION BY run ORDER BY line) = line - 1 AS after FROM o),
files AS (SELECT run, turn, n % 3 AS f, min(line) AS line FROM t WHERE NOT a AND turn > 0 GROUP BY ALL),
firsts AS (SELECT run, f, min(turn) AS turn, arg_min(line, turn) AS line FROM files GROUP BY ALL),
g AS (
  SELECT run, turn, any_value(CASE WHEN n % 4 = 0 THEN 'again ' ELSE 'so ' END || n ORDER BY line) FILTER (opens) AS prompt, count(*) FILTER (a) AS tool_calls,
         coalesce(arg_max('handed ' || n, line) FILTER (a AND n % 7 = 0), arg_min('answer ' || n, line) FILTER (a), '') AS answer,
         coalesce(string_agg('make report ' || line - 1 || ':' || (n % 2 = 0)::VARCHAR || ':' || n % 5, ',' ORDER BY line) FILTER (NOT a AND after), '') AS reports
  FROM t WHERE turn > 0 GROUP BY ALL)
SELECT run, turn, prompt, answer, tool_calls, reports,
       (SELECT string_agg('out/' || f || '/analysis.json', ',' ORDER BY line) FROM files WHERE files.run = g.run AND files.turn = g.turn) AS analyses,
       (SELECT string_agg('out/' || f || '/analysis.json', ',' ORDER BY line) FROM firsts WHERE firsts.run = g.run AND firsts.turn <= g.turn) AS known
FROM g""",
    "redirected_titles": """
WITH RECURSIVE r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 40 THEN p_partkey - 5 WHEN p_partkey % 9 > 0 THEN p_partkey + 1 END AS t FROM part),
walk AS (SELECT k, t AS page, 1 AS n FROM r WHERE t IS NOT NULL UNION ALL SELECT walk.k, r.t, n + 1 FROM walk JOIN r ON r.k = walk.page WHERE r.t IS NOT NULL AND n < 64)
SELECT 'p' || k AS title, 'p' || page AS target FROM walk WHERE page NOT IN (SELECT k FROM r WHERE t IS NOT NULL)""",
    "analysis_documents": _TEXTS
    + f""",
s AS (
  SELECT topic, lang, floor((greatest(-50, least(coalesce(relative_growth, robust_growth, trend_annual, 0), 200)) + 50) * (trust / 100.0::DOUBLE) + log10(coalesce(per_million, 0) + 1) * 10 + 0.5)::DOUBLE AS score,
         verdict || ' (' || basis || '), trust ' || {_LABEL} || ', ' || {_VIEWS} AS why FROM z JOIN words USING (topic, lang)),
c AS (SELECT topic, lang, count(*)::INT AS n FROM pts GROUP BY ALL)
SELECT topic AS run, 'series' AS part, (row_number() OVER (PARTITION BY topic ORDER BY lang) - 1)::INT AS position, lang AS name, verdict AS said, relative_growth AS value, n FROM z JOIN c USING (topic, lang)
UNION ALL SELECT topic, 'ranking', (row_number() OVER (PARTITION BY topic ORDER BY score DESC, lang) - 1)::INT, lang, why, score, 0 FROM s""",
    "topic_resolution": """
WITH p AS (
  SELECT p_type AS query, p_partkey AS k, p_size, right(p_brand, 1) AS b FROM part),
h AS (
  SELECT list_extract(['en', 'uk', 'de', 'fr', 'es', 'pl', 'it', 'pt', 'nl', 'sv'], b::INT + 1) AS lang, query, k, CASE WHEN k % 7 = 0 THEN 'other' ELSE query END || ' (' || k || ')' AS title,
         row_number() OVER (PARTITION BY b, query ORDER BY p_size, k) AS rank FROM p WHERE b BETWEEN '0' AND '9'),
best AS (SELECT lang, query, title, k FROM h WHERE rank = 1),
a AS (
  SELECT t.query AS topic, best.title AS anchor, CASE WHEN best.k % 11 = 0 THEN 'disambiguation' WHEN best.k % 7 = 0 THEN 'title-mismatch' END AS issue
  FROM (SELECT DISTINCT query FROM p) t LEFT JOIN best ON best.query = t.query AND best.lang = 'en'),
r AS (
  SELECT a.*, l.lang, best.title AS own, CASE WHEN l.lang = 'en' THEN anchor WHEN anchor IS NOT NULL AND best.k % 3 = 0 THEN best.title END AS link, best.k % 3 = 1 AND anchor IS NOT NULL AND l.lang <> 'en' AS back
  FROM a CROSS JOIN (VALUES ('en'), ('uk'), ('de'), ('fr')) l(lang) LEFT JOIN best ON best.query = a.topic AND best.lang = l.lang),
m AS (SELECT *, CASE WHEN issue = 'disambiguation' THEN 'none' WHEN link IS NOT NULL THEN 'langlink' WHEN own IS NOT NULL THEN 'search' ELSE 'none' END AS method FROM r)
SELECT topic, lang, 'en' AS source, anchor, issue, CASE method WHEN 'langlink' THEN link WHEN 'search' THEN own END AS article, method,
       CASE method WHEN 'langlink' THEN CASE WHEN issue = 'title-mismatch' THEN 'low' ELSE 'high' END WHEN 'search' THEN CASE WHEN lang = 'en' THEN 'medium' WHEN back AND issue IS NULL THEN 'high' ELSE 'low' END ELSE 'low' END AS confidence
FROM m""",
}
