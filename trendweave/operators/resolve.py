"""Topic resolution: search hits, interlanguage links and back-links joined into one row per topic and language."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.durable import durable

# Words that do not count in a title comparison.
STOP_WORDS = ["the", "of", "a", "an", "and", "in", "on", "for", "to", "with", "de", "la", "le", "el"]


# Whose readers an edition mostly measures.
READERS = {
    "en": "readers worldwide",
    "de": "Germany, Austria, Switzerland",
    "fr": "France, Belgium, Switzerland, Canada, Francophone Africa",
    "it": "Italy, Switzerland",
    "es": "Spain, Latin America, the US",
    "pt": "Brazil, Portugal, Lusophone Africa",
    "nl": "the Netherlands, Flanders",
    "ru": "Russia, Belarus, Kazakhstan and other post-Soviet countries",
    "ar": "the Arab world",
    "sv": "Sweden, Finland",
    "zh": "Taiwan, Hong Kong, Singapore, Malaysia and the diaspora — Wikipedia is blocked in mainland China",
    "kk": "Kazakhstan, where many people read ru instead",
    "uk": "Ukraine, where many people also read ru or en",
    "sr": "Serbia, Bosnia, Montenegro",
    "ms": "Malaysia, Brunei",
    "rm": "Switzerland (Graubünden) — a very small edition",
}


def readers_note(langs: Column) -> Column:
    """The note on the readers of an array of editions, in its order; null if none of them is known."""
    known = F.filter(langs, lambda x: x.isin(list(READERS)))
    table = F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])
    listed = F.array_join(F.transform(known, lambda x: F.concat(x, F.lit(": "), F.element_at(table, x))), "; ")
    text = F.concat(F.lit("Editions are not countries — "), listed, F.lit(". If the user asked about a country, say whose readers each edition mostly measures."))
    return F.when(F.size(known) > 0, text)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition, no marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.category(c).startswith("M")))


def title_words(text: Column) -> Column:
    words = F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(w, "(es|s)$", ""))


def title_matches(topic: Column, title: Column) -> Column:
    """Whether every significant word of the topic is in the title."""
    return F.size(F.array_except(title_words(topic), title_words(title))) == 0


def looks_latin(topic: Column) -> Column:
    return ~topic.rlike(r"[^\x{0000}-\x{024F}\s\p{P}]")


def resolve(topics: DataFrame, langs: list[str], hits: DataFrame, links: DataFrame, props: DataFrame, explicit: DataFrame | None = None, source: str | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """One row per topic and language: source, anchor, issue, article, method, confidence, candidates.

    topics: (topic); explicit: (topic, lang, title) pins, with an optional column ``ordinal``.  A pinned title wins, then a
    link from the anchor, then the best local hit; a local hit is sure only if it links back to the anchor.
    redirects: (lang, title, target); links and properties are those of the page that a title leads to in the end, and
    the article of the source is that page's title, while titles are compared with the anchor as it was found.
    Nulls in any table match nothing; of several links of a place the least title counts, of several pins the last
    one, or the least without ``ordinal``.
    """
    spark = topics.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(langs)], "_order int, lang string")
    pins = (explicit if explicit is not None else spark.createDataFrame([], "topic string, lang string, title string"))
    told = F.max_by("title", "ordinal") if "ordinal" in pins.columns else F.min("title")
    pins = pins.where("title is not null").groupBy("topic", "lang").agg(told.alias("_pin"))
    pinned = pins.join(F.broadcast(wanted), "lang").groupBy("topic").agg(F.count("*").alias("_pinned"))
    own = F.lit(source) if source else F.when(looks_latin(F.col("topic")), "en").otherwise(langs[0])
    top = hits.where("rank <= 5").groupBy("lang", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("_h")).select("lang", "query", F.transform("_h", lambda h: h["title"]).alias("_hits"))
    t = topics.select("topic").distinct().withColumn("source", own).join(pinned, "topic", "left")
    t = t.join(top.select(F.col("lang").alias("source"), F.col("query").alias("topic"), "_hits"), ["source", "topic"], "left").withColumn("anchor", F.get("_hits", F.lit(0)))
    pages = canonical(redirects) if redirects is not None else spark.createDataFrame([], "lang string, title string, target string")
    t = t.join(pages.select(F.col("lang").alias("source"), F.col("title").alias("anchor"), F.col("target").alias("_page")), ["source", "anchor"], "left").withColumn("_page", F.coalesce("_page", "anchor"))
    marked = props.where("is_disambiguation").select(F.col("lang").alias("source"), F.col("title").alias("_page"), F.lit(True).alias("_many")).distinct()
    t = t.join(marked, ["source", "_page"], "left")
    unsure = F.col("anchor").isNotNull() & (F.coalesce("_pinned", F.lit(0)) < len(langs))
    t = t.withColumn("issue", F.when(unsure & F.col("_many"), "disambiguation").when(unsure & ~title_matches(F.col("topic"), F.col("anchor")), "title-mismatch"))
    others = F.when(F.size("_hits") > 1, F.slice("_hits", 2, 4)).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("_others", F.when(F.col("issue") == "title-mismatch", F.slice("_hits", 1, 5)).when(F.col("issue") == "disambiguation", others))
    forward = links.select(F.col("src_lang").alias("source"), F.col("src_title").alias("_page"), F.col("dst_lang").alias("lang"), F.col("dst_title").alias("_link")).groupBy("source", "_page", "lang").agg(F.min("_link").alias("_link"))
    self_link = t.select("source", "_page", F.col("source").alias("lang"), F.col("_page").alias("_link")).where("_page is not null").distinct()
    forward = forward.join(self_link, ["source", "_page", "lang"], "left_anti").unionByName(self_link)
    rows = t.crossJoin(F.broadcast(wanted)).join(pins, ["topic", "lang"], "left").join(forward, ["source", "_page", "lang"], "left")
    rows = rows.join(top.select("lang", F.col("query").alias("topic"), F.col("_hits").alias("_local")), ["lang", "topic"], "left").withColumn("_best", F.get("_local", F.lit(0)))
    rows = rows.join(pages.select("lang", F.col("title").alias("_best"), F.col("target").alias("_led")), ["lang", "_best"], "left").withColumn("_led", F.coalesce("_led", "_best"))
    back = links.select(F.col("src_lang").alias("lang"), F.col("src_title").alias("_led"), F.col("dst_lang").alias("source"), F.col("dst_title").alias("_back")).groupBy("lang", "_led", "source").agg(F.min("_back").alias("_back"))
    rows = rows.join(back, ["lang", "_led", "source"], "left")
    many, off = F.coalesce(F.col("issue") == "disambiguation", F.lit(False)), F.col("issue").isNotNull()
    method = F.when(F.col("_pin").isNotNull(), "explicit").when(many, "none").when(F.col("_link").isNotNull(), "langlink").when(F.col("_best").isNotNull(), "search").otherwise("none")
    linked = F.when(F.coalesce(F.col("issue") == "title-mismatch", F.lit(False)), "low").otherwise("high")
    local = F.when(F.col("lang") == F.col("source"), "medium").when((F.col("_back") == F.col("anchor")) & ~off, "high").otherwise("low")
    rest = F.when(F.size("_local") > 1, F.slice("_local", 2, 4)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("method", method).select(
        "topic", "lang", "source", "anchor", "issue",
        F.when(F.col("method") == "explicit", F.col("_pin")).when(F.col("method") == "langlink", F.col("_link")).when(F.col("method") == "search", F.col("_best")).alias("article"),
        "method",
        F.when(F.col("method") == "explicit", "high").when(F.col("method") == "langlink", linked).when(F.col("method") == "search", local).otherwise("low").alias("confidence"),
        F.when(F.col("method") == "search", rest).when((F.col("method") != "explicit") & off, F.col("_others")).alias("candidates"),
    )


def accepted(resolved: DataFrame, include_low: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to analyse, excluded rows with a reason)."""
    reason = F.when(F.col("article").isNull(), F.when(F.col("issue") == "disambiguation", "ambiguous title").otherwise("no article found"))
    if not include_low:
        reason = F.coalesce(reason, F.when(F.col("confidence") == "low", F.when(F.col("issue") == "title-mismatch", "different subject").otherwise("low confidence")))
    judged = resolved.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def unknown_pins(pins: DataFrame, langs: list[str]) -> DataFrame:
    """The pins (topic, lang, title) of languages that are not asked for."""
    return pins.where(~F.col("lang").isin(langs) | F.col("lang").isNull())


def canonical(redirects: DataFrame) -> DataFrame:
    """lang, title, target: where every redirect leads in the end; titles on a cycle, or leading into one, keep their own name and have no row.

    redirects: lang, title, target; of several targets the least counts.  Pointers double: after k rounds each knows the
    page 2**k steps on, so a chain takes as many rounds as its length has bits.  Once a round settles no title, those
    left over never end.
    """
    kept = redirects.where("lang is not null and title is not null and target is not null").groupBy("lang", "title").agg(F.min("target").alias("target"))
    held, before = durable(kept), None
    while True:
        on = held.select("lang", F.col("title").alias("target"), F.col("target").alias("_next"))
        step = durable(held.select("lang", "title", "target").join(on, ["lang", "target"], "left").select("lang", "title", F.coalesce("_next", "target").alias("target"), F.col("_next").isNull().alias("_ends")))
        left = step.where("not _ends").count()
        if left in (0, before):
            return step.where("_ends").drop("_ends")
        held, before = step, left


def exclusions(resolved: DataFrame, include_low: bool = False) -> DataFrame:
    """topic, lang, reason, search_hits of the rows that are not analysed, worded as reports show them."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    none = F.array().cast("array<string>")
    hits = F.coalesce("candidates", none)
    ambiguous, missing = F.col("article").isNull() & (F.col("issue") == "disambiguation"), F.col("article").isNull()
    low = F.lit(False) if include_low else F.col("confidence") == "low"
    other = low & (F.col("issue") == "title-mismatch")
    # The wording of the reasons.
    reason = (
        F.when(ambiguous, F.concat(quoted("topic"), F.lit(" is ambiguous (disambiguation page) — re-run with a specific English title")))
        .when(missing, "no article found")
        .when(other, F.concat(F.lit("no article titled "), quoted("topic"), F.lit(" — the closest is "), quoted("article"), F.lit(" (a different subject?)")))
        .when(low, "no article linked to the topic (text search only)")
    )
    shown = F.when(ambiguous, F.slice(hits, 1, 5)).when(missing, none).when(other, F.slice(F.coalesce("candidates", F.array("article")), 1, 5)).otherwise(F.slice(F.concat(F.array("article"), hits), 1, 4))
    return resolved.select("topic", "lang", reason.alias("reason"), shown.alias("search_hits")).where("reason is not null")


def warnings(resolved: DataFrame, viewed: DataFrame | None = None, include_low: bool = False) -> DataFrame:
    """kind, topic, lang, text: what a reader must know of rows that are analysed or left out.

    viewed: the (topic, lang) with views; analysed rows without any are told as "no_data".  Kinds of a topic have no lang.
    """
    used, out = accepted(resolved, include_low)
    used = used.withColumn("_where", F.concat_ws("@", "topic", "lang"))
    if viewed is not None:
        seen = viewed.select("topic", "lang").distinct()
        lost = used.join(seen, ["topic", "lang"], "left_anti")
        used = used.join(seen, ["topic", "lang"], "left_semi")
    # The wording of the warnings.
    by_search = used.where("confidence <> 'high'").select(
        F.lit("matched_by_search").alias("kind"), "topic", "lang",
        F.format_string('%s: "%s" was matched by text search (%s confidence) — verify it is the topic, or pin a title with --articles %s="<Title>"', "_where", "article", "confidence", "lang").alias("text"),
    )
    topics = resolved.where("issue is not null").groupBy("topic").agg(F.max("issue").alias("issue"), F.max("anchor").alias("anchor"), F.max("candidates").alias("_hits"))
    shown = F.array_join(F.transform(F.slice(F.coalesce("_hits", F.array().cast("array<string>")), 1, 3), lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", ")
    ambiguous = F.concat(F.format_string('"%s" is ambiguous: Wikipedia\'s "%s" is a disambiguation page, so nothing was analysed. Re-run with the specific English title you mean, e.g. ', "topic", "anchor"), shown, F.lit("."))
    other = F.format_string(
        '"%s" has no Wikipedia article of its own: the closest is "%s", a different subject, so it was excluded. Tell the user there is no article for "%s"; only if they agree, analyse "%s" as a clearly labelled proxy (--topic "%s").',
        "topic", "anchor", "topic", "anchor", "anchor",
    )
    of_topic = topics.select(F.col("issue").alias("kind"), "topic", F.lit(None).cast("string").alias("lang"), F.when(F.col("issue") == "disambiguation", ambiguous).otherwise(other).alias("text"))
    plain = out.where("reason in ('no article found', 'low confidence')").groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("@", "topic", "lang"))), ", ").alias("_list"))
    left_out = plain.select(
        F.lit("excluded").alias("kind"), "topic", F.lit(None).cast("string").alias("lang"),
        F.format_string("excluded %s: no article on this topic in those editions (Wikipedia cannot measure interest there; not proof of low demand).", "_list").alias("text"),
    )
    every = by_search.unionByName(of_topic).unionByName(left_out)
    if viewed is not None:
        every = every.unionByName(lost.select(F.lit("no_data").alias("kind"), "topic", "lang", F.format_string('%s: "%s" has no pageview data in this period', "_where", "article").alias("text")))
    return every


def series_names(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: "topic (lang)", the topic or the language, by how many topics and languages were asked for.

    asked: the (topic, lang) asked for, whether or not they are among the rows; without it the rows' own count.
    Repeated rows get one name.
    """
    counts = (rows if asked is None else asked).agg(F.count_distinct("topic").alias("_t"), F.count_distinct("lang").alias("_l"))  # one row
    name = F.when((F.col("_t") > 1) & (F.col("_l") > 1), F.format_string("%s (%s)", "topic", "lang")).when(F.col("_t") > 1, F.col("topic")).otherwise(F.col("lang"))
    return rows.crossJoin(F.broadcast(counts)).withColumn("name", name).drop("_t", "_l")


def ranked_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of each query."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "query").orderBy("rank", "title"))).where(F.col("_n") <= limit).drop("_n")
