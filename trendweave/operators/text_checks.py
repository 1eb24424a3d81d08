"""Checks of written statements against computed numbers, as expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import nearest

# Separators, units and patterns of numbers in prose, and the constants that explanations may use.
SPACE = r"[\s  ]"
YEAR_RANGE = rf"(?<![\d.])(?:19|20)\d{{2}}{SPACE}?[-–—−]{SPACE}?(?:(?:19|20)\d{{2}}|\d{{2}})(?:-\d{{2}})?(?![\d%])"
YEAR = r"(?<![\d.,])(?:19|20)\d{2}(?![\d%])"
UNIT_RANGE = rf"(?iu)(\d){SPACE}?[-–—]{SPACE}?(\d+(?:[.,]\d+)?){SPACE}?(%|pp\b|п\.{SPACE}?п\.)"
RANGE = rf"(\d){SPACE}?[-–—]{SPACE}?(?=\d)"
UNITS = rf"%|pp\b|п\.{SPACE}?п\.|k\b|тис\.?|m\b|млн"
RATIO = rf"{SPACE}?(?:×|x(?!\p{{L}})|times(?!\p{{L}})|-fold|-кратн|раз(?:и|ів|а)?(?!\p{{L}}))"
NUMBER = rf"([-+−–]?)(\d{{1,3}}(?:[   ,]\d{{3}})+|\d+)(?:[.,](\d+))?{SPACE}?({UNITS})?({RATIO})?"
KNOWN_PERCENT = [10.0, 15.0, 30.0, 40.0]
KNOWN_NUMBERS = [100.0, 2.5, 40.0, 70.0, 300.0, 1000.0]
KNOWN_RATIOS = [2.5, 20.0]
SENTENCE_END = rf"(?<=[.!?;]){SPACE}+|\n+|[|]"


def _number(parts: Column) -> Column:
    """Struct of a number from its match and the parts of it: sign, whole, part, unit, times."""
    at = lambda i: F.get(parts, F.lit(i))
    digits = F.concat(F.translate(at(2), " \u00a0\u202f,", ""), F.when(at(3) != "", F.concat(F.lit("."), at(3))).otherwise(""))
    return F.struct(at(0).alias("m"), at(1).alias("sign"), at(3).alias("part"), F.lower(F.translate(at(4), ".", "")).alias("_unit"), at(5).alias("times"), digits.try_cast("double").alias("_base"))


def claims(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per number stated in a text: id, _row, pos, raw, value, signed, percent, ratio.

    Years, ranges of years and dates are no claims, nor are whole numbers up to 12 without a unit or "1M" as a
    unit.  Null and empty texts state nothing.  _row tells rows of a repeated id apart; pos is the place in the text.

    Long stretches without a digit are cut first, and a number is found once, as a whole; its parts are taken from
    the short match by one pattern, before the rows are made, so that no filter repeats a pattern.
    """
    t = F.regexp_replace(F.col(text_col), "([^0-9]{16})[^0-9]+([^0-9]{4})", "$1 $2")
    t = F.regexp_replace(t, YEAR_RANGE, " ")
    t = F.regexp_replace(t, YEAR, " ")
    t = F.regexp_replace(t, UNIT_RANGE, "$1$3 $2$3")
    t = F.regexp_replace(t, RANGE, "$1; ")
    d = docs.where(F.col(text_col).rlike("[0-9]")).select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), t.alias("_t"))
    cut = "\x01"
    whole = F.regexp_extract_all("_t", F.lit(rf"(?iu)(?<![\p{{L}}\d.,]){NUMBER}"), F.lit(0))
    parts = F.transform(whole, lambda m: F.split(F.regexp_replace(m, f"(?iu)^{NUMBER}$", cut.join(f"${i}" for i in range(6))), cut))
    d = d.select(id_col, "_row", F.posexplode(F.transform(parts, _number)).alias("pos", "_n")).select(id_col, "_row", "pos", "_n.*")
    times = F.when(F.col("_unit").isin("k", "тис"), 1e3).when(F.col("_unit").isin("m", "млн"), 1e6).otherwise(1.0)
    percent = F.col("_unit").startswith("pp") | F.col("_unit").startswith("п") | (F.col("_unit") == "%")
    ratio = ~percent & (times == 1.0) & (F.col("times") != "")
    minus = F.col("sign").isin("-", "−", "–")
    value = F.when(minus & ~ratio, -1.0).otherwise(1.0) * F.col("_base") * times
    d = d.withColumns({"_x": times, "percent": percent, "ratio": ratio, "value": value})
    small = ~F.col("percent") & ~F.col("ratio") & (F.col("_x") == 1.0) & (F.col("part") == "") & (F.abs("value") <= 12)
    unit_only = (F.col("_x") == 1e6) & (F.col("_base") == 1.0)
    plain = F.expr("trim(substring(m, 1, length(m) - length(times)))")
    raw = F.when(F.col("ratio"), F.concat(plain, F.lit("×"))).otherwise(plain)
    return d.where(F.col("_base").isNotNull() & ~small & ~unit_only).select(id_col, "_row", "pos", raw.alias("raw"), "value", (~F.col("ratio") & (F.col("sign") != "")).alias("signed"), "percent", "ratio")


def tolerance(known: Column, percent: Column) -> Column:
    k = F.abs(known)
    return F.when(k >= 100, k * 0.025).when(percent | (k >= 10), 0.55).otherwise(F.greatest(F.lit(0.05), k * 0.02))


def allowed(value: Column, signed: Column, percent: Column) -> Column:
    """Whether a number is one of the constants that explanations may use."""
    near = lambda k: F.abs(F.abs(value) - k) <= tolerance(k, percent)
    listed = lambda xs: F.exists(F.array(*map(F.lit, xs)), near)
    return (~signed | (value >= 0)) & F.when(percent, listed(KNOWN_PERCENT)).otherwise(listed(KNOWN_NUMBERS))


def known_numbers(metrics: DataFrame, ranking: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, percent, known): every number of an analysis a text may state, once each; keys: what tells analyses apart."""
    keys = keys or []
    pct = [F.col(c).cast("double") for c in ("yoy", "robust_growth", "relative_growth", "edition_growth", "trend_annual")] + [F.col(c) * 100 for c in ("bot_share", "spike_share", "completeness")]
    num = [F.col(c).cast("double") for c in ("r2", "avg_last12", "total_last12", "per_million", "trust", "months", "peak_views")]
    points = F.concat(F.transform("points", lambda p: p["views"]), F.coalesce(F.transform("per_million_points", lambda p: p["per_million"]), F.array().cast("array<double>")))
    held = lambda percent, x: F.transform(x, lambda k: F.struct(F.lit(percent).alias("percent"), k.alias("known")))
    every = F.concat(held(True, F.array(*pct)), held(False, F.concat(F.array(*num), points)))
    all_ = metrics.select(*keys, F.explode(every).alias("_k")).select(*keys, "_k.*")
    if ranking is not None:
        all_ = all_.unionByName(ranking.select(*keys, F.lit(False).alias("percent"), F.col("score").cast("double").alias("known")))
    return all_.where("known is not null").distinct()


REACH = [(0.0, 11.0), (9.0, 101.0), (97.0, float("inf"))]  # of the known numbers below 10, below 100 and above: the values they may be near


def verified(stated: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The distinct (keys, value, signed, percent) of plain claims that a known number of their pool is near.

    How near counts grows with the known number, by one rule below 10, one below 100 and one above.  Under each rule, of
    the numbers of a sign, only the nearest at or below and the nearest at or above a claim can be near enough,
    so these two are looked up, for each distinct claim once.
    """
    keys = keys or []
    size = lambda c: F.abs(F.col(c))
    side = lambda c, both: F.explode(F.when(both, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.signum(c).cast("int"))))
    pool = known.select(*keys, "percent", F.when(size("known") < 10, 0).when(size("known") < 100, 1).otherwise(2).alias("_rule"), side("known", F.col("known") == 0).alias("_side"), size("known").alias("_size"))
    asked = stated.where("not ratio").select(*keys, "value", "signed", "percent").distinct()
    rules = F.array_compact(F.array(*[F.when((size("value") >= a) & (size("value") < b), F.lit(i)) for i, (a, b) in enumerate(REACH)]))
    asked = asked.withColumn("_rule", F.explode(rules)).withColumn("_side", side("value", ~F.col("signed") | (F.col("value") == 0))).withColumn("_size", size("value"))
    found = nearest(asked, pool, [*keys, "percent", "_rule", "_side"], "_size")
    fits = (F.col("_size") - F.col("below") <= tolerance(F.col("below"), F.col("percent"))) | (F.col("above") - F.col("_size") <= tolerance(F.col("above"), F.col("percent")))
    return found.where(fits).select(*keys, "value", "signed", "percent").distinct()


def _reported(stated: DataFrame, fine: DataFrame, on: list[str], id_col: str) -> DataFrame:
    rows = stated.join(fine.withColumn("_fine", F.lit(True)), on, "left")
    wrong = ~F.coalesce("_fine", F.lit(False)) & ~F.col("ratio") & ~allowed(F.col("value"), F.col("signed"), F.col("percent"))
    odd = F.least(*[F.abs(F.col("value") - x) for x in KNOWN_RATIOS]) >= 0.01
    listed = lambda cond: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "raw")))), lambda x: x["raw"]))
    out = rows.groupBy("_row", id_col).agg(F.count("*").alias("checked"), listed(wrong).alias("unverified"), listed(F.col("ratio") & odd).alias("ratios"))
    return out.drop("_row")


def claim_report(stated: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Per row of the texts: numbers checked, distinct unverified ones and ratios in the order in which they appear.

    A ratio is only ever allowed by the list of known ratios, never by a known number.  Rows that state nothing do
    not appear; rows with a repeated id are reported one by one.
    """
    return _reported(stated, verified(stated, known), ["value", "signed", "percent"], id_col)


def draft_report(stated: DataFrame, cited: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """``claim_report`` of drafts that cite analyses: a number counts if it is in one of the draft's own analyses.

    cited: id, analysis; known: analysis, percent, known.  A draft that cites nothing may state the constants only.
    """
    links = cited.select(id_col, "analysis").where("analysis is not null").distinct()
    plain = stated.where("not ratio").select(id_col, "value", "signed", "percent", "ratio").distinct()
    pairs = plain.where(~allowed(F.col("value"), F.col("signed"), F.col("percent"))).join(links, id_col)
    near = verified(pairs, known, ["analysis"])
    fine = pairs.join(near, ["analysis", "value", "signed", "percent"], "left_semi").select(id_col, "value", "signed", "percent").distinct()
    return _reported(stated, fine, [id_col, "value", "signed", "percent"], id_col)


def sentences(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per sentence: id, pos, sentence; cut after . ! ? ; and white space, at line ends and bars."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), SENTENCE_END)).alias("pos", "sentence")).where("trim(sentence) <> ''")


def language_guess(text: Column) -> Column:
    """'uk' by its own letters, null for other Cyrillic, 'en' for ASCII, else null."""
    return F.when(text.rlike("(?iu)[іїєґ]"), "uk").when(text.rlike(r"\p{IsCyrillic}"), F.lit(None).cast("string")).when(~text.rlike(r"[^\x00-\x7F]"), "en")


def capped(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def masked(text: Column, names: Column) -> Column:
    """The text without placeholders, code spans, links, paths and proper names (longest first)."""
    t = F.regexp_replace(text, r"\{[a-z]+\}", " ")
    t = F.regexp_replace(t, r"`[^`]*`", " ")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"(?:[\w.-]*/)+[\w.-]+", " ")
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, t, lambda a, n: F.regexp_replace(a, F.concat(F.lit("(?iu)\\Q"), n, F.lit("\\E")), F.lit(" ")))


def slug(parts: Column) -> Column:
    """Output name of topics: joined, lower case, other characters as hyphens, at most 40 characters, else "analysis"."""
    s = F.regexp_replace(F.lower(F.concat_ws("_", parts)), r"[^\p{L}\p{N}]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40)
    return F.when(s == "", "analysis").otherwise(s)


def comma_list(text: Column) -> Column:
    """Distinct, trimmed, non-empty items of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda x: x != ""))


def is_lang_code(text: Column) -> Column:
    return text.rlike("^[a-z]{2,3}(-[a-z]{2,8})*$|^simple$")


def pinned(text: Column) -> Column:
    """Struct (lang, title) of "lang=Title", both trimmed; the title may hold further equals signs."""
    part = lambda i: F.trim(F.regexp_extract(text, "^([^=]+)=(.*)$", i))
    return F.struct(part(1).alias("lang"), part(2).alias("title"))
