"""Metrics of monthly series: gap filling, growth, trend, spikes, level shifts, shares, trust, verdict, ranking.

One shuffle brings a series' months together (at most 135 of them); everything after that is expressions on its
arrays: no further shuffle, but higher-order functions are interpreted, not compiled.  Edition totals are one row per edition and meet the series in an equi-join.

Months are indexes (12 * year + month - 1).  A null measure means "not computable".  Of several rows of a month
the one with the greatest ``ordinal`` counts, or the greatest views where there is no such column; all count as
records for completeness.  Series without a row in ``user`` do not appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes
from ..functions.numbers import fixed_text, let, local_number, mean, median, month_text, number_text, pct_change, round_half_up, signed_percent, tail, total
from .ordering import numbered

KEY = ["topic", "lang"]
# Windows, thresholds and penalties of the metrics.
BAND = 10.0
SPIKE_FACTOR, SPIKE_WINDOW = 2.5, 6
SHIFT_RATIO, SHIFT_LEVEL, SHIFT_MONTHS = 20.0, 100.0, 8
TREND_MONTHS = 6
CLAMP = (-50.0, 200.0)


def _by_month(views: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per key: map month -> views, number of records, first and last month."""
    order = F.col("ordinal") if "ordinal" in views.columns else F.col("views")
    months = views.where("month is not null").groupBy(*keys, "month").agg(F.max_by("views", order).cast("double").alias("v"), F.count("*").alias("n"))
    entry = F.struct("month", F.coalesce("v", F.lit(0.0)).alias("v"))
    return months.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name), F.sum("n").alias(f"{name}_records"), F.min("month").alias(f"{name}_first"), F.max("month").alias(f"{name}_last"))


def densify(user: DataFrame, keys: list[str] = KEY, end: int | None = None) -> DataFrame:
    """One row per series: observed, first, months (array) and views (array), without gaps from the first month to the last or ``end``."""
    got = _by_month(user, keys, "m")
    last = F.greatest(F.col("m_last"), F.lit(end).cast("int")) if end is not None else F.col("m_last")
    months = F.sequence("m_first", last)
    return got.select(*keys, F.col("m_records").alias("observed"), F.col("m_first").alias("first"), months.alias("months"), F.transform(months, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("views"))


def points(dense: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Long form: one row per month."""
    return dense.select(*keys, F.explode(F.arrays_zip("months", "views")).alias("p")).select(*keys, month_text(F.col("p.months")).alias("month"), F.col("p.views").alias("views"))


def spike_flags(v: Column, factor: float = SPIKE_FACTOR, window: int = SPIKE_WINDOW) -> Column:
    """For each month whether it exceeds factor times the median of up to ``window`` neighbours on each side."""

    def flag(x, i):
        low = F.greatest(i - window, F.lit(0))
        near = F.concat(F.slice(v, low + 1, i - low), F.slice(v, i + 2, F.lit(window)))
        return let(median(near), lambda m: (m > 0) & (x > m * factor))

    return F.transform(v, flag)


def level_shift(months: Column, v: Column) -> Column:
    """Struct (month, from, to) of an abrupt and lasting jump, else null."""
    n = F.size(v)

    def shift(m):
        limit = F.greatest(m["old"] * 5, F.lit(1.0))
        jumps = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(v, i) > limit) & (median(F.slice(v, i + 1, n - i)) > limit))
        at = F.coalesce(F.get(jumps, F.lit(0)), F.lit(0))
        calm = (n < SHIFT_MONTHS) | (m["now"] < SHIFT_LEVEL) | ((m["old"] > 0) & (m["now"] / m["old"] <= SHIFT_RATIO))
        return F.when(~calm, F.struct(month_text(F.get(months, at)).alias("month"), F.floor(m["old"] + 0.5).alias("from"), F.floor(m["now"] + 0.5).alias("to")))

    halves = F.struct(median(F.slice(v, 1, F.shiftright(n, 1))).alias("old"), median(tail(v, 3)).alias("now"))
    return let(halves, shift)


def trend(v: Column) -> Column:
    """Struct (annual, r2) of the log-linear fit; null below six months; r2 is 0 for a constant series."""
    n = F.size(v)
    mx = (n - 1) / 2.0

    def fit(y, my):
        sxy = total(F.transform(y, lambda a, i: (i - mx) * (a - my)))
        sxx = n * (n * n - 1.0) / 12
        sst = total(F.transform(y, lambda a: (a - my) * (a - my)))
        flat = F.array_min(y) == F.array_max(y)
        return let(F.struct(sxy.alias("xy"), sxx.alias("xx"), sst.alias("yy"), flat.alias("flat")), lambda s: F.struct(((F.exp(s["xy"] / s["xx"] * 12) - 1) * 100).alias("annual"), F.when(s["flat"], 0.0).otherwise(s["xy"] * s["xy"] / (s["xx"] * s["yy"])).alias("r2")))

    logs = F.transform(v, lambda x: F.ln(F.greatest(x, F.lit(1.0))))
    return F.when(n >= TREND_MONTHS, let(logs, lambda y: let(mean(y), lambda my: fit(y, my))))


def yearly(v: Column, change) -> Column:
    """change(last 12 values, the 12 before); null below 24 values."""
    return F.when(F.size(v) >= 24, change(tail(v, 12), tail(v, 12, 12)))


def _note(when: Column, points_: int, key: str, **variables: Column) -> Column:
    pairs = [x for k, c in variables.items() for x in (F.lit(k), c.cast("string"))]
    held = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(when, F.struct(F.lit(key).alias("key"), held.alias("vars"), F.lit(points_).alias("points")))


def _first(*branches: Column) -> Column:
    return F.coalesce(*branches)


def trust_label(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def _signed(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.when(x > 0, "+").otherwise(""), F.format_string("%.0f", x), F.lit("%")))


def _trust(match: Column) -> Column:
    """Notes with their penalties, in their fixed order."""
    c = F.col
    percent = lambda x: F.floor(x * 100 + 0.5)
    rows = [
        _note(c("level_shift").isNotNull(), 40, "levelShift", month=c("level_shift.month"), **{"from": c("level_shift.from"), "to": c("level_shift.to")}),
        _first(_note(match == "low", 50, "matchLow"), _note(match == "medium", 20, "matchMedium")),
        _note(c("late") >= 3, 10, "lateStart", months=c("late"), first=month_text(c("first"))),
        _first(_note(c("n") < 6, 60, "months6", months=c("n")), _note(c("n") < 12, 40, "months12", months=c("n")), _note(c("n") < 24, 15, "months24", months=c("n"))),
        _note(c("completeness_") < 0.95, 15, "gaps", pct=percent(c("completeness_"))),
        _first(_note(c("spike_share_") > 0.15, 25, "spikesMany", pct=percent(c("spike_share_"))), _note(c("spike_share_") > 0.05, 10, "spikesSome", pct=percent(c("spike_share_")))),
        _note((c("yoy_") > BAND) & (c("robust_") < 0), 20, "spikeDriven"),
        _first(*[_note(c("bot_") > share, p, key, pct=percent(c("bot_"))) for share, p, key in ((0.4, 35, "bots40"), (0.3, 25, "bots30"), (0.15, 10, "bots15"))]),
        _note(c("trend_.r2") < 0.2, 15, "noisy", rsq=F.format_string("%.2f", c("trend_.r2"))),
        _note(c("average_") < 300, 20, "lowVolume", n=F.floor(c("average_") + 0.5)),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def series_metrics(user: DataFrame, automated: DataFrame | None = None, editions: DataFrame | None = None, start: int | None = None, end: int | None = None, match: Column | None = None, lang: str = "en") -> DataFrame:
    """One row per series with every measure, trust and verdict; ``lang`` is the language of the notes.

    automated and editions may be missing: their measures are then null.  start, end: the requested months.
    match: confidence of the topic's resolution ("high", "medium", "low").
    """
    d = densify(user, KEY, end).withColumn("n", F.size("views"))
    empty_map = F.lit(None).cast("map<int,double>")
    if automated is not None:
        d = d.join(_by_month(automated, KEY, "bots").select(*KEY, "bots"), KEY, "left")
    else:
        d = d.withColumn("bots", empty_map)
    if editions is not None:
        totals = _by_month(editions, ["lang"], "totals").select("lang", "totals")
        ordered = F.transform(F.sort_array(F.map_entries("totals")), lambda e: e["value"])
        totals = totals.withColumn("edition_", yearly(ordered, lambda a, b: pct_change(median(a), median(b))))
        d = d.join(totals, "lang", "left")
    else:
        d = d.withColumn("totals", empty_map).withColumn("edition_", F.lit(None).cast("double"))
    v, months = F.col("views"), F.col("months")
    at = F.filter(F.arrays_zip(months, v), lambda p: F.try_element_at("totals", p["months"]).isNotNull())
    share = F.when(F.col("totals").isNotNull(), F.transform(at, lambda p: p["views"] / F.nullif(F.try_element_at("totals", p["months"]), F.lit(0.0)) * 1e6))
    d = d.withColumns(
        {
            "share_months": F.transform(at, lambda p: p["months"]),
            "share": share,
            "total_": total(tail(v, 12)),
            "average_": mean(tail(v, 12)),
            "completeness_": F.col("observed") / F.col("n"),
            "late": F.lit(None).cast("int") if start is None else F.greatest(F.col("first") - start, F.lit(0)),
            "yoy_": yearly(v, lambda a, b: pct_change(total(a), total(b))),
            "robust_": yearly(v, lambda a, b: pct_change(median(a), median(b))),
            "trend_": trend(v),
            "spike_flags": spike_flags(v),
            "peak": F.array_max(F.transform(v, lambda x, i: F.struct(x.alias("views"), (-i).alias("i")))),
            "level_shift": level_shift(months, v),
            "bot_views": F.when(F.col("bots").isNotNull(), total(F.transform(tail(months, 12), lambda i: F.coalesce(F.try_element_at("bots", i), F.lit(0.0))))),
        }
    ).withColumns(
        {
            "spike_share_": F.size(F.filter("spike_flags", lambda x: x)) / F.col("n"),
            "spikes": F.transform(F.filter(F.arrays_zip("months", "spike_flags"), lambda p: p["spike_flags"]), lambda p: month_text(p["months"])),
            "bot_": F.col("bot_views") / F.nullif(F.col("total_") + F.col("bot_views"), F.lit(0.0)),
            "per_million_": F.when(F.size("share") > 0, mean(tail(F.col("share"), 12))),
            "relative_": yearly(F.col("share"), lambda a, b: pct_change(median(a), median(b))),
        }
    )
    opposite = (F.abs("relative_") > BAND) & (F.abs("robust_") > BAND) & (F.signum("relative_") != F.signum("robust_"))
    d = d.withColumn("notes_", _trust(F.lit("high") if match is None else match))
    penalties = F.aggregate("notes_", F.lit(0), lambda a, x: a + x["points"])
    base = F.greatest(F.lit(0), F.lit(100) - penalties)
    score = F.when(opposite, F.greatest(F.lit(0), base - 10)).otherwise(base)
    shown = lambda x: F.coalesce(number_text(round_half_up(x)), F.lit("null"))
    extra = _note(opposite, 10, "rawVsRelative", raw=shown(F.col("robust_")), rel=shown(F.col("relative_")), ed=shown(F.col("edition_")))
    g = F.coalesce("relative_", "robust_", F.col("trend_.annual"))
    basis = _first(
        _note(g.isNull(), 0, "basisNone"),
        _note(F.col("relative_").isNotNull(), 0, "basisRelative", rel=_signed(F.col("relative_")), ed=F.coalesce(_signed(F.col("edition_")), F.lit("n/a")), raw=F.coalesce(_signed(F.col("robust_")), F.lit("n/a"))),
        _note(F.col("robust_").isNotNull(), 0, "basisMedian", raw=_signed(F.col("robust_"))),
        _note(g.isNotNull(), 0, "basisTrend", g=_signed(g)),
    )
    d = d.withColumns({"score_": score, "notes_": F.concat("notes_", F.filter(F.array(extra), lambda x: x.isNotNull())), "g": g, "basis_": basis})
    shifted = F.col("level_shift").isNotNull()
    verdict = F.when(shifted | F.col("g").isNull(), "insufficient-data").when(F.col("g") > BAND, "growing").when(F.col("g") < -BAND, "declining").otherwise("flat")
    shift_note = notes.fill(F.lit(notes.NOTES.get(lang, notes.NOTES["en"])["basisShift"]), F.create_map(F.lit("month"), F.col("level_shift.month"), F.lit("from"), F.col("level_shift.from").cast("string"), F.lit("to"), F.col("level_shift.to").cast("string")), lang)
    inner = notes.render(F.col("basis_"), lang)
    flat = notes.fill(F.lit(notes.NOTES.get(lang, notes.NOTES["en"])["flat"]), F.create_map(F.lit("g"), _signed(F.col("g")), F.lit("inner"), inner), lang)
    r = round_half_up
    return d.select(
        *KEY,
        F.col("n").alias("months"),
        r(F.col("completeness_"), 2).alias("completeness"),
        F.col("total_").cast("long").alias("total_last12"),
        F.floor(F.col("average_") + 0.5).alias("avg_last12"),
        r(F.col("per_million_")).alias("per_million"),
        r(F.col("yoy_")).alias("yoy"),
        r(F.col("robust_")).alias("robust_growth"),
        r(F.col("relative_")).alias("relative_growth"),
        r(F.col("edition_")).alias("edition_growth"),
        r(F.col("trend_.annual")).alias("trend_annual"),
        r(F.col("trend_.r2"), 2).alias("r2"),
        r(F.col("spike_share_"), 2).alias("spike_share"),
        "spikes",
        month_text(F.get("months", -F.col("peak.i"))).alias("peak_month"),
        F.col("peak.views").cast("long").alias("peak_views"),
        r(F.col("bot_"), 2).alias("bot_share"),
        "level_shift",
        F.col("score_").cast("int").alias("trust"),
        trust_label(F.col("score_")).alias("trust_label"),
        F.transform("notes_", lambda x: x["key"]).alias("note_keys"),
        F.transform("notes_", lambda x: notes.render(x, lang)).alias("reasons"),
        verdict.alias("verdict"),
        F.when(shifted, shift_note).when(verdict == "flat", flat).otherwise(inner).alias("basis"),
        F.arrays_zip(F.transform("months", month_text).alias("month"), F.col("views")).alias("points"),
        F.arrays_zip(F.transform("share_months", month_text).alias("month"), F.col("share").alias("per_million")).alias("per_million_points"),
    )


def ranking(metrics: DataFrame) -> DataFrame:
    """Score and why of every series; order by score descending, then by the input's order (here the key).

    Repeated rows are scored one by one.
    """
    g = F.coalesce("relative_growth", "robust_growth", "trend_annual", F.lit(0.0))
    clamped = F.greatest(F.lit(CLAMP[0]), F.least(g, F.lit(CLAMP[1])))
    score = (clamped + 50) * (F.col("trust") / 100.0) + F.log10(F.coalesce("per_million", F.lit(0.0)) + 1) * 10
    level = F.when(F.col("per_million").isNotNull(), F.concat(number_text(F.col("per_million")), F.lit(" views per 1M edition views"))).otherwise(F.concat(F.col("avg_last12").cast("string"), F.lit(" views/month")))
    why = F.concat(F.col("verdict"), F.lit(" ("), F.col("basis"), F.lit("), trust "), F.col("trust_label"), F.lit(", "), level)
    return metrics.select(*KEY, F.floor(score + 0.5).cast("long").alias("score"), why.alias("why"))


def places(ranked: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Adds ``place`` among all series: by score descending, equal ones in the order of ``ties`` (the key; or the input's own order, if a column holds it).

    Series of one score are split among tasks like any others: places come from counts of ranges of the whole order.
    """
    return numbered(ranked, [F.desc("score"), *[F.col(c) for c in ties or KEY]])


def summary_rows(metrics: DataFrame) -> DataFrame:
    """The short form of every series: verdict with its basis, growth figures, spikes and peak as texts."""
    return metrics.select(
        *KEY,
        F.concat("verdict", F.lit(" — "), "basis").alias("verdict"),
        "relative_growth", "robust_growth", "edition_growth", "yoy", "trend_annual", "r2",
        F.col("avg_last12").alias("human_views_per_month"),
        "per_million", "bot_share",
        F.when(F.size("spikes") > 0, F.concat_ws(", ", "spikes")).otherwise("none").alias("spike_months"),
        F.concat("peak_month", F.lit(": "), F.col("peak_views").cast("string")).alias("peak"),
        F.concat("trust_label", F.lit(" ("), F.col("trust").cast("string"), F.lit(")")).alias("trust"),
    )


def report_rows(metrics: DataFrame, normalized: bool = True, lang: str = "en") -> DataFrame:
    """The figures of a report's table as texts of a language; columns by whether views are set against their edition."""
    percent = lambda c: signed_percent(F.col(c), lang)
    views = local_number(F.col("avg_last12").cast("double"), 0, lang).alias("views")
    trust = F.concat_ws(" ", "trust_label", F.col("trust").cast("string")).alias("trust")
    if normalized:
        rate = F.when(F.col("per_million").isNull(), "—").otherwise(local_number(F.col("per_million"), 1, lang)).alias("per_million")
        return metrics.select(*KEY, views, rate, percent("relative_growth").alias("relative"), percent("robust_growth").alias("raw"), percent("edition_growth").alias("edition"), "verdict", trust)
    total12 = local_number(F.col("total_last12").cast("double"), 0, lang).alias("total")
    return metrics.select(*KEY, views, total12, percent("robust_growth").alias("raw"), percent("yoy").alias("yoy"), percent("trend_annual").alias("trend"), "verdict", trust)


def rebase(values: DataFrame, keys: list[str] = KEY, base: int | None = None) -> DataFrame:
    """Adds ``indexed``: views per series as percent of the median of all, or of the first ``base``, values; of the positive ones where that is 0."""
    v = F.col("views")
    start = v if base is None else F.slice(v, 1, base)
    positive = F.filter(v, lambda x: x > 0)
    m = F.when(median(start) > 0, median(start)).otherwise(median(positive))
    return values.withColumn("indexed", F.when(m > 0, F.transform(v, lambda x: x / m * 100)).otherwise(v))


def long_rows(metrics: DataFrame) -> DataFrame:
    """Export rows: topic, lang, month, views_user, views_per_million (two decimals as text, empty where missing)."""
    rates = F.map_from_entries(F.transform("per_million_points", lambda p: F.struct(p["month"], p["per_million"])))
    rate = F.try_element_at("_rates", F.col("p.month"))
    rows = metrics.withColumn("_rates", rates).select(*KEY, "_rates", F.explode("points").alias("p"))
    return rows.select(*KEY, F.col("p.month").alias("month"), F.col("p.views").cast("long").alias("views_user"), F.coalesce(fixed_text(rate, 2), F.lit("")).alias("views_per_million"))


def csv_lines(rows: DataFrame, name: Column, article: Column) -> DataFrame:
    """Lines of the export; name and article are quoted as JSON strings."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return rows.select(F.concat_ws(",", quoted(name), F.col("lang"), quoted(article), F.col("month"), F.col("views_user").cast("string"), F.col("views_per_million")).alias("line"))

