"""Number helpers on columns and on arrays of doubles; halves round up, as floor(x * 10**d + 0.5) does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 1) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent; null where the base is not above zero."""
    return F.when(before > 0, (now - before) / before * 100)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Mean of an array; 0 for an empty one."""
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(0.0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def median(values: Column) -> Column:
    """Median of an array of doubles without nulls; 0 for an empty one."""

    def middle(s):
        n = F.size(s)
        return F.coalesce((F.get(s, F.shiftright(n - 1, 1)) + F.get(s, F.shiftright(n, 1))) / 2, F.lit(0.0))

    return let(F.sort_array(values), middle)


def tail(values: Column, length: int, skip: int = 0) -> Column:
    """The ``length`` values that end ``skip`` before the end; fewer where the array is shorter."""
    n = F.size(values)
    upto = F.greatest(n - skip, F.lit(0))
    start = F.greatest(upto - length, F.lit(0))
    return F.slice(values, start + 1, upto - start)


def month_text(index: Column) -> Column:
    """'YYYY-MM' of a month index (12 * year + month - 1)."""
    return F.concat(F.lpad((index / 12).cast("int").cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("string"), 2, "0"))


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def number_text(x: Column, digits: int = 1) -> Column:
    """A number rounded to ``digits`` decimals as text, whole numbers without a point, never with an exponent."""
    whole = x.cast("decimal(38,0)").cast("string")
    return F.when(x == F.floor(x), whole).otherwise(x.cast(f"decimal(38,{digits})").cast("string"))


def local_number(x: Column, digits: int = 0, lang: str = "en") -> Column:
    """A number with at most ``digits`` decimals and grouped thousands, as English ("27,791", "4.2") or Ukrainian texts write it."""
    text = F.format_number(round_half_up(x, digits), digits)
    if digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.translate(text, ",.", "\u00a0,") if lang == "uk" else text


def fixed_text(x: Column, digits: int = 2) -> Column:
    """A number with exactly ``digits`` (at most 3) decimals, rounded by its exact binary value; halves away from zero.

    The number is mantissa * 2**exponent, and mantissa * 10**digits still fits a long: what is shifted out of it decides
    the last digit, so 1.005 (a little below) gives 1.00 and 1.125 (exactly half) 1.13.  From 1e21 on, and for infinite
    numbers, the text is the number's own.
    """
    if not 0 <= digits <= 3:
        raise ValueError("digits must be 0 to 3")
    size = F.abs(x.cast("double"))
    two = lambda k: F.pow(F.lit(2.0), k.cast("double"))

    def cut(e: Column) -> Column:
        """From the place e of the highest bit: the scaled mantissa without what lies below its last digit."""
        mantissa = (size * two(52 - e)).cast("long") * F.lit(10**digits).cast("long")
        drop = (52 - e).cast("int")
        half = F.expr("1L")
        kept = lambda m, k: F.call_function("shiftright", m, k) + F.call_function("shiftright", m, k - 1).bitwiseAND(half)
        return F.when(drop > 63, F.lit(0).cast("long")).when(drop > 0, let(F.struct(mantissa.alias("m"), drop.alias("k")), lambda s: kept(s["m"], s["k"])))

    guess = F.floor(F.log2(size))
    place = let(guess, lambda g: g + F.when(size < two(g), -1).when(size >= two(g + 1), 1).otherwise(0))
    small = let(place, cut)
    units = small.cast("decimal(38,0)") if digits == 0 else (small.cast("decimal(38,0)") / F.lit(10**digits).cast("decimal(38,0)")).cast(f"decimal(38,{digits})")
    exact = let(place, lambda e: (size * two(52 - e)).cast("long").cast("decimal(20,0)") * two(e - 52).cast("long").cast("decimal(18,0)")).cast("decimal(38,0)")
    zeros = "." + "0" * digits if digits else ""
    text = F.when(size < 1e-9, F.lit("0" + zeros)).when(size < 2.0**52, units.cast("string")).when(size < 1e21, F.concat(exact.cast("string"), F.lit(zeros)))
    return F.when(size < 1e21, F.concat(F.when(x < 0, "-").otherwise(""), text)).otherwise(x.cast("string"))


def signed_percent(x: Column, lang: str = "en") -> Column:
    """"+4.2%" as a language writes it; a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.concat(F.when(x > 0, "+").otherwise(""), local_number(x, 1, lang), F.lit("%")))


# Short forms of thousands, millions and so on.
SHORT = {"en": ["", "K", "M", "B", "T"], "uk": ["", "\u00a0тис.", "\u00a0млн", "\u00a0млрд", "\u00a0трлн"]}


def compact_number(x: Column, lang: str = "en") -> Column:
    """"27.8K", "1.4M" or "27,8 тис.": at most one decimal, of the largest unit of which there is one after rounding; numbers of 1e15 and more in the last unit."""
    units = SHORT.get(lang, SHORT["en"])
    size = F.abs(x)
    power = F.lit(0)
    for k in range(1, len(units)):
        power = F.when(round_half_up(size / 1000.0 ** (k - 1)) >= 1000, k).otherwise(power)
    texts = F.array(*[F.concat(local_number(x / 1000.0**k, 1, lang), F.lit(u)) for k, u in enumerate(units)])
    return F.get(texts, power)
