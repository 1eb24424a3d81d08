"""Places of chart labels, and which script a text needs: computed parts of charts and reports, without the drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .label_checks import once

# Code points that need shaping (right-to-left, Indic and South-East Asian scripts and their presentation forms).
SHAPED = [(0x0590, 0x08FF), (0x0900, 0x0DFF), (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF)]
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
GAP, MARGIN = 13.0, 6.0  # fixed values: distance of labels, and of the lowest from the bottom edge


def placed_labels(labels: DataFrame, chart: list[str], y: str, height: float, order: list[str], gap: float = GAP, margin: float = MARGIN) -> DataFrame:
    """Adds ``label_y``: labels of a chart in the order of y keep ``gap`` from each other, and the lowest stays above the bottom edge.

    First each is pushed down from the one above it, then up from the one below it.  With i the place of a label, pushing down
    is a running maximum of y - gap * i and pushing up a running minimum of the same, so both are windows over the
    chart's labels.  order: tells labels of equal y apart.  A null y stays null and moves nothing.
    """
    rows = labels.withColumn("_none", F.col(y).isNull())
    by = Window.partitionBy(*chart, "_none")
    along = by.orderBy(y, *order)
    i = F.row_number().over(along) - 1
    rows = rows.withColumns({"_i": i, "_n": F.count("*").over(by)}).withColumn("_free", F.col(y) - F.col("_i") * gap)
    rows = rows.withColumn("_down", F.max("_free").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    up = F.min("_down").over(along.rowsBetween(0, Window.unboundedFollowing))
    floor = F.lit(height - margin) - (F.col("_n") - 1) * gap
    return rows.withColumn("label_y", F.when(~F.col("_none"), F.least(up, floor) + F.col("_i") * gap)).drop("_none", "_i", "_n", "_free", "_down")


def _without(ranges: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points of ranges that are not in taken, as ranges in order that neither touch nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    for x, y in taken:
        out = [r for a, b in out for r in ((a, min(b, x - 1)), (max(a, y + 1), b)) if r[0] <= r[1]]
    return out


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def script_support(text: Column, base: list[tuple[int, int]], fallback: list[tuple[int, int]] | None = None) -> Column:
    """Struct (choice, offending): the face that can draw a text ("base", "fallback" or "none"), and what keeps the base face from it.

    base, fallback: ranges of code points that each face covers.  Characters that need shaping rule both out.  offending:
    the different characters, in code-point order, that need shaping or that the base face lacks; white space is in
    every face.  A null text is an empty one.  Patterns of one range each leave of a text what offends, so few characters are
    taken apart; the face is chosen by the different ones of them.
    """
    fine = "|".join(f"[{_class([r])}]+" for r in _without([*SPACES, *base], SHAPED))
    odd = F.regexp_replace(F.coalesce(text, F.lit("")), fine, "")

    def chosen(offending: Column) -> Column:
        lacks = F.array_join(offending, "")
        other = ~lacks.rlike(f"[^{_class(fallback)}]") if fallback else F.lit(False)
        choice = F.when(lacks == "", "base").when(lacks.rlike(f"[{_class(SHAPED)}]"), "none").when(other, "fallback").otherwise("none")
        return F.struct(choice.alias("choice"), offending.alias("offending"))

    return once(F.array_sort(F.array_remove(F.array_distinct(F.split(odd, "")), "")), chosen)
