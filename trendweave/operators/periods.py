"""The period that a request asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first day with data, the longest and the usual number of months.
DATA_START = "20150701"
MOST_MONTHS, USUAL_MONTHS = 135, 24


def period(today: Column, months: Column, start: Column, end: Column) -> Column:
    """Struct (start, end, problem) of a request: days as YYYYMMDD.

    Without an end the last full month before ``today`` ends it; without a start it begins ``months`` (24 if null)
    months back from that month, whatever the end; no start is before the first day with data.  A problem (bad day,
    bad number of months, start not before end) makes both days null.
    """
    day = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    bad = lambda c: c.isNotNull() & ~c.rlike(r"^\d{4}-?\d{2}-?\d{2}$")
    this_month = F.trunc(today, "MM")
    first = F.date_format(F.add_months(this_month, -F.coalesce(months, F.lit(USUAL_MONTHS)).cast("int")), "yyyyMMdd")
    from_ = F.greatest(F.coalesce(day(start), first), F.lit(DATA_START))
    to = F.coalesce(day(end), F.date_format(F.date_sub(this_month, 1), "yyyyMMdd"))
    problem = F.when(bad(start) | bad(end), "bad day").when((months < 1) | (months > MOST_MONTHS), "bad number of months").when(from_ >= to, "start not before end")
    return F.struct(F.when(problem.isNull(), from_).alias("start"), F.when(problem.isNull(), to).alias("end"), problem.alias("problem"))
