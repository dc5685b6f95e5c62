"""Dates: month ranges that push down, trailing windows, billing days, dates as people write them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

#: Days that count as one month in projections.
MONTH_DAYS = 30.44


def month_range(ts: Column, month: str) -> Column:
    """Whether a timestamp is in the month `yyyy-MM`, as a half-open range that reaches the scan."""
    first = dt.date.fromisoformat(f"{month}-01")
    after = (first + dt.timedelta(days=32)).replace(day=1)
    return (ts >= F.lit(dt.datetime(first.year, first.month, 1)).cast("timestamp_ntz")) & (ts < F.lit(dt.datetime(after.year, after.month, 1)).cast("timestamp_ntz"))


def at(as_of: dt.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def trailing_months(ts: Column, as_of: dt.datetime, months: int) -> Column:
    """Whether a timestamp is in the `months` months up to `as_of`; the bound is a constant and is pushed down."""
    return (ts >= at(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))) & (ts <= at(as_of))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def next_due(day: Column, as_of: Column) -> Column:
    """The next date on a day of the month after `as_of`; days beyond a month's end run into the next month."""
    this = F.date_add(F.trunc(as_of, "MM"), (day - 1).cast("int"))
    following = F.date_add(F.add_months(F.trunc(as_of, "MM"), 1), (day - 1).cast("int"))
    return F.when(this > as_of, this).otherwise(following)


def days_until(day: Column, as_of: Column) -> Column:
    return F.datediff(next_due(day, as_of), as_of)


def parse_date(text: Column, as_of: Column) -> Column:
    """Text `yyyy-MM-dd` of a date written day first or year first; `as_of` if there are not three parts. Not checked against the calendar."""
    parts = F.split(text, r"[/\-.]")
    part = lambda i: F.element_at(parts, i)
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    day_first, year_first = F.concat_ws("-", year, two(part(2)), two(part(1))), F.concat_ws("-", part(1), two(part(2)), two(part(3)))
    return F.when(F.size(parts) == 3, F.when(F.length(part(1)) == 4, year_first).otherwise(day_first)).otherwise(F.date_format(as_of, "yyyy-MM-dd"))


def days_to_expiry(expires: Column, as_of: Column) -> Column:
    """Whole days, rounded up, until a plan expires; null if it has no end or is over."""
    seconds = F.unix_timestamp(expires.cast("timestamp")) - F.unix_timestamp(as_of.cast("timestamp"))
    return F.when(seconds > 0, F.ceil(seconds / 86400))


def month_step(day: Column, months: int) -> Column:
    """The first day of the month that many months on (negative: before)."""
    return F.add_months(F.trunc(day, "MM"), months)
