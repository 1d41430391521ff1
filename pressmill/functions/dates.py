"""Partial and lenient dates, windows around an explicit as_of, and the bonuses that depend on dates and reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, start: int, length: int) -> Column:
    """Leading digits of a slice as a number, null where there are none."""
    return F.regexp_extract(F.substring(text, start, length), r"^\s*[+-]?([0-9]+)", 1).try_cast("int")


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may run over: 2024-02-30 is 2024-03-01."""
    first = F.when((year >= 1) & (year <= 9998), F.make_date(year, F.lit(1), F.lit(1)))
    return F.date_add(F.add_months(first, month - 1), day - 1)


def parse_parts(text: Column) -> Column:
    """YYYY, YYYYMM or YYYYMMDD... to a date; other lengths are null."""
    n = F.char_length(text)
    y, m, d = _number(text, 1, 4), _number(text, 5, 2), _number(text, 7, 2)
    return F.when(n == 4, rolled_date(y, F.lit(1), F.lit(1))).when(n == 6, rolled_date(y, m, F.lit(1))).when(n >= 8, rolled_date(y, m, d))


def parse_pubdate(text: Column) -> Column:
    """A publication date of any of the partial forms; dashes, slashes and 年月日 are dropped first."""
    return parse_parts(F.regexp_replace(text, "[-/年月日]", ""))


def in_window(pubdate: Column, as_of: Column, days_ago: int, include_future: bool = False, most_future: int = 7) -> Column:
    """Published in the window around as_of, a timestamp with its time of day; more than six months ahead is out."""
    day = parse_parts(F.regexp_replace(pubdate, "[-/]", "")).cast("timestamp_ntz")
    cutoff, end = as_of - F.make_dt_interval(F.lit(days_ago)), (as_of + F.make_dt_interval(F.lit(most_future))) if include_future else as_of
    inside = F.get(F.transform(F.array(day), lambda d: (d <= months_after(as_of, 6)) & (d >= cutoff) & (d <= end)), F.lit(0))  # the day is worked out once
    return F.coalesce(inside, F.lit(False))


def months_after(as_of: Column, n: int) -> Column:
    """as_of n months on; a day that the month lacks runs over into the next."""
    day = rolled_date(F.year(as_of), F.month(as_of) + n, F.dayofmonth(as_of))
    return day.cast("timestamp_ntz") + (as_of - F.date_trunc("day", as_of).cast("timestamp_ntz"))


def not_far_future(pubdate: Column, as_of: Column) -> Column:
    """Drops dates over six months ahead; missing and short ones pass, unreadable ones do not."""
    y, m, d = _number(pubdate, 1, 4), _number(pubdate, 5, 2), _number(pubdate, 7, 2)
    short = F.coalesce(F.char_length(pubdate) < 8, F.lit(True))
    return short | F.coalesce(rolled_date(y, m, d).cast("timestamp_ntz") <= months_after(as_of, 6), F.lit(False))


def sales_date(text: Column, as_of: Column) -> Column:
    """A shop's sales date to digits; what is not a full date stays short, an impossible one is ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[-/年月]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "(?s)日.*$", ""), "頃", ""))
    y, m, d = _number(t, 1, 4), _number(t, 5, 2), _number(t, 7, 2)
    ok = y.between(F.lit(2000), F.year(as_of) + 2) & m.between(1, 12) & d.between(1, 31)
    full = F.concat(y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(F.char_length(t) < 8, t).when(F.coalesce(ok, F.lit(False)), full).otherwise("")


def freshness_bonus(day: Column, as_of: Column) -> Column:
    """By days from as_of: far ahead is bad, just out is best."""
    d = F.datediff(day, as_of)
    past = F.when(d >= -7, 5).when(d >= -14, 4).when(d >= -30, 3).when(d >= -60, 2).when(d >= -90, 1).otherwise(0)
    return F.when(day.isNull(), 0).when(d > 90, -10).when(d > 30, 1).when(d > 0, 5).otherwise(past).cast("int")


def quality_bonus(reviews: Column, average: Column, description: Column) -> Column:
    n = F.coalesce(reviews, F.lit(0))
    by_count = F.when(n >= 100, 8).when(n >= 30, 6).when(n >= 10, 4).when(n >= 3, 2).otherwise(0)
    liked = F.when((n >= 5) & (F.coalesce(average, F.lit(0.0)) >= 4.0), 4).otherwise(0)
    bare = F.when(F.coalesce(description, F.lit("")) == "", -3).otherwise(0)
    return F.least(by_count + liked + bare, F.lit(12)).cast("int")


def rounded(x: Column) -> Column:
    """Halves up, also below zero."""
    return F.floor(x + F.lit(0.5).cast("double"))


def today_at(as_of: Column, hour: int, minute: int) -> Column:
    """That time of the day of as_of."""
    return F.date_trunc("day", as_of).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))


def greeting(at: Column) -> Column:
    return F.when(F.hour(at) < 12, "morning").otherwise("evening")


def is_draft_hour(at: Column) -> Column:
    """Monday to Friday, the hour from 10."""
    return (F.weekday(at) < 5) & (F.hour(at) == 10)
