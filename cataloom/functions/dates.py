"""Dates and times as people and download tools write them, resolved to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a date may be: eight digits, a word, or a number of units before or after a word's day (today, if no word is there).
DAY = "^[0-9]{8}$"
WORD = "^(now|today|yesterday)$"
RELATIVE = "^(now|today)?([+-])([0-9]+)(second|minute|hour|day|week|month|year)s?$"
CLOCK = r"^([0-9]+):([0-9]{1,2})(?::([0-9]{1,2}))?(?:[.,]([0-9]{1,3}))?$"


def is_feed_date(text: Column) -> Column:
    """Whether a text has the form of a date; eight digits need not be a day that exists."""
    return text.rlike(DAY) | text.rlike(WORD) | text.rlike(RELATIVE)


def feed_date(text: Column, now: Column) -> Column:
    """The day that a text means at the time ``now``; null for a text of another form, a day that does not exist, or one out of range."""
    part = lambda i: F.regexp_extract(text, RELATIVE, i)
    today = F.date_trunc("day", now)
    start = F.when(part(1) == "now", now).otherwise(today)
    n = F.when(part(2) == "-", -part(3).try_cast("int")).otherwise(part(3).try_cast("int"))
    of = lambda unit: F.when(part(4) == unit, n).otherwise(0)
    step = F.make_interval(*[of(u) for u in ("year", "month", "week", "day", "hour", "minute")], of("second").cast("decimal(18,6)"))
    word = F.when(text == "yesterday", F.date_sub(F.to_date(today), 1)).otherwise(F.to_date(now))
    whole = F.try_to_date(text, "yyyyMMdd")
    return F.when(text.rlike(DAY), whole).when(text.rlike(WORD), word).when(text.rlike(RELATIVE) & n.isNotNull(), F.to_date(F.try_add(start, step)))


def date_range(spec: Column, now: Column) -> Column:
    """(valid, after, before) of a range ``<after>..<before>``, either end of which may be empty; a single date is its beginning, and nothing is no bounds.

    Cut at the first two dots; not valid, with no bounds, where an end is not of the form of a date.
    """
    spec = F.trim(F.coalesce(spec, F.lit("")))
    cut = F.instr(spec, "..")
    ends = [F.when(cut > 0, F.substring(spec, F.lit(1), cut - 1)).otherwise(spec), F.when(cut > 0, F.substring(spec, cut + 2, F.length(spec))).otherwise("")]
    valid = ((ends[0] == "") | is_feed_date(ends[0])) & ((ends[1] == "") | is_feed_date(ends[1]))
    bounds = [F.when(valid, feed_date(e, now)).alias(n) for e, n in zip(ends, ("after", "before"), strict=True)]
    return F.struct(valid.alias("valid"), *bounds)


def timestamp_ms(text: Column) -> Column:
    """Seconds, or hours, minutes and seconds with a fraction, in milliseconds; null for anything else, and for 60 or more of a smaller unit."""
    text = F.trim(text)
    part = lambda i: F.regexp_extract(text, CLOCK, i)
    number = lambda i: part(i).try_cast("bigint")
    ms = F.rpad(part(4), 3, "0").cast("bigint")
    hours = F.when((number(2) < 60) & (number(3) < 60), ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + ms)
    minutes = F.when(number(2) < 60, (number(1) * 60 + number(2)) * 1000 + ms)
    clock = F.when(part(3) != "", hours).otherwise(minutes)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.rint(text.try_cast("double") * 1000).cast("bigint")).when(text.rlike(CLOCK), clock)
