"""Time columns from parts, day of year, and texts. Results have no time zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def after(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time from parts; null for dates that don't exist and for hours or minutes out of range. Hours, minutes and seconds may have a fraction."""
    date = F.try_make_timestamp_ntz(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(ok, after(date, hour * 3600 + minute * 60 + second))


def from_day_of_year(year: Column, day: Column, millis: Column) -> Column:
    """A time from year (1900 to 2200), day of year (1 to 366, may have a fraction) and millisecond of day; null outside."""
    ok = year.between(1900, 2200) & day.between(1, 366) & millis.between(0, 86_399_999)
    first = F.try_make_timestamp_ntz(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(ok, after(first, (day - 1) * 86400 + millis / 1000))


def from_iso(text: Column) -> Column:
    """A time from an ISO text of any precision, in UTC whatever the session's time zone; a text without a zone is in UTC; null if it is none."""
    cell = F.trim(text)
    zoned = F.when(cell.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$"), cell).when(cell.rlike(r"^\d{4}-\d\d?-\d\d?$"), F.concat(cell, F.lit("T00:00:00Z"))).otherwise(F.concat(cell, F.lit("Z")))
    return after(epoch(), F.unix_micros(F.try_to_timestamp(zoned)).cast("decimal(20,0)") / 1_000_000)


def micros(time: Column) -> Column:
    """Microseconds from 1970 to a time without zone."""
    since = time.cast("timestamp_ntz") - epoch()

    def part(name: str) -> Column:
        return F.extract(F.lit(name), since)

    whole = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def date_in_name(name: Column) -> Column:
    """The date of the first run of exactly eight digits in a file name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")
