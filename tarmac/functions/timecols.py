"""Dates and times. All zone conversion of the package happens here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_minutes(start: Column, end: Column) -> Column:
    """Signed minutes from start to end, cut toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def micros(at: Column) -> Column:
    """Microseconds since 1970 on the clock of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def utc_instant(micros_since: Column) -> Column:
    """The timestamp without zone so many microseconds after 1970 in UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", micros_since.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def hour_start(at: Column) -> Column:
    return F.date_trunc("HOUR", at).cast("timestamp_ntz")


def date_parts(at: Column) -> list[Column]:
    return [
        F.year(at).alias("year"),
        F.month(at).alias("month"),
        F.day(at).alias("day"),
        F.hour(at).alias("hour"),
    ]


def epoch_parts(seconds: Column) -> list[Column]:
    return date_parts(F.timestamp_seconds(seconds))


def local_to_utc(local: Column, zone: Column) -> Column:
    """UTC instant of a local time, as a timestamp without zone.

    In the repeated hour of autumn the earlier instant (daylight time) is taken,
    which is Spark's rule.
    """
    return F.convert_timezone(zone, F.lit("UTC"), local.cast("timestamp_ntz"))


def utc_to_local(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc.cast("timestamp_ntz"))


def epoch_ms_to_local(millis: Column, zone: Column | None = None) -> Column:
    """Local time at `zone`, or UTC where there is no zone."""
    utc = utc_instant(millis * 1000)
    return utc if zone is None else F.coalesce(utc_to_local(utc, zone), utc)


def epoch_ms_parts(millis: Column, zone: Column | None = None) -> list[Column]:
    return date_parts(epoch_ms_to_local(millis, zone))


def search_key(date_text: Column, hour_text: Column) -> dict[str, Column]:
    """Year, month, day and two-character hour of a search, and why it is rejected."""
    parts = F.split(date_text, "-")
    valid = F.size(parts) == 3
    return {
        "search_year": F.when(valid, F.get(parts, F.lit(0))),
        "search_month": F.when(valid, F.get(parts, F.lit(1))),
        "search_day": F.when(valid, F.get(parts, F.lit(2))),
        "search_hour": F.when(valid, F.substring(hour_text, 1, 2)),
        "reject_reason": F.when(~valid | parts.isNull(), F.concat(F.lit("no such date: "), F.coalesce(date_text, F.lit("")))),
    }


def long_date(at: Column) -> Column:
    return F.date_format(at, "MMMM dd yyyy")


def clock_time(at: Column) -> Column:
    return F.date_format(at, "hh:mm a")


def weekday_onehot(at: Column) -> list[Column]:
    """Seven 0/1 columns, Monday first."""
    return [(F.weekday(at) == day).cast("double").alias(f"weekday_{day}") for day in range(7)]
