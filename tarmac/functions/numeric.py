"""Numbers: coordinates, temperatures and missing feature values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coordinate(value: Column) -> Column:
    return F.round(value, 2)


def known_coordinate(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def to_fahrenheit(celsius: Column) -> Column:
    """Rounded half up, also below zero."""
    return F.floor(celsius.cast("double") * 1.8 + 32 + 0.5).cast("bigint")


def zero_if_missing(value: Column) -> Column:
    return F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def nonnegative_whole(value: Column) -> Column:
    """0 for what is missing or not positive, else the whole part."""
    known = zero_if_missing(value)
    return F.floor(F.when(known > 0, known).otherwise(0.0)).cast("double")
