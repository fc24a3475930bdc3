"""Text helpers for flight codes and place names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def carrier_of(code: Column) -> Column:
    """All before the last space of "carrier number"."""
    return F.regexp_extract(code, r"^(.*) [^ ]*$", 1)


def number_of(code: Column) -> Column:
    return F.substring_index(code, " ", -1)


def flight_code(carrier: Column, number: Column) -> Column:
    return F.concat_ws(" ", carrier, number)


def place_label(name: Column, state: Column, country: Column) -> Column:
    """`name, state`; where there is no state, the country alone."""
    return F.when(state.isNotNull(), F.concat(name, F.lit(", "), state)).otherwise(country)


def ascii_only(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\x00-\x7F]", "")


def route_label(dep: Column, arr: Column) -> Column:
    return F.concat_ws(" > ", dep, arr)
