"""Feature projection and feature arrays, the same for training and for scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import nonnegative_whole, zero_if_missing
from tarmac.operators.handlers import DefaultHandler
from tarmac.operators.projections import FORECAST_NAMES

# The weather attributes used as features, in feature order.
ATTRIBUTES = ("dewPt", "rh", "vis", "wc", "wspd", "feels_like", "uv_index")


def feature_projection(df: DataFrame, handler: DefaultHandler | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Weather of both ends as flat columns, delay, class and the handler's columns."""
    handler = handler or DefaultHandler()
    return df.select(
        *keep,
        *[F.col(f"departureWeather.{a}").alias(f"{a}_1") for a in ATTRIBUTES],
        "deltaDeparture",
        "classification",
        *[F.col(f"arrivalWeather.{a}").alias(f"{a}_2") for a in ATTRIBUTES],
        *handler.extra_columns(),
    )


def _as_array(weather: Sequence[Column], handler: DefaultHandler) -> Column:
    return F.array(*[c.cast("double") for c in [*weather, *handler.extra_features()]])


def features(handler: DefaultHandler | None = None) -> Column:
    """Feature array over the columns of `feature_projection`."""
    ends = [F.col(f"{a}_{end}") for end in (1, 2) for a in ATTRIBUTES]
    return _as_array(ends, handler or DefaultHandler())


def forecast_features(
    departure: str,
    arrival: str,
    handler: DefaultHandler | None = None,
    names: dict[str, str] = FORECAST_NAMES,
) -> Column:
    """The same array from two forecast structs."""
    ends = [F.col(end).getField(names.get(a, a)) for end in (departure, arrival) for a in ATTRIBUTES]
    return _as_array(ends, handler or DefaultHandler())


def impute_zero(values: Column) -> Column:
    return F.transform(values, zero_if_missing)


def clamp_nonneg_int(values: Column) -> Column:
    return F.transform(values, nonnegative_whole)


def long_form(df: DataFrame, keys: Sequence[str], array: str = "features") -> DataFrame:
    """One row per feature: keys, position from 0, value."""
    return df.select(*keys, F.posexplode(array).alias("position", "value"))


def labelled_set(df: DataFrame, handler: DefaultHandler | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Label and features of each labelled flight, missing values still null.

    Persist it where more than one model is trained on it.
    """
    handler = handler or DefaultHandler()
    projected = feature_projection(df, handler, keep)
    return projected.select(*keep, handler.classification().cast("double").alias("label"), features(handler).alias("features"))
