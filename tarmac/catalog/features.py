from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tarmac.catalog.base import label_case, query, rounded
from tarmac.operators import features as f
from tarmac.operators import handlers
from tarmac.plans import workload as w

_NAMES = [(a, 1) for a in f.ATTRIBUTES] + [(a, 2) for a in f.ATTRIBUTES]
_WEATHER = {1: "d", 2: "a"}
_BOTH = """f_landed f join f_dep_weather d on d.flight_id = f.flight_id join f_arr_weather a on a.flight_id = f.flight_id"""


def _long(value: str, source: str, names) -> str:
    """One row per flight and feature, with `value` around each attribute."""
    parts = []
    for i, (attribute, alias) in enumerate(names):
        number = value.format(v=f"cast({alias}.{attribute} as double)")
        parts.append(f"select f.flight_id, cast({i} as int) as position, round({number}, 6) as value from {source}")
    return " union all ".join(parts)


_OBSERVED = [(a, _WEATHER[end]) for a, end in _NAMES]


def _features(spark, folder, change=lambda values: values):
    projected = f.feature_projection(w.labelled(spark, folder), keep=["flight_id"])
    return f.long_form(projected.select("flight_id", change(f.features()).alias("features")), ["flight_id"])


def _long_rounded(df):
    return df.select("flight_id", "position", *rounded("value"))


@query("select f.flight_id, " + ", ".join(
    f"round(cast({_WEATHER[end]}.{a} as double), 6) as {a}_{end}" for a, end in _NAMES
) + f", f.delta as deltaDeparture, f.classification from {_BOTH}")
def feature_projection(spark, folder):
    projected = f.feature_projection(w.labelled(spark, folder), keep=["flight_id"])
    names = [f"{a}_{end}" for a, end in _NAMES]
    return projected.select("flight_id", *rounded(*names), "deltaDeparture", "classification")


@query(_long("{v}", _BOTH, _OBSERVED))
def assemble_features(spark, folder):
    return _long_rounded(_features(spark, folder))


_FORECAST_BOTH = """f_landed f
    left join f_dep_forecast d on d.flight_id = f.flight_id
    left join f_arr_forecast a on a.flight_id = f.flight_id"""
_FORECAST = [("dewpoint" if a == "dewPt" else a, alias) for a, alias in _OBSERVED]
_FORECAST_NAMES = {"dewPt": "dewpoint"}


def _forecast_features(spark, folder, change=lambda values: values):
    values = f.forecast_features("departureWeather", "arrivalWeather", names=_FORECAST_NAMES)
    flights = w.forecast_flights(spark, folder).select("flight_id", change(values).alias("features"))
    return _long_rounded(f.long_form(flights, ["flight_id"]))


@query(_long("{v}", _FORECAST_BOTH, _FORECAST))
def assemble_forecast_features(spark, folder):
    return _forecast_features(spark, folder)


@query(_long("coalesce({v}, 0)", _FORECAST_BOTH, _FORECAST))
def impute_zero(spark, folder):
    return _forecast_features(spark, folder, f.impute_zero)


@query(_long("trunc(greatest(coalesce({v}, 0), 0))", _BOTH, _OBSERVED))
def clamp_nonneg_int(spark, folder):
    return _long_rounded(_features(spark, folder, f.clamp_nonneg_int))


@query(_long("{v}", _BOTH, _OBSERVED).replace("f.flight_id,", "f.flight_id, cast(f.classification as double) as label,"))
def labelled_set(spark, folder):
    labelled = f.labelled_set(w.labelled(spark, folder), keep=["flight_id"])
    return f.long_form(labelled, ["flight_id", "label"]).select("flight_id", "label", "position", *rounded("value"))


def _handled(spark, folder, handler):
    flights = w.landed(spark, folder).withColumnsRenamed({"delta": "deltaDeparture", "sched": "departureTime"})
    return handlers.apply_handler(flights, handler).select("flight_id", "label", "label_text")


@query(f"select flight_id, classification as label, {label_case('classification')} as label_text from f_landed")
def handler_default(spark, folder):
    return _handled(spark, folder, handlers.DefaultHandler())


@query(f"""select flight_id, cast(c as int) as label, {label_case('c', 3)} as label_text
    from (select flight_id, case when delta < 13 then 0 when delta < 41 then 1 else 2 end as c from f_landed) t""")
def handler_custom3(spark, folder):
    return _handled(spark, folder, handlers.ThreeClassHandler())


@query(f"select f.flight_id, round(d.dewPt, 6) as dewPt_1, round(a.dewPt, 6) as dewPt_2, f.sched as departureTime, "
       + ", ".join(f"cast(isodow(f.sched) - 1 = {n} as int)::double as feature_{14 + n}" for n in range(7)) + f" from {_BOTH}")
def handler_extra_columns(spark, folder):
    handler = handlers.WeekdayHandler()
    projected = f.feature_projection(w.labelled(spark, folder), handler, ["flight_id"])
    values = projected.withColumn("features", f.features(handler))
    return values.select(
        "flight_id",
        *rounded("dewPt_1", "dewPt_2"),
        "departureTime",
        *[F.get("features", F.lit(14 + n)).alias(f"feature_{14 + n}") for n in range(7)],
    )


def _spread(rows: pd.DataFrame) -> pd.Series:
    return (rows["temp"] - rows["feels_like"]).round(6) + rows["wspd"]


@query("select obs_id, round(round(temp - feels_like, 6) + wspd, 6) as spread from f_obs")
def udf_pandas(spark, folder):
    spread = handlers.row_function(_spread, "double")
    return w.observations(spark, folder).select("obs_id", F.round(spread("temp", "feels_like", "wspd"), 6).alias("spread"))
