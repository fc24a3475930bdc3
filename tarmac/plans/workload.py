"""Flight tables derived from the tables of a data folder.

Every view takes (spark, folder) and is a lazy DataFrame over parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.classify import class_label5, classify5
from tarmac.functions.timecols import hour_start, whole_minutes
from tarmac.operators.asof import weather_at_both_ends
from tarmac.operators.joins import join_airports, join_forecast_hour
from tarmac.operators.projections import landed_only
from tarmac.operators.slices import next_two
from tarmac.operators.voting import vote_in_row
from tarmac.plans.scoring import assemble_payload
from tarmac.session import written

FLIGHT_EVENTS = ("purchase", "signup", "error")
OBSERVATION_EVENTS = ("view", "click")
DATA_SETS = {
    "training": [f"A{n:02d}" for n in range(0, 15)],
    "test": [f"A{n:02d}" for n in range(15, 20)],
    "blind": [f"A{n:02d}" for n in range(20, 25)],
}
ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Anchorage")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def airport_code(number: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad(number.cast("string"), 2, "0"))


def airports(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (key % 5 + 1).cast("int"))
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            airport_code(key).alias("fs"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("country"),
            F.when(key % 3 != 0, F.concat(F.lit("S"), key.cast("string"))).alias("state"),
            (25 + (key * 7) % 25).cast("double").alias("latitude"),
            (-125 + (key * 11) % 58).cast("double").alias("longitude"),
            (-4 - key % 5).cast("int").alias("utc_offset_hours"),
            zone.alias("zone"),
        )
    )


def airlines(spark: SparkSession, folder: str) -> DataFrame:
    """Carriers seen in the events; `ER` has no entry."""
    return (
        table(spark, folder, "events")
        .where(F.col("event_type").isin("purchase", "signup"))
        .groupBy("event_type")
        .agg(F.lit(1).alias("_one"))
        .select(
            F.upper(F.substring("event_type", 1, 2)).alias("fs"),
            F.concat(F.initcap("event_type"), F.lit(" Air")).alias("name"),
        )
    )


def flights(spark: SparkSession, folder: str) -> DataFrame:
    """A flight per purchase, signup or error; the user's next events are take-off and landing."""
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", "value", "ts")
    follow = next_two(events, "user_id", "ts", "event_id", "act_dep", "act_arr")
    user, number = F.col("user_id"), F.col("event_id")
    return follow.where(F.col("event_type").isin(*FLIGHT_EVENTS)).select(
        number.alias("flight_id"),
        "event_type",
        airport_code(user % 25).alias("dep"),
        airport_code((user * 7 + number) % 25).alias("arr"),
        F.upper(F.substring("event_type", 1, 2)).alias("carrier"),
        number.cast("string").alias("flight_number"),
        F.when(F.col("event_type") == "error", "C").otherwise("L").alias("status"),
        F.col("ts").alias("sched"),
        "act_dep",
        "act_arr",
        "user_id",
        "value",
    )


def label_landed(df: DataFrame, compat: bool = False) -> DataFrame:
    return (
        landed_only(df, "sched", "act_dep", "act_arr")
        .withColumn("delta", whole_minutes(F.col("sched"), F.col("act_dep")))
        .withColumn("classification", classify5(F.col("delta"), F.col("status"), compat))
    )


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return label_landed(flights(spark, folder))


def landed_table(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The landed flights, or these columns of them, written: a weather search reads its flights twice."""
    flown = landed(spark, folder)
    return written(flown.select(*columns) if columns else flown, "landed")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    value = F.col("value")
    return (
        table(spark, folder, "events")
        .where(F.col("event_type").isin(*OBSERVATION_EVENTS))
        .withColumn("k", k)
        .select(
            F.col("event_id").alias("obs_id"),
            airport_code((F.col("user_id") * 3 + F.col("event_id")) % 25).alias("fs"),
            F.col("ts").alias("valid_time"),
            value.alias("temp"),
            (value - (100 - F.col("k")) / F.lit(5.0)).alias("dewPt"),
            F.col("k").alias("rh"),
            (value / F.lit(10.0)).alias("vis"),
            (value - F.col("k") / F.lit(10.0)).alias("wc"),
            (F.col("k") % 40).alias("wspd"),
            (value - 5).alias("feels_like"),
            (F.col("k") % 12).alias("uv_index"),
            F.when(F.col("k") % 10 != 0, 1000 + F.col("k") / F.lit(4.0)).alias("pressure"),
        )
    )


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """One forecast per observation, valid on the hour; every other one was fetched the day before."""
    return observations(spark, folder).select(
        F.col("obs_id").alias("forecast_id"),
        "fs",
        hour_start(F.col("valid_time")).alias("fcst_valid"),
        F.date_sub(F.to_date("valid_time"), (F.col("obs_id") % 2).cast("int")).cast("timestamp_ntz").alias("fetched_at"),
        "temp",
        F.col("dewPt").alias("dewpoint"),
        "rh",
        "vis",
        "wc",
        "wspd",
        "feels_like",
        "uv_index",
        (F.col("obs_id") % 60).cast("int").alias("icon_code"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """One stored prediction per line item."""
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            airport_code(F.col("s_nationkey")).alias("dep"),
            airport_code(F.col("c_nationkey")).alias("arr"),
            F.col("l_returnflag").alias("carrier"),
            F.col("l_linenumber").alias("flight_number"),
            F.col("o_orderdate").alias("departure"),
            "l_orderkey",
        )
    )


def rule_models() -> dict[str, Column]:
    """Four rule-based models over landed flights, in voting order."""
    value, number, label = F.col("value"), F.col("flight_id"), F.col("classification")
    rules = {
        "m1": F.when(value < 50, 1).when(value < 120, 2).otherwise(4),
        "m2": F.col("user_id") % 5,
        "m3": number % 5,
        "m4": F.when(number % 3 == 0, label).otherwise(1),
    }
    return {name: rule.cast("int") for name, rule in rules.items()}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The rule-based models, one row per flight and model."""
    entries = [
        F.struct(F.lit(name).alias("model"), F.lit(pos).alias("model_pos"), rule.alias("prediction"))
        for pos, (name, rule) in enumerate(rule_models().items(), start=1)
    ]
    return landed(spark, folder).select(
        "flight_id", F.col("classification").alias("label"), F.inline(F.array(*entries))
    ).select("flight_id", "model", "model_pos", "label", "prediction")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Landed flights with the weather of both ends: the training records.

    The search takes along, and hashes, every column that its flights have: only those needed are written for it.
    """
    flown = landed_table(spark, folder, "flight_id", "dep", "arr", "sched", "act_arr", "delta", "classification")
    return weather_at_both_ends(flown, observations(spark, folder)).select(
        "flight_id",
        "dep",
        "arr",
        F.col("sched").alias("departureTime"),
        F.col("delta").alias("deltaDeparture"),
        "classification",
        "departureWeather",
        "arrivalWeather",
    )


def forecast_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Landed flights with airport records and forecasts of both ends."""
    known = join_airports(scored_by_day(landed(spark, folder)), airports(spark, folder))
    departures = join_forecast_hour(known, forecasts(spark, folder), "dep", "sched", "departureWeather", "scored_at")
    return join_forecast_hour(departures, forecasts(spark, folder), "arr", "act_arr", "arrivalWeather", "scored_at")


def scored_by_day(df: DataFrame) -> DataFrame:
    """Flights with the instant at which their day begins, when they are scored."""
    return df.withColumn("scored_at", F.to_date("sched").cast("timestamp_ntz"))


def far_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Flights whose airports need not be known: two codes have no nation."""
    user, number = F.col("user_id"), F.col("flight_id")
    ends = {"dep": airport_code(user % 27), "arr": airport_code((user * 7 + number) % 27)}
    return flights(spark, folder).withColumns(ends)


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Nested prediction payloads of the rule-based models."""
    rules = rule_models()
    flight = [
        F.col("carrier").alias("carrierFsCode"),
        F.col("flight_number").alias("flightNumber"),
        F.col("sched").alias("departureTime"),
    ]
    return assemble_payload(
        forecast_flights(spark, folder),
        flight,
        vote_in_row(list(rules.values()), class_label5),
        [(name, class_label5(rule)) for name, rule in rules.items()],
        ["flight_id"],
    )


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status answers: two entries per flight, none for every 50th."""
    entries = F.explode(F.array(F.lit(0), F.lit(1)))
    return (
        flights(spark, folder)
        .where(F.col("flight_id") % 50 != 0)
        .withColumn("pos", entries)
        .select(
            "carrier",
            "flight_number",
            "dep",
            F.to_date("sched").alias("day"),
            "pos",
            F.when(F.col("pos") == 0, F.col("status")).otherwise("X").alias("status"),
            F.col("sched").alias("gate_departure"),
            "act_dep",
            "act_arr",
        )
    )


def legs(spark: SparkSession, folder: str) -> DataFrame:
    return flights(spark, folder).select(
        "flight_id",
        "carrier",
        (F.col("flight_id") % 40).cast("int").alias("number"),
        F.to_date("sched").alias("day"),
        "sched",
        "dep",
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One lookup per number and day; every fourth number asks for an hour that never comes."""
    return (
        legs(spark, folder)
        .groupBy("carrier", "number", "day")
        .agg(F.max(F.hour("sched")).alias("_hour"), F.count(F.lit(1)).alias("legs"))
        .select(
            "carrier",
            "number",
            "day",
            F.when(F.col("number") % 4 == 0, 99).otherwise(F.col("_hour")).cast("int").alias("want_hour"),
            "legs",
        )
    )
