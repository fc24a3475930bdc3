"""Nearest observation in time, per station."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.timecols import micros, whole_minutes
from tarmac.operators.selection import can_select, rows_of, winners
from tarmac.operators.slices import ASIDE, DAY, time_slice


@dataclass(frozen=True)
class Observed:
    """Observations, one per station and instant.

    `instants` has `_station`, `_at` and `_winner`, which names the observation; all of the
    search works on it. `records` has the observation itself as struct `_obs` as well.
    """

    instants: DataFrame
    records: DataFrame


def observation_index(observations: DataFrame, station: str = "fs", time: str = "valid_time", tie: str = "obs_id") -> Observed:
    """One observation per station and instant: the one with the smallest `tie`.

    Copies of a report cost nothing later. With a tie that is a number, a hash aggregate
    finds the observation to keep from its keys, and its values are read by one join;
    without one, the observation with the smallest values is kept, which takes an
    aggregate over whole rows.
    """
    rest = [c for c in observations.columns if c != station]
    known = observations.where(F.col(station).isNotNull() & F.col(time).isNotNull())
    keys = [F.col(station).alias("_station"), F.col(time).alias("_at")]
    if tie in observations.columns and can_select(observations, [tie]):
        chosen = winners(known, [station, time], [tie])
        kept = rows_of(known, chosen, [station, time], nulls=False)
        records = kept.select(*keys, F.col("_hash").alias("_winner"), F.struct(*rest).alias("_obs"))
        return Observed(chosen.select(*keys, "_winner"), records)
    order = F.struct(tie) if tie in observations.columns else F.struct(*[c for c in rest if c != time])
    records = known.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_obs")).withColumn("_winner", F.lit(0).cast("bigint"))
    return Observed(records.drop("_obs"), records)


def points_of(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Distinct (`_station`, `_at`) of one or more (station, time) column pairs."""
    ends = [F.struct(F.col(s).alias("_station"), F.col(t).alias("_at")) for s, t in pairs]
    if len(ends) == 1:
        points = df.select(ends[0].alias("_end"))
    else:
        points = df.select(F.explode(F.array(*ends)).alias("_end"))
    return (
        points.select("_end._station", "_end._at")
        .where(F.col("_station").isNotNull() & F.col("_at").isNotNull())
        .distinct()
    )


def neighbours(points: DataFrame, instants: DataFrame, seconds: int = DAY) -> DataFrame:
    """The last observation at or before each point, and the first at or after it.

    As instants `_before` and `_after` and as `_before_winner` and `_after_winner`. Windows
    run per (station, slice); a slice that holds no observation on one side takes it from
    the nearest slice that does. Both windows grow from the start of the partition: one
    reads the slice forward, the other backward. Only stations, instants and a number for
    each observation take part, so what is sorted stays narrow however wide an observation is.
    """
    instant = dict(instants.dtypes)["_at"]
    if "_winner" not in instants.columns:
        instants = instants.withColumn("_winner", F.lit(0).cast("bigint"))
    rows = (
        points.select("_station", "_at", F.lit(None).cast(instant).alias("_seen"), F.lit(None).cast("bigint").alias("_winner"))
        .unionByName(instants.select("_station", "_at", F.col("_at").alias("_seen"), "_winner"))
        .withColumn("_slice", time_slice(F.col("_at"), seconds))
        .repartition("_station", "_slice")
    )
    slice_of_station = Window.partitionBy("_station", "_slice")
    upto = (Window.unboundedPreceding, Window.currentRow)
    forward = slice_of_station.orderBy(F.col("_at").asc(), F.col("_seen").asc_nulls_last()).rowsBetween(*upto)
    backward = slice_of_station.orderBy(F.col("_at").desc(), F.col("_seen").desc_nulls_last()).rowsBetween(*upto)

    # Reads the same columns as the windows, so that both share one shuffle.
    observed_at = F.when(F.col("_seen").isNotNull(), F.col("_at"))
    others = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_station").orderBy(F.col("_slice").asc()).rowsBetween(*others)
    later = Window.partitionBy("_station").orderBy(F.col("_slice").desc()).rowsBetween(*others)
    carried = (
        rows.groupBy("_station", "_slice")
        .agg(
            F.min(observed_at).alias("_first"),
            F.max(observed_at).alias("_last"),
            F.min_by("_winner", observed_at).alias("_first_winner"),
            F.max_by("_winner", observed_at).alias("_last_winner"),
        )
        .select(
            F.col("_station").alias("_c_station"),
            F.col("_slice").alias("_c_slice"),
            F.max("_last").over(earlier).alias("_carry_before"),
            F.last("_last_winner", ignorenulls=True).over(earlier).alias("_carry_before_winner"),
            F.min("_first").over(later).alias("_carry_after"),
            F.last("_first_winner", ignorenulls=True).over(later).alias("_carry_after_winner"),
        )
    )
    inside = rows.withColumns(
        {
            "_in_before": F.max("_seen").over(forward),
            "_in_before_winner": F.last("_winner", ignorenulls=True).over(forward),
            "_in_after": F.min("_seen").over(backward),
            "_in_after_winner": F.last("_winner", ignorenulls=True).over(backward),
        }
    ).where(F.col("_seen").isNull())
    return inside.join(
        carried, (F.col("_station") == F.col("_c_station")) & (F.col("_slice") == F.col("_c_slice")), "left"
    ).select(
        "_station",
        "_at",
        *[F.coalesce(f"_in_{side}", f"_carry_{side}").alias(f"_{side}") for side in ("before", "before_winner", "after", "after_winner")],
    )


def _is_nearer() -> Column:
    """The observation before the point is taken: it is as near, or alone."""
    at, before, after = F.col("_at"), F.col("_before"), F.col("_after")
    return after.isNull() | (micros(at) - micros(before) <= micros(after) - micros(at))


def nearest(points: DataFrame, index: Observed, granularity: str = "exact", seconds: int = DAY) -> DataFrame:
    """The observation closest to each point, as column `_obs`; no maximum gap.

    `granularity="exact"`: smallest distance, then the earlier observation.
    `granularity="minute"`: distances are cut to whole minutes and the earliest
    observation among equals is taken. Once the smallest such distance d is known,
    that is the first observation after point - (d + 1) minutes.
    """
    if granularity not in ("exact", "minute"):
        raise ValueError(f"unknown granularity {granularity!r}")
    found = neighbours(points, index.instants, seconds).select(
        "_station",
        "_at",
        F.when(_is_nearer(), F.col("_before")).otherwise(F.col("_after")).alias("_found"),
        F.when(_is_nearer(), F.col("_before_winner")).otherwise(F.col("_after_winner")).alias("_found_winner"),
    )
    if granularity == "minute":
        distance = F.abs(whole_minutes(F.col("_found"), F.col("_at")))
        start = F.timestamp_add("MICROSECOND", F.lit(1), F.timestamp_add("MINUTE", (-distance - 1).cast("int"), F.col("_at")))
        shifted = found.where(F.col("_found").isNotNull()).select(
            "_station", "_at", start.cast(dict(found.dtypes)["_at"]).alias("_from")
        )
        first = neighbours(points_of(shifted, ("_station", "_from")), index.instants, seconds).select(
            F.col("_station").alias("_f_station"), F.col("_at").alias("_f_at"), F.col("_after").alias("_found"), F.col("_after_winner").alias("_found_winner")
        )
        found = shifted.join(
            first, (F.col("_station") == F.col("_f_station")) & (F.col("_from") == F.col("_f_at"))
        ).select("_station", "_at", "_found", "_found_winner")
    observed = index.records.select(F.col("_station").alias("_o_station"), F.col("_at").alias("_o_at"), F.col("_winner").alias("_o_winner"), "_obs")
    same = (F.col("_station") == F.col("_o_station")) & (F.col("_found") == F.col("_o_at")) & (F.col("_found_winner") == F.col("_o_winner"))
    return found.join(observed, same).select("_station", "_at", "_obs")


def attach(df: DataFrame, answers: DataFrame, station: str, at: str, name: str) -> DataFrame:
    """Put the observation found for (station, at) on each row, null where there is none.

    Rows without a station or instant find nothing. They are spread by their other values,
    else all flights of a hub that never landed would meet in one task.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))]
    aside = F.col(station).isNull() | F.col(at).isNull()
    spread = F.when(aside, F.pmod(F.xxhash64(*plain), F.lit(ASIDE))).otherwise(F.lit(0))
    side = answers.select(
        F.col("_station").alias("_a_station"),
        F.col("_at").alias("_a_at"),
        # Always 0, but not to the optimiser, which would drop a constant from the keys. Never null: a
        # filter for that would reach one of the two uses of the search's rows, which then share no shuffle.
        F.coalesce(F.pmod(F.xxhash64("_station"), F.lit(1)), F.lit(0).cast("bigint")).alias("_a_spread"),
        F.col("_obs").alias(name),
    )
    same = (F.col(station) == F.col("_a_station")) & (F.col(at) == F.col("_a_at")) & (F.col("_spread") == F.col("_a_spread"))
    return df.withColumn("_spread", spread).join(side, same, "left").drop("_spread", "_a_station", "_a_at", "_a_spread")


def nearest_observation(
    df: DataFrame,
    observations: DataFrame,
    station: str,
    at: str,
    name: str,
    granularity: str = "exact",
    seconds: int = DAY,
    obs_station: str = "fs",
    obs_time: str = "valid_time",
    obs_tie: str = "obs_id",
) -> DataFrame:
    """Each row with the observation at `station` closest to `at`, as struct `name`."""
    index = observation_index(observations, obs_station, obs_time, obs_tie)
    answers = nearest(points_of(df, (station, at)), index, granularity, seconds)
    return attach(df, answers, station, at, name)


def weather_at_both_ends(
    flights: DataFrame,
    observations: DataFrame,
    dep: str = "dep",
    scheduled: str = "sched",
    arr: str = "arr",
    landed: str = "act_arr",
    granularity: str = "exact",
    seconds: int = DAY,
) -> DataFrame:
    """Departure weather by scheduled departure, arrival weather by actual landing.

    The points of both ends go through one search. Flights and observations are each read
    twice, once for the few columns the search needs and once whole.
    """
    answers = nearest(
        points_of(flights, (dep, scheduled), (arr, landed)),
        observation_index(observations),
        granularity=granularity,
        seconds=seconds,
    )
    with_departure = attach(flights, answers, dep, scheduled, "departureWeather")
    return attach(with_departure, answers, arr, landed, "arrivalWeather")
