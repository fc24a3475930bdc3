"""Ordered operators per key that survive a hot key.

A window partitioned by airport puts a whole hub in one task. Here every key is
cut into time slices and the window runs per (key, slice). What a slice needs to
know of the others is carried over in a summary with one row per (key, slice), so
its size depends on the span of time covered and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.timecols import micros

HOUR = 3600
DAY = 24 * HOUR

# Places for rows without a position in time; less than a slice is wide.
ASIDE = 1000


def time_slice(at: Column, seconds: int) -> Column:
    """Start of the slice an instant falls in, in microseconds."""
    width = seconds * 1_000_000
    value = micros(at)
    return value - F.pmod(value, F.lit(width))


def _sliced(df: DataFrame, keys: Sequence[str], at: str, tie: str, seconds: int) -> DataFrame:
    """`_known`: the row has all keys and an instant; `_slice`: where it is worked on.

    Rows that are not known have no place in any order. They are spread by their tie,
    over slices no instant falls in, so that many of them do not end in one task.
    """
    known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, at]])
    aside = -1 - F.pmod(F.xxhash64(tie), F.lit(ASIDE))
    return df.withColumns(
        {"_known": known, "_slice": F.when(known, time_slice(F.col(at), seconds)).otherwise(aside)}
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    name: str,
    seconds: int = DAY,
    most: int | None = None,
) -> DataFrame:
    """`row_number() over (partition by keys order by at, tie)` as column `name`.

    `tie` must be unique. Rows that lack a key or `at` stand in no queue: their number
    is null. With `most`, rows with a larger number or none are left out, most of them
    before they are sorted in full.
    """
    sliced = _sliced(df, keys, at, tie, seconds)
    inside = Window.partitionBy(*keys, "_slice").orderBy(at, tie)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.where("_known")
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    ranked = sliced.withColumn("_inside", F.row_number().over(inside))
    if most is not None:
        ranked = ranked.where((F.col("_inside") <= most) & F.col("_known"))
    joined = ranked.alias("r").join(offsets.alias("o"), _same("r", "o", [*keys, "_slice"]), "left")
    number = (F.col("r._inside") + F.col("o._offset")).cast("bigint")
    numbered = joined.select(*[F.col(f"r.{c}") for c in df.columns], F.when(F.col("r._known"), number).alias(name))
    return numbered if most is None else numbered.where(F.col(name) <= most)


def next_two(df: DataFrame, key: str, at: str, tie: str, first: str, second: str, seconds: int = DAY) -> DataFrame:
    """`lead(at, 1)` and `lead(at, 2)` per key in the order of (at, tie).

    Rows that lack the key or `at` follow nothing: theirs are null.
    """
    sliced = _sliced(df, [key], at, tie, seconds).repartition(key, "_slice")
    inside = Window.partitionBy(key, "_slice").orderBy(at, tie)
    marked = sliced.withColumns(
        {
            "_nr": F.row_number().over(inside),
            "_next1": F.lead(at, 1).over(inside),
            "_next2": F.lead(at, 2).over(inside),
        }
    )
    # The first two instants of a slice are all that earlier slices can need of it.
    heads = (
        marked.where((F.col("_nr") == 1) & F.col("_known"))
        .select(key, "_slice", F.col(at).alias("_head1"), F.col("_next1").alias("_head2"))
    )
    later = Window.partitionBy(key).orderBy("_slice")
    carried = heads.select(
        key,
        "_slice",
        F.lead("_head1", 1).over(later).alias("_carry1"),
        F.coalesce(F.lead("_head2", 1).over(later), F.lead("_head1", 2).over(later)).alias("_carry2"),
    )
    joined = marked.alias("m").join(carried.alias("c"), _same("m", "c", [key, "_slice"]), "left")
    beyond = F.when(F.col("m._next1").isNotNull(), F.col("c._carry1")).otherwise(F.col("c._carry2"))
    known = F.col("m._known")
    return joined.select(
        *[F.col(f"m.{c}") for c in df.columns],
        F.when(known, F.coalesce("m._next1", "c._carry1")).alias(first),
        F.when(known, F.coalesce("m._next2", beyond)).alias(second),
    )


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    """Plain equality, which the windows' partitioning already serves: no further shuffle."""
    return reduce(and_, [F.col(f"{left}.{n}") == F.col(f"{right}.{n}") for n in names])
