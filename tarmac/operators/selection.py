"""The first or last row of each key, found by a narrow aggregate.

An aggregate that carries whole rows sorts them, for Spark keeps only fixed-width values in
its hash tables. Here a hash aggregate finds, for each key, the 64-bit hash of the row that
wins, from the key and the order columns only; the wide rows are then read once, filtered
by a join on key and hash, and never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.timecols import micros

#: Types whose values have a 64-bit number in their order.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz", "boolean")

# Half the range of a 64-bit number: all order numbers lie within it.
_REACH = 1 << 62


def order_number(column: str, kind: str, last: bool = False) -> Column:
    """A 64-bit number in the order of the column, or against it; nulls are the smallest value."""
    value = F.col(column)
    if kind == "timestamp_ntz":
        number = micros(value)
    elif kind == "timestamp":
        number = F.unix_micros(value)
    elif kind == "date":
        number = F.unix_date(value).cast("bigint")
    else:
        number = value.cast("bigint")
    return F.coalesce(-number, F.lit(_REACH)) if last else F.coalesce(number, F.lit(-_REACH))


def can_select(df: DataFrame, order: Sequence[str]) -> bool:
    """Whether `select_rows` serves: at most two order columns, all numbers or times, and no map in the rows."""
    kinds = dict(df.dtypes)
    return len(order) <= 2 and all(kinds[c] in NUMBERS for c in order) and not any("map<" in k for k in kinds.values())


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*df.columns)


def winners(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The keys and `_winner`, the hash of the first row of each key, or of the last.

    Rows that are equal in the order columns are told apart by their hash; with two order
    columns, of rows equal in both it is any.
    """
    kinds, whole = dict(df.dtypes), "decimal(38,0)"
    numbers = [order_number(c, kinds[c], last) for c in order]
    # Two 64-bit numbers in one: 62 bits of the first, all of the second.
    wide = F.lit(str(1 << 64)).cast("decimal(20,0)")
    tie = row_hash(df) if len(numbers) < 2 else numbers.pop()
    place = tie if not numbers else (numbers[0].cast("decimal(19,0)") * wide).cast(whole) + tie.cast("decimal(19,0)")
    narrow = df.select(*keys, place.alias("_place"), row_hash(df).alias("_hash"))
    return narrow.groupBy(*keys).agg(F.min_by("_hash", "_place").alias("_winner"))


def rows_of(df: DataFrame, chosen: DataFrame, keys: Sequence[str], nulls: bool = True) -> DataFrame:
    """The rows that won, copies of a row once, with `_hash`.

    Key and hash part the rows between tasks, so a key with most of the rows fills no
    task; only copies of a winning row meet, and they are read and not kept. Without
    `nulls`, the keys hold none, and what follows can join on key and hash as they lie.
    """
    side = chosen.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_winner").hint("shuffle_hash")
    pairs = [(F.col(k), F.col(f"_w_{k}")) for k in keys]
    same = [a.eqNullSafe(b) if nulls else a == b for a, b in pairs]
    return df.withColumn("_hash", row_hash(df)).join(side, reduce(and_, [*same, F.col("_hash") == F.col("_winner")]), "left_semi").distinct()


def select_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first row of each key in ascending order, or the last one; nulls come first.

    Null keys are a key like others. 64-bit hashes stand for rows. A number beyond half the
    range of a 64-bit one fails the job.
    """
    return rows_of(df, winners(df, keys, order, last), keys).drop("_hash")
