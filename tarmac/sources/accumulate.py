"""Tables that grow with every run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.joins import first_per_key
from tarmac.session import written
from tarmac.sources import key_index


def existing(df: DataFrame, path: str) -> DataFrame | None:
    """The table at `path`, or None before the first run."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest values."""
    rest = [c for c in df.columns if c not in keys]
    return first_per_key(df, keys, rest) if rest else df.distinct()


def new_rows(df: DataFrame, path: str, keys: Sequence[str], partition: str | None = None) -> DataFrame:
    """Rows whose key is not in the table yet, one per key: the one with the smallest values.

    Nulls in a key are a value like others. Only those files of the table are opened that
    may hold a key of the batch, see `key_index`; a table without an index is read whole.
    The batch is written once, for its range of keys, its digests and its rows are each
    read from it. A partition column has to be part of the key.
    """
    if partition is not None and partition not in keys:
        raise ValueError("the partition column must be part of the key")
    batch = one_per_key(df, keys)
    stored = existing(df, path)
    if stored is None:
        return batch
    batch = written(batch, "accumulate")
    files = key_index.candidate_files(batch, stored, path, keys)
    if not files:
        return batch
    have = key_index.read_files(stored, path, files).select(*[F.col(k).alias(f"_has_{k}") for k in keys])
    return batch.join(have, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_has_{k}")) for k in keys]), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition: str | None = None) -> None:
    """Append the rows the table does not have, and index them. Running it twice appends once."""
    writer = new_rows(df, path, keys, partition).write.mode("append")
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    stored = existing(df, path)
    if stored is not None:
        key_index.index_files(stored, path, keys)
