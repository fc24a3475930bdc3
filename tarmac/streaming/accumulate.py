"""The accumulating run as a stream: each start takes what landed since the last one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tarmac.sources.accumulate import append_new

_DONE = "batch long, target string"


def is_done(spark: SparkSession, checkpoint: str, number: int, target: str) -> bool:
    """Whether the batch of this number has been appended to the target."""
    try:
        marks = spark.read.schema(_DONE).json(f"{checkpoint}/appended/{number:012d}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return any(r.batch == number and r.target == target for r in marks.collect())


def mark_done(spark: SparkSession, checkpoint: str, number: int, target: str) -> None:
    spark.createDataFrame([(number, target)], _DONE).coalesce(1).write.mode("append").json(f"{checkpoint}/appended/{number:012d}")


def append_batch(
    batch: DataFrame,
    number: int,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    partition: str | None = None,
) -> bool:
    """Append a numbered batch once: False if it is done already, and then nothing is read.

    The mark is written after the rows. A batch that was lost between the two has no mark;
    it is appended again, and its keys are found in the table.
    """
    spark = batch.sparkSession
    if is_done(spark, checkpoint, number, target):
        return False
    append_new(transform(batch), target, keys, partition)
    mark_done(spark, checkpoint, number, target)
    return True


def accumulate_landed(
    spark: SparkSession,
    landing: str,
    schema: str,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    partition: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the new rows of newly landed JSON files to the table at `target`, then stop.

    Each batch is appended once, by its number: a mark beside the checkpoint says that it is
    done, so that a replayed batch reads neither its own files nor the table.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def append(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, target, checkpoint, keys, transform, partition)

    return (
        reader.json(landing)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
