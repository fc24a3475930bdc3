"""Equal-width histogram of the delays within an open range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.projections import between_open

# The delay range and bucket number of the delay analysis.
DELAY_RANGE = (12, 50)
DELAY_BUCKETS = 50

WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def delta_histogram(
    df: DataFrame, column: str, low: float = DELAY_RANGE[0], high: float = DELAY_RANGE[1], buckets: int = DELAY_BUCKETS
) -> DataFrame:
    """Bucket number, bounds and count, from the smallest to the largest value kept.

    The last bucket includes its upper bound, empty buckets are kept, and a constant
    column gives one bucket. Delays are whole minutes, so rows of a column of whole numbers
    are first counted per value; bounds and buckets come from those few counts and the data
    is read once. A continuous column has as many values as rows: its bounds are found
    first, and a second reading counts rows per bucket, so that a task sends on one row for
    each bucket and no more.
    """
    kept = between_open(df, column, low, high).select(F.col(column).cast("double").alias("value"))
    if dict(df.dtypes)[column] in WHOLE_NUMBERS:
        values = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    else:
        values = kept.withColumn("n", F.lit(1).cast("bigint"))
    # The bounds need the counts as well, so that both uses of counted values are one plan and share its shuffle.
    bounds = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("_n")).where(F.col("_n") > 0)
    width = (F.col("high") - F.col("low")) / F.lit(buckets)
    span = bounds.select(F.struct(F.col("low"), width.alias("width"))).scalar()
    low_of, width_of = span.getField("low"), span.getField("width")
    place = F.when(
        width_of > 0, F.least(F.floor((F.col("value") - low_of) / width_of), F.lit(buckets - 1))
    ).otherwise(0)
    counted = values.groupBy(place.cast("int").alias("bucket")).agg(F.sum("n").alias("n"))

    constant = F.col("low") == F.col("high")
    number = F.explode(F.sequence(F.lit(0), F.when(constant, 0).otherwise(buckets - 1)))
    edges = bounds.select("low", "high", number.alias("bucket")).select(
        "bucket",
        (F.col("low") + F.col("bucket") * width).alias("bucket_low"),
        F.when(constant | (F.col("bucket") == buckets - 1), F.col("high"))
        .otherwise(F.col("low") + (F.col("bucket") + 1) * width)
        .alias("bucket_high"),
    )
    return edges.join(counted, "bucket", "left").select(
        "bucket", "bucket_low", "bucket_high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def histogram_positions(histogram: DataFrame) -> DataFrame:
    """Left edge of each bar when bars are laid side by side from 0.

    Buckets are equally wide, so the sum of the widths before a bucket is a product.
    """
    width = F.col("bucket_high") - F.col("bucket_low")
    return histogram.select("bucket", (F.col("bucket") * width).alias("position"), width.alias("width"), "n")


def count_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return between_open(df, column, low, high).agg(F.count(F.lit(1)).alias("n"))
