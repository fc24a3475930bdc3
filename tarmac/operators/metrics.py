"""Scores of classification models from one count per (model, label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.handlers import DefaultHandler
from tarmac.operators.projections import resolve_path


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows per model, true and predicted class: the one pass over the predictions."""
    return predictions.groupBy(
        *by, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("rows"))


def weighted_metrics(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall and F1 per class, weighted by class size, and plain accuracy.

    Each count feeds its true class and its predicted class, so two small
    aggregates do and nothing is joined.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    none = F.lit(0).cast("bigint")
    roles = F.inline(
        F.array(
            F.struct(
                F.col("label").alias("class"),
                F.col("rows").alias("support"),
                hit.cast("bigint").alias("hits"),
                none.alias("predicted"),
            ),
            F.struct(
                F.col("prediction").alias("class"),
                none.alias("support"),
                none.alias("hits"),
                F.col("rows").alias("predicted"),
            ),
        )
    )
    per_class = counts.select(*by, roles).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted")
    )
    hits = F.col("hits").cast("double")
    precision = F.when(F.col("predicted") > 0, hits / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, hits / F.col("support")).otherwise(0.0)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    scored = per_class.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)

    def weighted(column: str):
        return F.sum(F.col(column) * F.col("support")) / F.sum("support")

    return scored.groupBy(*by).agg(
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("rows"),
    )


def confusion_matrix(
    counts: DataFrame, classes: Sequence[int], by: Sequence[str] = ("model",), compat: bool = False
) -> DataFrame:
    """A row per true class and a column `predicted_<class>` per class of the handler.

    `compat=True` keeps only classes that occur as true class, both ways: the columns
    of the others are null.
    """
    cells = counts.groupBy(*by, "label").pivot("prediction", list(classes)).agg(F.sum("rows"))
    matrix = cells.select(
        *by, "label", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"predicted_{c}") for c in classes]
    )
    if not compat:
        return matrix
    seen = matrix.groupBy(*by).agg(F.collect_set("label").alias("_seen"))
    return matrix.join(seen, list(by)).select(
        *by,
        "label",
        *[
            F.when(F.array_contains("_seen", c), F.col(f"predicted_{c}")).alias(f"predicted_{c}")
            for c in classes
        ],
    )


def distinct_class_labels(df: DataFrame, handler: DefaultHandler, label: str = "label") -> DataFrame:
    distinct = df.select(F.col(label).cast("int").alias("label")).distinct()
    return distinct.withColumn("label_text", handler.class_label(F.col("label")))


def class_balance(df: DataFrame, label: str = "classification") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("classification")).agg(F.count(F.lit(1)).alias("flights"))


def scatter_pairs(df: DataFrame, handler: DefaultHandler, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Class and two features of every flight, long form; features may be dotted paths."""
    return df.select(*keep, handler.classification().cast("int").alias("class"), resolve_path(x).alias("x"), resolve_path(y).alias("y"))


def scatter_sample(pairs: DataFrame, fractions: dict[int, float], seed: int = 42) -> DataFrame:
    """A share of each class, for display only."""
    return pairs.sampleBy("class", fractions, seed)
