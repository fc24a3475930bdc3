"""Training handlers: how flights are classed and which features are added.

A handler returns Column expressions, so whatever it computes is part of the query
plan. `row_function` is the way out for Python code that has no such expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.classify import FIVE_CLASS_LABELS, THREE_CLASS_LABELS, classify3, label_text
from tarmac.functions.timecols import weekday_onehot


class DefaultHandler:
    """Five classes, as stored with the flight; no features beyond the weather."""

    name = "default"
    labels = FIVE_CLASS_LABELS

    def num_classes(self) -> int:
        return len(self.labels)

    def classes(self) -> list[int]:
        return list(self.labels)

    def class_label(self, value: Column) -> Column:
        return label_text(value, self.labels)

    def classification(self) -> Column:
        return F.col("classification")

    def extra_columns(self) -> Sequence[str]:
        """Input columns the handler needs beyond the weather."""
        return ()

    def extra_features(self) -> Sequence[Column]:
        """Numeric features added after the weather, in order."""
        return ()


class WeekdayHandler(DefaultHandler):
    """Five classes, with the weekday of departure as seven features."""

    name = "weekday"

    def __init__(self, departure: str = "departureTime"):
        self.departure = departure

    def extra_columns(self) -> Sequence[str]:
        return (self.departure,)

    def extra_features(self) -> Sequence[Column]:
        return weekday_onehot(F.col(self.departure).cast("timestamp_ntz"))


class ThreeClassHandler(WeekdayHandler):
    """Three classes by minutes of delay, with the weekday features."""

    name = "three_class"
    labels = THREE_CLASS_LABELS

    def classification(self) -> Column:
        return classify3(F.col("deltaDeparture"))


def apply_handler(df: DataFrame, handler: DefaultHandler) -> DataFrame:
    """The handler's class and its text for each flight."""
    label = handler.classification()
    return df.withColumn("label", label.cast("int")).withColumn("label_text", handler.class_label(label))


def row_function(function: Callable[[pd.DataFrame], pd.Series], return_type: str) -> Callable[..., Column]:
    """A Python function over batches of rows, as a column expression.

    `function` gets a pandas frame with the columns it is called with and returns
    one value per row; Spark sends it Arrow batches.
    """

    @F.pandas_udf(return_type)
    def batches(rows: pd.DataFrame) -> pd.Series:
        return function(rows)

    return lambda *columns: batches(F.struct(*columns))
