"""Train on one data set, evaluate on another, compare handlers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.features import labelled_set
from tarmac.operators.handlers import DefaultHandler
from tarmac.operators.metrics import confusion_counts, weighted_metrics
from tarmac.operators.models import MODELS, ModelRegistry, long_predictions, score, train_all
from tarmac.operators.projections import in_data_set
from tarmac.session import written


def score_labelled(
    flights: DataFrame, registry: ModelRegistry, handler: DefaultHandler | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Label and one prediction column per model for each flight, on the same row."""
    return score(labelled_set(flights, handler, keep), registry)


def prediction_counts(flights: DataFrame, registry: ModelRegistry, handler: DefaultHandler | None = None) -> DataFrame:
    """Counts per (model, label, prediction), from one pass over the flights.

    Both `weighted_metrics` and `confusion_matrix` start from them.
    """
    return confusion_counts(long_predictions(score_labelled(flights, registry, handler), registry, ["label"]))


def evaluate(flights: DataFrame, registry: ModelRegistry, handler: DefaultHandler | None = None) -> DataFrame:
    """Weighted scores of every model."""
    return weighted_metrics(prediction_counts(flights, registry, handler))


def compare_handlers(
    flights: DataFrame,
    handlers: Iterable[DefaultHandler],
    airport: str,
    sets: Mapping[str, Sequence[str]],
    training: str = "training",
    test: str = "test",
    names: Iterable[str] = tuple(MODELS),
    materialise: bool = True,
    **options,
) -> DataFrame:
    """Scores on the held-out set by (handler, model), retraining for each handler.

    Every handler reads the flights anew, so they are written once first.
    """
    if materialise:
        flights = written(flights, "compare")
    train_flights = in_data_set(flights, airport, training, sets)
    test_flights = in_data_set(flights, airport, test, sets)
    results = []
    for handler in handlers:
        registry = train_all(labelled_set(train_flights, handler), handler, tuple(names), **options)
        results.append(evaluate(test_flights, registry, handler).withColumn("handler", F.lit(handler.name)))
    return reduce(DataFrame.unionByName, results)
