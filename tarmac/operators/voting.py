"""One overall prediction from the predictions of several models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(ranked: Column, label: Callable[[Column], Column]) -> Column:
    """Text for an array of struct(votes, first, prediction), best first."""
    top, other = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    tied = F.coalesce(top["votes"] == other["votes"], F.lit(False))
    undecided = F.concat(F.lit("Undecided: "), label(top["prediction"]), F.lit("/"), label(other["prediction"]))
    return F.when(tied, undecided).otherwise(label(top["prediction"]))


def _best_first(entries: Column) -> Column:
    """Most votes first; among equals the class predicted first."""
    keyed = F.transform(
        entries,
        lambda e: F.struct(
            (-e["votes"]).alias("order"),
            e["first"].alias("first"),
            e["votes"].alias("votes"),
            e["prediction"].alias("prediction"),
        ),
    )
    return F.array_sort(keyed)


def vote_in_row(predictions: Sequence[Column], label: Callable[[Column], Column]) -> Column:
    """Vote over one prediction column per model, in model order. No shuffle."""
    votes = F.array(*[p.cast("int") for p in predictions])
    entries = F.transform(
        F.array_distinct(votes),
        lambda p: F.struct(
            F.size(F.filter(votes, lambda v: v == p)).alias("votes"),
            F.array_position(votes, p).alias("first"),
            p.alias("prediction"),
        ),
    )
    return verdict(_best_first(entries), label)


def ensemble_vote(
    predictions: DataFrame,
    label: Callable[[Column], Column],
    keys: Sequence[str] = ("flight_id",),
    prediction: str = "prediction",
    position: str = "model_pos",
) -> DataFrame:
    """Vote over long predictions, one row per flight and model.

    Votes are counted per class first, so a flight gathers one entry per class. Both
    aggregates are by flight, so one shuffle serves them.
    """
    per_class = predictions.repartition(*keys).groupBy(*keys, prediction).agg(
        F.count(F.lit(1)).alias("votes"), F.min(position).alias("first")
    )
    entry = F.struct("votes", "first", F.col(prediction).alias("prediction"))
    ranked = per_class.groupBy(*keys).agg(_best_first(F.collect_list(entry)).alias("_ranked"))
    return ranked.select(*keys, verdict(F.col("_ranked"), label).alias("overall"))
