"""Delay classes and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class texts shown to users, by class number.
FIVE_CLASS_LABELS = {
    0: "Canceled",
    1: "On Time",
    2: "Delayed less than 2 hours",
    3: "Delayed between 2 and 4 hours",
    4: "Delayed more than 4 hours",
}
THREE_CLASS_LABELS = {
    0: "Delayed less than 13 minutes",
    1: "Delayed between 13 and 41 minutes",
    2: "Delayed more than 41 minutes",
}
# The texts stored with a labelled flight.
FIVE_CLASS_MESSAGES = {
    0: "Canceled",
    1: "On Time",
    2: "Delay less 2 hours",
    3: "Delay between 2 and 4 hours",
    4: "Delay more than 4 hours",
}
# Upper bounds in minutes, exclusive.
FIVE_CLASS_BOUNDS = (15, 120, 240)
THREE_CLASS_BOUNDS = (13, 41)
CANCELED_STATUS = "C"


def classify5(delta: Column, status: Column, compat: bool = False) -> Column:
    """Class 0 for a cancelled flight, else 1 to 4 by minutes of delay.

    `compat=True` gives the labels of data sets built before the bound at 240
    minutes took effect: there every delay of 120 minutes or more is class 4.
    """
    on_time, two_hours, four_hours = FIVE_CLASS_BOUNDS
    by_delay = F.when(delta < on_time, 1).when(delta < two_hours, 2)
    if not compat:
        by_delay = by_delay.when(delta < four_hours, 3)
    return F.when(status == CANCELED_STATUS, 0).otherwise(by_delay.otherwise(4)).cast("int")


def classify3(delta: Column) -> Column:
    short, medium = THREE_CLASS_BOUNDS
    return F.when(delta < short, 0).when(delta < medium, 1).otherwise(2).cast("int")


def label_text(value: Column, labels: dict[int, str]) -> Column:
    """Text of a class number; a number without a text is passed through."""
    number = value.cast("int")
    text = F.lit(None).cast("string")
    for code, label in labels.items():
        text = F.when(number == code, F.lit(label)).otherwise(text)
    return F.coalesce(text, value.cast("string"))


def class_label5(value: Column) -> Column:
    return label_text(value, FIVE_CLASS_LABELS)


def class_label3(value: Column) -> Column:
    return label_text(value, THREE_CLASS_LABELS)


def class_message(value: Column) -> Column:
    return label_text(value, FIVE_CLASS_MESSAGES)


def is_on_time(prediction_text: Column) -> Column:
    return prediction_text == F.lit(FIVE_CLASS_LABELS[1])
