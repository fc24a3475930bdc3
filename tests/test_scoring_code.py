"""Scoring with all models at once stays in methods that the JVM compiles."""

import random
import re

import pytest

from tarmac.operators import models

#: Bytes of a method beyond which the JVM interprets it.
COMPILED = 8000


@pytest.fixture(scope="module")
def registry_and_rows(spark):
    rng = random.Random(3)
    width = models.feature_width()
    rows = [(i, float(i % 5), [rng.choice([None, rng.gauss(i % 5, 2)]) for _ in range(width)]) for i in range(200)]
    labelled = spark.createDataFrame(rows, "flight_id int, label double, features array<double>")
    return models.train_all(labelled, logistic_regression={"iterations": 3}, random_forest={"trees": 3}), labelled


def test_no_method_of_the_scoring_is_too_long(registry_and_rows, capsys):
    registry, labelled = registry_and_rows
    assert list(registry.models) == list(models.MODELS)
    scored = models.score(labelled, registry)
    scored.explain(mode="codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED
    assert scored.columns == ["flight_id", "label", "features", *[models.prediction_column(n) for n in models.MODELS]]


def test_missing_values_score_as_zero(spark, registry_and_rows):
    registry, _ = registry_and_rows
    width = models.feature_width()
    zeros, nan = [0.0] * width, float("nan")
    rows = [(0, zeros), (1, [None] * width), (2, [nan] * width), (3, zeros[:3]), (4, []), (5, None)]
    scored = models.score(spark.createDataFrame(rows, "flight_id int, features array<double>"), registry)
    names = [models.prediction_column(n) for n in models.MODELS if n != "naive_bayes"]
    assert len({tuple(r[n] for n in names) for r in scored.collect()}) == 1


def test_models_that_clean_alike_share_their_vectors(registry_and_rows, capsys):
    registry, labelled = registry_and_rows
    models.score(labelled, registry).explain(mode="extended")
    optimised = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # One for naive Bayes, one for the three others.
    assert optimised.count("transform(features") == 2


def test_sharing_changes_no_prediction(registry_and_rows):
    registry, labelled = registry_and_rows
    alone = {"logistic_regression": {"iterations": 3}, "random_forest": {"trees": 3}}
    shared = {r.flight_id: r for r in models.score(labelled, registry).collect()}
    for name in models.MODELS:
        column = models.prediction_column(name)
        by_itself = models.train(labelled, name, **alone.get(name, {})).transform(labelled).collect()
        assert len(by_itself) == 200 and all(r[column] == shared[r.flight_id][column] for r in by_itself), name


def test_training_releases_what_it_held(spark, registry_and_rows):
    _, labelled = registry_and_rows
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    models.train_all(labelled, names=("decision_tree", "naive_bayes"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
