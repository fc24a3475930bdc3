"""Models recomputed: naive Bayes by its formula, trees by conditions, regression by its gradient."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import explained, histogram, models

WIDTH = 4


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        label = rng.choice([0, 2, 3])
        rows.append((i, float(label), [rng.choice([None, float(rng.randrange(12))]), rng.uniform(-5, 20) + label, rng.gauss(3 * label, 2), float(rng.randrange(3))]))
    return spark.createDataFrame(rows, "flight_id int, label double, features array<double>").persist()


def whole(v):
    return math.floor(max(v or 0.0, 0.0))


def test_naive_bayes_equals_its_formula(labelled):
    rows = labelled.collect()
    model = models.naive_bayes(WIDTH).fit(labelled)
    classes = sorted({r.label for r in rows})
    of = {c: [r for r in rows if r.label == c] for c in classes}
    prior = {c: math.log((len(of[c]) + 1) / (len(rows) + len(classes))) for c in classes}
    sums = {c: [sum(whole(r.features[i]) for r in of[c]) for i in range(WIDTH)] for c in classes}
    theta = {c: [math.log((s + 1) / (sum(sums[c]) + WIDTH)) for s in sums[c]] for c in classes}
    for r in model.transform(labelled).collect():
        score = {c: prior[c] + sum(whole(x) * t for x, t in zip(r.features, theta[c], strict=True)) for c in classes}
        assert math.isclose(score[r.prediction_naive_bayes], max(score.values()), rel_tol=1e-12)


def test_naive_bayes_equals_that_of_spark(labelled):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import array_to_vector

    dense = {0.0: 0.0, 2.0: 1.0, 3.0: 2.0}
    cleaned = labelled.select(
        "flight_id",
        F.create_map(*[F.lit(x) for pair in dense.items() for x in pair])[F.col("label")].alias("label"),
        array_to_vector(F.transform("features", lambda v: F.floor(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))).cast("double"))).alias("features"),
    )
    theirs = NaiveBayes(smoothing=1.0).fit(cleaned).transform(cleaned).select("flight_id", "prediction")
    ours = models.naive_bayes(WIDTH).fit(labelled).transform(labelled)
    both = ours.join(theirs, "flight_id").collect()
    assert {r.prediction_naive_bayes: dense[r.prediction_naive_bayes] for r in both}
    assert all(dense[r.prediction_naive_bayes] == r.prediction for r in both)


def test_naive_bayes_without_rows_or_features(spark, labelled):
    with pytest.raises(ValueError):
        models.naive_bayes(WIDTH).fit(labelled.limit(0))
    model = models.naive_bayes(WIDTH).fit(labelled)
    odd = spark.createDataFrame([(1, None), (2, [])], "flight_id int, features array<double>")
    assert len({r.prediction_naive_bayes for r in model.transform(odd).collect()}) == 1


def walk(node, values):
    while isinstance(node, tuple):
        feature, threshold, left, right = node
        node = left if (values[feature] or 0.0) <= threshold else right
    return [n / sum(node) for n in node]


@pytest.mark.parametrize("name", ["decision_tree", "random_forest"])
def test_trees_written_out_give_the_same_classes(labelled, name):
    pipeline = {"decision_tree": models.decision_tree(WIDTH), "random_forest": models.random_forest(WIDTH, trees=7)}[name]
    model = pipeline.fit(labelled)
    scored = explained.recomputed(model.transform(labelled), model, "again")
    rows = scored.collect()
    assert scored.columns == ["flight_id", "label", "features", f"prediction_{name}", "again"]
    assert all(r.again == r[f"prediction_{name}"] for r in rows)
    fitted = explained.classifier(model)
    trees = [explained.tree_nodes(t) for t in (fitted.trees if name == "random_forest" else [fitted])]
    for r in rows[:100]:
        votes = [sum(v) for v in zip(*(walk(t, r.features) for t in trees), strict=True)]
        assert r.again == votes.index(max(votes))


def test_gradient_is_near_zero_at_the_fitted_coefficients_only(labelled):
    good = models.logistic_regression(WIDTH, iterations=500).fit(labelled)
    poor = models.logistic_regression(WIDTH, iterations=1).fit(labelled)
    fitted, start = explained.loss_gradient(labelled, good)
    assert fitted < start / 100
    assert explained.loss_gradient(labelled, poor)[0] > 5 * fitted


def test_histogram_of_a_continuous_column(spark):
    rng = random.Random(2)
    values = [rng.uniform(0, 60) for _ in range(3000)] + [None, float("nan"), 13.0, 49.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    inside = [v for v in values if v is not None and 12 < v < 50]
    low, width = min(inside), (max(inside) - min(inside)) / 50
    expected = [0] * 50
    for v in inside:
        expected[min(49, math.floor((v - low) / width))] += 1
    found = histogram.delta_histogram(df, "v")
    assert [r.n for r in found.orderBy("bucket").collect()] == expected
    # A task sends on a row for each bucket, not for each value: the values are never grouped by.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [value#" not in plan
    assert [(r.bucket, r.n) for r in histogram.delta_histogram(df.where("v = 13"), "v").collect()] == [(0, 1)]
    assert histogram.delta_histogram(df.where("v is null"), "v").count() == 0
