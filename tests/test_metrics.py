import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tarmac.functions.classify import class_label5
from tarmac.operators import histogram, metrics, routes, voting
from tarmac.operators.handlers import DefaultHandler, ThreeClassHandler
from tarmac.operators.projections import endpoints


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(5)
    data = [("m1", rng.choice([0, 1, 1, 2]), rng.choice([0, 1, 2, 4])) for _ in range(300)]
    data += [("m2", label, 3) for _, label, _ in data[:100]]
    return spark.createDataFrame(data, "model string, label int, prediction int")


def test_weighted_scores_equal_spark(predictions):
    ours = {r.model: r for r in metrics.weighted_metrics(metrics.confusion_counts(predictions)).collect()}
    for model in ("m1", "m2"):
        pairs = predictions.where(F.col("model") == model).select(F.col("label").cast("double"), F.col("prediction").cast("double"))
        for name, ours_name in (
            ("weightedPrecision", "weighted_precision"),
            ("weightedRecall", "weighted_recall"),
            ("f1", "weighted_f1"),
            ("accuracy", "accuracy"),
        ):
            assert ours[model][ours_name] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(pairs))


def test_binary_labels_of_documents(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(
        F.lit("m").alias("model"), F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )
    ours = metrics.weighted_metrics(metrics.confusion_counts(labels)).first()
    pairs = labels.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    assert ours.weighted_f1 == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(pairs))


def test_matrix_holds_every_row_and_class(predictions):
    counts = metrics.confusion_counts(predictions)
    matrix = metrics.confusion_matrix(counts, DefaultHandler().classes()).collect()
    assert sum(r[f"predicted_{c}"] for r in matrix for c in range(5)) == predictions.count()
    compat = metrics.confusion_matrix(counts, DefaultHandler().classes(), compat=True).collect()
    assert all(r.predicted_4 is None and r.predicted_3 is None and r.predicted_0 is not None for r in compat)


def test_distinct_labels(predictions):
    got = {(r.label, r.label_text) for r in metrics.distinct_class_labels(predictions, ThreeClassHandler()).collect()}
    assert (1, "Delayed between 13 and 41 minutes") in got and len(got) == 3


def votes(rows, *predictions):
    made = rows([("f", i, p) for i, p in enumerate(predictions, 1)], "flight_id string, model_pos int, prediction int")
    long = voting.ensemble_vote(made, class_label5).first().overall
    wide = made.groupBy("flight_id").pivot("model_pos", list(range(1, len(predictions) + 1))).agg(F.first("prediction"))
    in_row = wide.select(voting.vote_in_row([F.col(str(i)) for i in range(1, len(predictions) + 1)], class_label5)).first()[0]
    assert long == in_row
    return long


@pytest.mark.parametrize(
    "predictions, overall",
    [
        ((1, 1, 2, 4), "On Time"),
        ((2, 1, 1, 2), "Undecided: Delayed less than 2 hours/On Time"),
        ((0, 1, 2), "Undecided: Canceled/On Time"),
        ((4, 3, 2, 1), "Undecided: Delayed more than 4 hours/Delayed between 2 and 4 hours"),
        ((1,), "On Time"),
        ((2, 4, 4), "Delayed more than 4 hours"),
    ],
)
def test_votes(rows, predictions, overall):
    assert votes(rows, *predictions) == overall


def test_histogram_equals_rdd_histogram(spark):
    rng = random.Random(1)
    values = [rng.randrange(0, 60) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "delta int")
    got = histogram.delta_histogram(df, "delta").orderBy("bucket").collect()
    bounds, counts = spark.sparkContext.parallelize([v for v in values if 12 < v < 50]).histogram(50)
    assert [r.n for r in got] == counts
    assert [r.bucket_low for r in got] + [got[-1].bucket_high] == pytest.approx(bounds)
    bars = histogram.histogram_positions(histogram.delta_histogram(df, "delta")).orderBy("bucket").collect()
    widths = [b - a for a, b in zip(bounds, bounds[1:])]
    assert [r.position for r in bars] == pytest.approx([sum(widths[:i]) for i in range(50)])


def test_histogram_of_constant_and_of_nothing(rows):
    constant = histogram.delta_histogram(rows([(20,), (20,), (99,)], "delta int"), "delta").collect()
    assert [(r.bucket, r.bucket_low, r.bucket_high, r.n) for r in constant] == [(0, 20.0, 20.0, 2)]
    assert histogram.delta_histogram(rows([(99,)], "delta int"), "delta").collect() == []


LINKS = [("A", "B"), ("A", "B"), ("A", "A"), ("B", "C"), (None, "C")]


def test_route_graph(rows):
    links = rows(LINKS, "src string, dst string")
    counts = {(r.src, r.dst): r["count"] for r in routes.route_counts(links).collect()}
    assert counts == {("A", "B"): 2, ("A", "A"): 1, ("B", "C"): 1, (None, "C"): 0}
    whole = links.dropna()
    assert {r.airport: r.degree for r in routes.airport_degree(whole).collect()} == {"A": 3, "B": 2, "C": 1}
    assert {r.src: r.destinations for r in routes.adjacency_list(whole).collect()} == {"A": "A,B", "B": "C"}
    nodes = endpoints(whole, {"code": "src"}, {"code": "dst"}).distinct()
    assert {r.code: r.is_origin for r in routes.origin_flag(nodes, whole).collect()} == {"A": True, "B": True, "C": False}
    ranked = routes.rank_airports(routes.airport_degree(whole)).collect()
    assert [(r["rank"], r.airport) for r in ranked] == [(1, "A"), (2, "B"), (3, "C")]


def test_nodes_are_cleaned(rows):
    history = rows(
        [("GRU", 'São "Paulo"', None, 1.5, "BOS", "Logan", 42.0, -71.0)] * 2,
        "d string, dn string, dlat double, dlon double, a string, an string, alat double, alon double",
    )
    ends = [
        {"code": "d", "name": "dn", "latitude": "dlat", "longitude": "dlon"},
        {"code": "a", "name": "an", "latitude": "alat", "longitude": "alon"},
    ]
    nodes = routes.airport_nodes(history, *ends)
    assert sorted(map(tuple, nodes.collect())) == [("BOS", "Logan", 42.0, -71.0), ("GRU", 'So "Paulo"', 0.0, 1.5)]
    text = {r.id: r.node for r in routes.node_json(nodes).collect()}
    assert text["GRU"] == '{"id":"GRU","name":"So \\"Paulo\\"","latitude":0.0,"longitude":1.5}'


def test_badge_needs_both_codes(rows):
    history = rows([("BOS", "LAS", "NK", "1")] * 3 + [("BOS", "SEA", "NK", "1")], "dep string, arr string, carrier string, number string")
    options = {"keys": ("carrier", "number"), "dep": "dep", "arr": "arr"}
    assert [r.passengers for r in routes.route_badge(history, "BOS", "LAS", **options).collect()] == [3]
    assert routes.route_badge(history, **options).count() == 2
    with pytest.raises(ValueError):
        routes.route_badge(history, "BOS", **options)
