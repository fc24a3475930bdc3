"""The four classifiers as Spark pipelines, and a registry of trained ones."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.features import ATTRIBUTES
from tarmac.operators.handlers import DefaultHandler

# How a model wants missing values, as SQL over one array element `v`.
_CLEANING = {
    "zero": "nanvl(coalesce({v}, 0D), 0D)",
    "whole": "double(floor(greatest(nanvl(coalesce({v}, 0D), 0D), 0D)))",
}
# Every model writes its own column next to the others.
_HIDDEN = {"rawPredictionCol": "", "probabilityCol": ""}


def _pipeline(classifier, name: str, cleaning: str, width: int) -> Pipeline:
    """Features to vector, classifier, and only the prediction column left over.

    The array is cleaned by `transform`, where generated code ends: with the cleaning of
    several models in it, one method has more than the 8000 bytes that the JVM compiles.
    Models that clean alike have the same first two stages and the same last one, so that
    `train_all` and `score` make the vectors once for all of them.
    """
    array, vector = f"_{cleaning}_cleaned", f"_{cleaning}_vector"
    inputs = [f"_{cleaning}_{i}" for i in range(width)]
    cleaned = _CLEANING[cleaning].format(v="v")
    elements = ", ".join(f"coalesce(get({array}, {i}), 0D) AS {column}" for i, column in enumerate(inputs))
    inner = f"SELECT *, transform(features, v -> {cleaned}) AS {array} FROM __THIS__"
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT * EXCEPT ({array}), {elements} FROM ({inner})"),
            VectorAssembler(inputCols=inputs, outputCol=vector),
            classifier.setFeaturesCol(vector).setPredictionCol(prediction_column(name)),
            SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join([*inputs, vector])}) FROM __THIS__"),
        ]
    )


def prediction_column(name: str) -> str:
    return f"prediction_{name}"


def logistic_regression(width: int, iterations: int = 1000, intercept: bool = False) -> Pipeline:
    """Multinomial, unregularised L-BFGS."""
    classifier = LogisticRegression(
        family="multinomial", maxIter=iterations, fitIntercept=intercept, regParam=0.0, **_HIDDEN
    )
    return _pipeline(classifier, "logistic_regression", "zero", width)


class NaiveBayesByCounts:
    """Multinomial naive Bayes, smoothing 1, from one aggregate.

    The rows of each class and the sums of its features are all that the model needs; its
    log-probabilities follow from them in closed form. Only classes that occur are known,
    under their own numbers. The model is a projection: for each class the sum of its
    log-prior and of feature times log-probability, in the order of the features; the
    class with the largest sum, of equal ones the smallest, is predicted.
    """

    def __init__(self, width: int):
        self.width = width

    def statistics(self, labelled: DataFrame) -> DataFrame:
        """label, rows, sum_0, sum_1, ...: one row per class."""
        values = [F.expr(_CLEANING["whole"].format(v=f"get(features, {i})")) for i in range(self.width)]
        sums = [F.sum(v).alias(f"sum_{i}") for i, v in enumerate(values)]
        return labelled.where(F.col("label").isNotNull()).groupBy(F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("rows"), *sums)

    def weights(self, statistics: Sequence[Row]) -> list[tuple[float, float, list[float]]]:
        """Class, log-prior and log-probabilities of the features, in the order of the classes."""
        total = sum(r["rows"] for r in statistics)
        out = []
        for r in sorted(statistics, key=lambda r: r["label"]):
            sums = [r[f"sum_{i}"] for i in range(self.width)]
            prior = math.log(r["rows"] + 1.0) - math.log(total + len(statistics))
            out.append((r["label"], prior, [math.log(x + 1.0) - math.log(sum(sums) + self.width) for x in sums]))
        return out

    def fit(self, labelled: DataFrame) -> PipelineModel:
        weights = self.weights(self.statistics(labelled).collect())
        if not weights:
            raise ValueError("no row has a label")
        cleaned = _CLEANING["whole"].format(v="v")
        scores = [
            f"named_struct('score', {prior!r}D" + "".join(f" + coalesce(get(_nb, {i}), 0D) * {t!r}D" for i, t in enumerate(thetas)) + f", 'place', {-n})"
            for n, (_, prior, thetas) in enumerate(weights)
        ]
        classes = ", ".join(f"{c!r}D" for c, _, _ in weights)
        inner = f"SELECT *, transform(features, v -> {cleaned}) AS _nb FROM __THIS__"
        best = f"get(array({classes}), -array_max(array({', '.join(scores)})).place)"
        return PipelineModel([SQLTransformer(statement=f"SELECT * EXCEPT (_nb), {best} AS {prediction_column('naive_bayes')} FROM ({inner})")])


def naive_bayes(width: int) -> NaiveBayesByCounts:
    return NaiveBayesByCounts(width)


def decision_tree(width: int) -> Pipeline:
    classifier = DecisionTreeClassifier(maxDepth=5, maxBins=32, impurity="gini", seed=42, **_HIDDEN)
    return _pipeline(classifier, "decision_tree", "zero", width)


def random_forest(width: int, trees: int = 100) -> Pipeline:
    classifier = RandomForestClassifier(numTrees=trees, maxDepth=4, maxBins=32, impurity="gini", seed=42, **_HIDDEN)
    return _pipeline(classifier, "random_forest", "zero", width)


MODELS = {
    "naive_bayes": naive_bayes,
    "decision_tree": decision_tree,
    "logistic_regression": logistic_regression,
    "random_forest": random_forest,
}


def with_classes(labelled: DataFrame, handler: DefaultHandler) -> DataFrame:
    """State the handler's classes on the label, so that none need occur in the data."""
    values = [str(float(c)) for c in handler.classes()]
    return labelled.withColumn(
        "label", F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": values}})
    )


def feature_width(handler: DefaultHandler | None = None) -> int:
    return 2 * len(ATTRIBUTES) + len((handler or DefaultHandler()).extra_features())


def train(labelled: DataFrame, name: str, handler: DefaultHandler | None = None, **options) -> PipelineModel:
    """Train one of MODELS on (label, features)."""
    handler = handler or DefaultHandler()
    pipeline = MODELS[name](feature_width(handler), **options)
    if name == "naive_bayes":
        return pipeline.fit(labelled)
    return pipeline.fit(with_classes(labelled, handler))


def train_all(
    labelled: DataFrame, handler: DefaultHandler | None = None, names: Iterable[str] = tuple(MODELS), **options
) -> ModelRegistry:
    """Train several models; labels and vectors are made once and persisted for those that clean alike.

    `labelled` is read once for each cleaning and once by naive Bayes: write it first if it is costly.
    """
    handler = handler or DefaultHandler()
    held, trained = {}, {}
    try:
        for name in names:
            chosen = options.get(name, {})
            if name == "naive_bayes":
                trained[name] = train(labelled, name, handler, **chosen)
                continue
            clean, assemble, classifier, drop = MODELS[name](feature_width(handler), **chosen).getStages()
            vector = assemble.getOutputCol()
            if vector not in held:
                vectors = assemble.transform(clean.transform(with_classes(labelled, handler)))
                held[vector] = vectors.select("label", vector).persist()
            trained[name] = PipelineModel([clean, assemble, classifier.fit(held[vector]), drop])
        return ModelRegistry(trained)
    finally:
        for vectors in held.values():
            vectors.unpersist()


class ModelRegistry:
    """Trained models by name, in the order in which they vote."""

    def __init__(self, models: Mapping[str, PipelineModel] | None = None):
        self.models = dict(models or {})

    def register(self, name: str, model: PipelineModel) -> ModelRegistry:
        self.models[name] = model
        return self

    def require(self) -> Mapping[str, PipelineModel]:
        if not self.models:
            raise ValueError("no trained models are registered")
        return self.models

    def predictions(self) -> list[Column]:
        return [F.col(prediction_column(n)) for n in self.require()]

    def save(self, spark: SparkSession, path: str) -> None:
        for position, (name, model) in enumerate(self.require().items()):
            model.write().overwrite().save(f"{path}/{position:03d}-{name}")
        names = [(position, name) for position, name in enumerate(self.models)]
        spark.createDataFrame(names, "position int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelRegistry:
        names = spark.read.schema("position int, name string").json(f"{path}/names").orderBy("position").collect()
        return cls({r.name: PipelineModel.load(f"{path}/{r.position:03d}-{r.name}") for r in names})


def score(df: DataFrame, registry: ModelRegistry) -> DataFrame:
    """A prediction column per model. A projection over the rows: no shuffle.

    Models with the same preparing stages predict from the same vectors, which are made once.
    """
    drops = {}
    for model in registry.require().values():
        if not _has_vectors(model):
            df = model.transform(df)
            continue
        clean, assemble, classifier, drop = model.stages
        vector = (clean.getStatement(), assemble.getOutputCol())
        if vector not in drops:
            df = assemble.transform(clean.transform(df))
            drops[vector] = drop
        df = classifier.transform(df)
    for drop in drops.values():
        df = drop.transform(df)
    return df


def _has_vectors(model: PipelineModel) -> bool:
    """The model is one of `_pipeline`."""
    return len(model.stages) == 4 and isinstance(model.stages[1], VectorAssembler)


def long_predictions(scored: DataFrame, registry: ModelRegistry, keep: Iterable[str] = ()) -> DataFrame:
    """One row per flight and model."""
    entries = [
        F.struct(
            F.lit(name).alias("model"),
            F.lit(position).alias("model_pos"),
            F.col(prediction_column(name)).cast("int").alias("prediction"),
        )
        for position, name in enumerate(registry.require(), start=1)
    ]
    return scored.select(*keep, F.inline(F.array(*entries)))
