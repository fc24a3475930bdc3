"""Trained models as plain column expressions, by which their predictions can be recomputed.

A tree becomes nested conditions, a forest the sum of its trees' class shares, and a
logistic regression the gradient of its loss, which is near zero where it was fitted well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import zero_if_missing


def classifier(model: PipelineModel):
    """The fitted classifier of a pipeline."""
    kinds = (DecisionTreeClassificationModel, RandomForestClassificationModel, LogisticRegressionModel)
    return next(s for s in model.stages if isinstance(s, kinds))


def tree_nodes(tree: DecisionTreeClassificationModel):
    """The tree as nested tuples: (feature, threshold, left, right), or the class counts of a leaf."""

    def node(java):
        if java.subtreeDepth() == 0:
            return list(java.impurityStats().stats())
        split = java.split()
        return split.featureIndex(), split.threshold(), node(java.leftChild()), node(java.rightChild())

    return node(tree._call_java("rootNode"))


def shares(node, values: Column) -> Column:
    """The class shares of the leaf that a row of values falls into."""
    if isinstance(node, tuple):
        feature, threshold, left, right = node
        return F.when(F.get(values, F.lit(feature)) <= F.lit(threshold), shares(left, values)).otherwise(shares(right, values))
    total = sum(node)
    return F.array(*[F.lit(n / total if total else 0.0) for n in node])


def largest(votes: Column) -> Column:
    """The place of the largest value, of equal ones the first."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def recomputed(df: DataFrame, model: PipelineModel, name: str, features: str = "features") -> DataFrame:
    """The prediction of a tree or forest as column `name`, without the model's own transform."""
    fitted = classifier(model)
    trees = fitted.trees if isinstance(fitted, RandomForestClassificationModel) else [fitted]
    columns = [f"_tree_{i}" for i in range(len(trees))]
    clean = df.withColumn("_x", F.transform(features, zero_if_missing))
    leaves = clean.select("*", *[shares(tree_nodes(t), F.col("_x")).alias(c) for t, c in zip(trees, columns, strict=True)])
    votes = [_sum([F.get(c, F.lit(k)) for c in columns]) for k in range(fitted.numClasses)]
    return leaves.withColumn(name, largest(F.array(*votes))).drop("_x", *columns)


def _sum(values: Sequence[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total


def loss_gradient(labelled: DataFrame, model: PipelineModel) -> tuple[float, float]:
    """Length of the gradient of the mean log-loss at the fitted coefficients, and at coefficients of zero.

    By features scaled to deviation one, as the regression is fitted; one aggregate over
    (label, features). Without a penalty the first is near zero beside the second.
    """
    fitted = classifier(model)
    weights, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    classes, width = weights.shape
    clean = labelled.withColumn("_x", F.transform("features", zero_if_missing))
    x = [F.get("_x", F.lit(i)) for i in range(width)]
    logits = [_sum([F.lit(float(intercepts[c])), *[F.lit(float(weights[c, i])) * x[i] for i in range(width)]]) for c in range(classes)]
    scored = clean.withColumn("_logits", F.array(*logits)).withColumn("_top", F.array_max("_logits"))
    scored = scored.withColumn("_e", F.transform("_logits", lambda v: F.exp(v - F.col("_top")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
    hit = [(F.col("label") == c).cast("double") for c in range(classes)]
    terms = [
        F.avg((start - hit[c]) * x[i]).alias(f"{kind}_{c}_{i}")
        for c in range(classes)
        for i in range(width)
        for kind, start in (("fit", F.get("_e", F.lit(c)) / F.col("_z")), ("zero", F.lit(1.0 / classes)))
    ]
    row = scored.agg(*terms, *[F.stddev_samp(x[i]).alias(f"dev_{i}") for i in range(width)]).first()

    def length(kind: str) -> float:
        scaled = [row[f"{kind}_{c}_{i}"] / row[f"dev_{i}"] for c in range(classes) for i in range(width) if row[f"dev_{i}"]]
        return math.sqrt(sum(g * g for g in scaled))

    return length("fit"), length("zero")
