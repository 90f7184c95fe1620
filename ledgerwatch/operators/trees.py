"""Boosted trees as tables of nodes: read from a model, made into one, and compiled to SQL expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import combinations
from math import factorial

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.model import FraudModel
from ledgerwatch.workspace import new_dir

MARGIN_TO_LOG_ODDS = 2.0  # the booster's margin is half the log-odds

NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int,"
    " rightChild int, split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


@dataclass(frozen=True)
class Node:
    """A split (values up to ``threshold`` go left) or, where ``left`` is negative, a leaf. ``cover``: training rows."""

    cover: int
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1


@dataclass(frozen=True)
class Ensemble:
    """Trees of nodes by place (the root first), their weights, the feature names, the decision threshold."""

    trees: tuple[tuple[Node, ...], ...]
    weights: tuple[float, ...]
    features: tuple[str, ...]
    threshold: float = 0.5


def read_ensemble(model: FraudModel) -> Ensemble:
    """The trees of a trained model: at most trees x 2^(depth + 1) nodes reach the driver."""
    spark = SparkSession.getActiveSession()
    path = new_dir(spark, "trees")
    model.classifier.write().save(path)
    node = F.col("nodeData")
    rows = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            node["id"].alias("id"),
            node["prediction"].alias("value"),
            node["rawCount"].alias("cover"),
            node["leftChild"].alias("left"),
            node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        )
        .orderBy("treeID", "id")
        .collect()
    )
    trees: dict[int, list[Node]] = {}
    for r in rows:
        leaf = r["left"] < 0
        split = {} if leaf else {"feature": r["feature"], "threshold": r["threshold"], "left": r["left"], "right": r["right"]}
        trees.setdefault(r["treeID"], []).append(Node(r["cover"], r["value"], **split))
    weights = tuple(model.classifier.treeWeights)
    return Ensemble(tuple(tuple(trees[i]) for i in range(len(weights))), weights, model.features, model.threshold)


def to_model(spark: SparkSession, ensemble: Ensemble) -> FraudModel:
    """A model with the given trees, by way of the stored form that Spark ML reads."""
    path = new_dir(spark, "imported")
    rows = [
        (t, (i, n.value, 0.0, [float(n.cover), n.value * n.cover, 0.0], n.cover, -1.0, n.left, n.right, (n.feature, [n.threshold] if n.left >= 0 else [], -1)))
        for t, tree in enumerate(ensemble.trees)
        for i, n in enumerate(tree)
    ]
    spark.createDataFrame(rows, f"treeID int, nodeData struct<{NODE}>").coalesce(1).write.parquet(f"{path}/data")
    booster = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=len(ensemble.trees))
    said = _metadata(spark, booster, "classification.GBTClassificationModel")
    said |= {"numFeatures": len(ensemble.features), "numTrees": len(ensemble.trees)}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = DecisionTreeRegressor(featuresCol="_features", labelCol="_label")
    trees = [(t, json.dumps(_metadata(spark, one, "regression.DecisionTreeRegressionModel", t)), w) for t, w in enumerate(ensemble.weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return FraudModel(GBTClassificationModel.load(path), ensemble.features, ensemble.threshold)


def _metadata(spark: SparkSession, estimator, kind: str, number: int = 0) -> dict:
    return {
        "class": f"org.apache.spark.ml.{kind}",
        "timestamp": 0,
        "sparkVersion": spark.version,
        "uid": f"{estimator.uid}_{number}",
        "paramMap": {p.name: v for p, v in estimator._paramMap.items()},
        "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()},
    }


def node_table(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """One row per node: (tree, id, feature, threshold, left_child, right_child, value, cover); leaves without a split."""
    rows = []
    for t, tree in enumerate(ensemble.trees):
        for i, n in enumerate(tree):
            split = (ensemble.features[n.feature], n.threshold, n.left, n.right) if n.left >= 0 else (None,) * 4
            rows.append((t, i, *split, n.value, n.cover))
    kinds = "tree int, id int, feature string, threshold double, left_child int, right_child int, value double, cover long"
    return spark.createDataFrame(rows, kinds)


def _input(name: str, quote: str) -> str:
    """A feature as the model sees it: single precision."""
    return f"cast(cast({quote}{name}{quote} as float) as double)"


def tree_sql(ensemble: Ensemble, tree: int, known: frozenset[int] | None = None, quote: str = "`") -> str:
    """A tree's value as nested CASE expressions.

    With ``known``, its expectation when only these features are known: other splits weigh both sides by cover.
    """
    nodes = ensemble.trees[tree]

    def say(i: int) -> str:
        n = nodes[i]
        if n.left < 0:
            return f"cast({n.value!r} as double)"
        left, right = say(n.left), say(n.right)
        if known is None or n.feature in known:
            limit = f"cast({n.threshold!r} as double)"
            return f"(case when {_input(ensemble.features[n.feature], quote)} <= {limit} then {left} else {right} end)"
        share = nodes[n.left].cover / (nodes[n.left].cover + nodes[n.right].cover)
        return f"(cast({share!r} as double) * {left} + cast({1 - share} as double) * {right})"

    return say(0)


def log_odds_sql(ensemble: Ensemble, quote: str = "`") -> str:
    terms = [f"cast({MARGIN_TO_LOG_ODDS * w!r} as double) * {tree_sql(ensemble, t, quote=quote)}" for t, w in enumerate(ensemble.weights)]
    return "(" + " + ".join(terms) + ")"


def probability_sql(ensemble: Ensemble, quote: str = "`") -> str:
    """The score as an expression; for ensembles small enough to be written out (some thousands of leaves)."""
    return f"(1 / (1 + exp(-{log_odds_sql(ensemble, quote)})))"


def base_value(ensemble: Ensemble) -> float:
    """The expected log-odds when no feature is known."""

    def expected(nodes: tuple[Node, ...], i: int) -> float:
        n = nodes[i]
        if n.left < 0:
            return n.value
        a, b = nodes[n.left].cover, nodes[n.right].cover
        return (a * expected(nodes, n.left) + b * expected(nodes, n.right)) / (a + b)

    return sum(MARGIN_TO_LOG_ODDS * w * expected(t, 0) for t, w in zip(ensemble.trees, ensemble.weights, strict=True))


def attribution_sql(ensemble: Ensemble, feature: int, quote: str = "`") -> str:
    """A feature's Shapley value by its definition: over all sets of the other features that a tree uses.

    Grows with 2^features per tree: for small trees, and to check the faster sums of ``attribution``.
    """
    terms = []
    for t, weight in enumerate(ensemble.weights):
        used = sorted({n.feature for n in ensemble.trees[t] if n.left >= 0})
        if feature not in used:
            continue
        others, m = [f for f in used if f != feature], len(used)
        for k in range(m):
            part = MARGIN_TO_LOG_ODDS * weight * factorial(k) * factorial(m - k - 1) / factorial(m)
            for some in combinations(others, k):
                with_it = tree_sql(ensemble, t, frozenset({*some, feature}), quote)
                without = tree_sql(ensemble, t, frozenset(some), quote)
                terms.append(f"cast({part!r} as double) * ({with_it} - {without})")
    return "(" + " + ".join(terms) + ")" if terms else "cast(0 as double)"
