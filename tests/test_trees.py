"""Trees as tables and expressions; attributions against their definition, deep trees included."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import attribution, model as M, trees
from ledgerwatch.operators.trees import Ensemble, Node
from ledgerwatch.registry.given_model import GIVEN

ROWS = 300


def rows_of(spark, features):
    columns = [((F.col("id") * (37 + 10 * i)) % (101 + i)).cast("double").alias(f) for i, f in enumerate(features)]
    return spark.range(ROWS).select(F.col("id").alias("key"), *columns)


def test_model_and_table_are_one(spark):
    model = trees.to_model(spark, GIVEN)
    again = trees.read_ensemble(model)
    assert again == GIVEN
    table = trees.node_table(spark, GIVEN)
    assert table.count() == sum(map(len, GIVEN.trees))
    assert table.where("feature is null").count() == sum(n.left < 0 for t in GIVEN.trees for n in t)


def test_trained_trees_as_columns(spark):
    df = rows_of(spark, ("a", "b")).withColumn("isFraud", ((F.col("a") > 50) & (F.col("b") < 60)).cast("byte"))
    model = M.train(df, ("a", "b"), trees=5, depth=3)
    ensemble = trees.read_ensemble(model)
    both = M.score(df, model).withColumn("said", F.expr(trees.probability_sql(ensemble)))
    assert both.where("abs(score - said) > 1e-12").count() == 0
    again = M.score(df, trees.to_model(spark, ensemble), "again").join(M.score(df, model), "key")
    assert again.where("abs(score - again) > 1e-12").count() == 0


def test_attributions_by_definition_in_columns(spark):
    rows = rows_of(spark, GIVEN.features)
    named = [F.expr(trees.attribution_sql(GIVEN, i)).alias(f"want{i}") for i in range(len(GIVEN.features))]
    got = attribution.explain_table(rows.select("*", *named), trees.to_model(spark, GIVEN), ["key", *[f"want{i}" for i in range(len(named))]])
    for r in got.collect():
        assert r["base_value"] == pytest.approx(trees.base_value(GIVEN), abs=1e-12)
        for i, value in enumerate(r["attributions"]):
            assert value == pytest.approx(r[f"want{i}"], abs=1e-12)


def chain(depth):
    """A tree that asks a new feature at every level."""
    nodes, cover = [], 2**depth
    for d in range(depth):
        at = len(nodes)
        nodes.append(Node(cover, 0.0, d, 0.5, at + 1, at + 2))
        nodes.append(Node(cover // 4 + 1, 0.1 * d - 0.3))
        cover -= cover // 4 + 1
    return tuple([*nodes, Node(cover, 2.0)])


def test_depth_twelve_by_subsets():
    depth = 12
    tree = chain(depth)
    ensemble = Ensemble((tree,), (1.0,), tuple(f"f{i}" for i in range(depth)))
    leaves = []
    for met, value in attribution._paths(tree, 0, {}, 2.0):
        conditions = sorted((f, lo, hi, share) for f, (lo, hi, share) in met.items())
        leaves.append(attribution.Leaf(tuple(c[:3] for c in conditions), tuple(c[3] for c in conditions), value))
    assert len(leaves) == depth + 1  # what is kept grows with the leaves only

    def value(x, known, i=0):
        n = tree[i]
        if n.left < 0:
            return 2 * n.value
        if n.feature in known:
            return value(x, known, n.left if x[n.feature] <= n.threshold else n.right)
        a, b = tree[n.left].cover, tree[n.right].cover
        return (a * value(x, known, n.left) + b * value(x, known, n.right)) / (a + b)

    for x in (np.ones(depth), np.array([1.0] * 5 + [0.0] + [1.0] * 6)):
        got = attribution.attribute(x[None, :], tuple(leaves))[0]
        worth = {s: value(x, set(s)) for k in range(depth + 1) for s in combinations(range(depth), k)}
        for i in range(depth):
            rest = [j for j in range(depth) if j != i]
            want = sum(
                factorial(k) * factorial(depth - k - 1) / factorial(depth) * (worth[tuple(sorted((*s, i)))] - worth[s])
                for k in range(depth)
                for s in combinations(rest, k)
            )
            assert got[i] == pytest.approx(want, abs=1e-12)
    assert trees.base_value(ensemble) == pytest.approx(worth[()], abs=1e-12)


def test_blocks_of_rows_are_independent(monkeypatch):
    rng = np.random.default_rng(0)
    leaves = tuple(
        attribution.Leaf(((0, -np.inf, 0.4), (2, 0.1 * i, np.inf)), (0.3, 0.05 * (i + 1)), float(i)) for i in range(5)
    )
    values = rng.random((50, 3))
    whole = attribution.attribute(values, leaves)
    monkeypatch.setattr(attribution, "BLOCK_ROWS", 7)
    assert np.array_equal(attribution.attribute(values, leaves), whole)
    assert not whole[:, 1].any()
    assert attribution.attribute(values[:0], leaves).shape == (0, 3)
