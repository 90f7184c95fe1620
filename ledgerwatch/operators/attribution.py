"""Exact per-feature attribution of a boosted-tree score (path-dependent tree SHAP).

A leaf is reached when the row passes every split on its path. Merging the splits of
one feature leaves a conjunction over at most ``depth`` features, each either met by
the row (1) or replaced by the share of training rows that met it. The Shapley value of
condition i in such a product is ``(met_i - share_i)`` times the mean, over t from 0 to 1,
of the product of ``share_j + t (met_j - share_j)`` over the other conditions. That mean is
of a polynomial of degree m - 1, so m / 2 quadrature points give it exactly: O(m^2) per
leaf, and nothing is kept but the leaves.

Values are log-odds: the booster's margin is half of them, hence the factor 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.model import FraudModel
from ledgerwatch.operators.trees import MARGIN_TO_LOG_ODDS, Node, base_value, read_ensemble

_CONDITIONS_KEPT = 512
BLOCK_ROWS = 4096  # rows whose products stay in the processor's cache


@dataclass(frozen=True)
class Leaf:
    """(feature, above, up to) per feature on its path, the share of training rows that met each, its value."""

    bounds: tuple[tuple[int, float, float], ...]
    shares: tuple[float, ...]
    value: float


@dataclass(frozen=True)
class Explainer:
    """The leaves of all trees: what travels to the tasks grows with their number, not with 2^depth."""

    leaves: tuple[Leaf, ...]
    base_value: float
    width: int


def explainer(model: FraudModel) -> Explainer:
    """The explainer of a model, built once and kept on it."""
    found = model.__dict__.get("_explainer")
    if found is None:
        found = _build(model)
        object.__setattr__(model, "_explainer", found)  # the model is frozen otherwise
    return found


def _build(model: FraudModel) -> Explainer:
    ensemble = read_ensemble(model)
    leaves = []
    for tree, weight in zip(ensemble.trees, ensemble.weights, strict=True):
        for met, value in _paths(tree, 0, {}, MARGIN_TO_LOG_ODDS * weight):
            if met:
                conditions = sorted((f, lo, hi, share) for f, (lo, hi, share) in met.items())
                leaves.append(Leaf(tuple(c[:3] for c in conditions), tuple(c[3] for c in conditions), value))
    return Explainer(tuple(leaves), base_value(ensemble), len(ensemble.features))


def _paths(tree: tuple[Node, ...], at: int, met: dict, weight: float) -> Iterator[tuple[dict, float]]:
    """(conditions per feature, leaf value) for every leaf below a node."""
    node = tree[at]
    if node.left < 0:
        yield met, weight * node.value
        return
    lo, hi, share = met.get(node.feature, (-np.inf, np.inf, 1.0))
    sides = ((node.left, lo, min(hi, node.threshold)), (node.right, max(lo, node.threshold), hi))
    for child, low, high in sides:
        kept = share * tree[child].cover / node.cover
        yield from _paths(tree, child, {**met, node.feature: (low, high, kept)}, weight)


@lru_cache(maxsize=64)
def _points(conditions: int) -> tuple[tuple[float, float], ...]:
    """Places in 0..1 and weights that give the mean of any polynomial of a degree under ``conditions``."""
    x, w = np.polynomial.legendre.leggauss((conditions + 1) // 2)
    return tuple(zip(((x + 1) / 2).tolist(), (w / 2).tolist()))


def attribute(values: np.ndarray, leaves: tuple[Leaf, ...]) -> np.ndarray:
    """Attributions of a (rows x features) matrix."""
    out = np.zeros_like(values)
    for start in range(0, len(values), BLOCK_ROWS):
        out[start : start + BLOCK_ROWS] = _attribute_block(values[start : start + BLOCK_ROWS], leaves).T
    return out


def _attribute_block(values: np.ndarray, leaves: tuple[Leaf, ...]) -> np.ndarray:
    columns = np.ascontiguousarray(values.T)
    total = np.zeros(columns.shape)
    met: dict[tuple[int, float, float], np.ndarray] = {}
    for leaf in leaves:
        gains, shares = [], leaf.shares  # gains: met - share
        for condition, share in zip(leaf.bounds, shares, strict=True):
            if condition not in met:
                if len(met) >= _CONDITIONS_KEPT:
                    met.clear()
                f, above, up_to = condition
                met[condition] = ((columns[f] > above) & (columns[f] <= up_to)).astype(np.float64)
            gains.append(met[condition] - share)
        for i, (f, _, _) in enumerate(leaf.bounds):
            if len(gains) == 1:
                total[f] += leaf.value * gains[i]
        if len(gains) > 1:
            sums = _others(gains, shares, leaf.value)
            for (f, _, _), gain, mean in zip(leaf.bounds, gains, sums, strict=True):
                mean *= gain
                total[f] += mean
    return total


def _others(gains: list[np.ndarray], shares: tuple[float, ...], value: float) -> list[np.ndarray]:
    """Per condition ``value`` times the mean over t of the product of all other factors ``share + t gain``."""
    m = len(gains)
    sums = [np.zeros(len(gains[0])) for _ in range(m)]
    for t, weight in _points(m):
        factors = [t * gain + share for gain, share in zip(gains, shares, strict=True)]
        before = np.full(len(gains[0]), value * weight)
        after: list[np.ndarray | None] = [None] * m  # products of the factors behind each
        for i in range(m - 2, -1, -1):
            after[i] = factors[i + 1] if after[i + 1] is None else factors[i + 1] * after[i + 1]
        for i in range(m):
            sums[i] += before if after[i] is None else before * after[i]
            before = before * factors[i]
    return sums


def explain_rows(df: DataFrame, model: FraudModel, key: str, name: str = "attributions") -> DataFrame:
    """``key``, the attribution per feature in model order, and the base value."""
    return explain_table(df, model, [key], name)


def explain_table(df: DataFrame, model: FraudModel, keep: list[str], name: str = "attributions") -> DataFrame:
    """The ``keep`` columns with ``attributions`` and ``base_value`` beside them, in one pass without a shuffle."""
    explain = explainer(model)
    model_inputs = [f"_x{i}" for i in range(explain.width)]
    narrow = df.select(
        *keep,
        *[F.col(c).cast("float").cast("double").alias(x) for x, c in zip(model_inputs, model.features, strict=True)],
    )
    kept_fields = [f for f in narrow.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    schema += f", `{name}` array<double>, base_value double"
    spark = df.sparkSession
    base_value = explain.base_value
    shared = spark.sparkContext.broadcast(explain.leaves)  # at most trees x 2^depth leaves of a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        for batch in batches:
            if batch.num_rows:
                part = batch
                matrix = np.column_stack([part.column(x).to_numpy(zero_copy_only=False) for x in model_inputs])
                values = attribute(matrix, leaves)
                n, width = values.shape
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * width + 1, width, dtype="int32")), pa.array(np.ascontiguousarray(values).ravel())
                )
                yield pa.record_batch(
                    [*[part.column(c) for c in keep], lists, pa.array(np.full(n, base_value))],
                    names=[*keep, name, "base_value"],
                )

    return narrow.mapInArrow(run, schema)


def global_importance(attributed: DataFrame, features: tuple[str, ...], name: str = "attributions") -> DataFrame:
    """Mean absolute attribution per feature, largest first, and whether it is above the median.

    One aggregate row with a column per feature; the ranking runs over the features.
    """
    means = attributed.agg(*[F.avg(F.abs(F.col(name)[i])).alias(f) for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs")) for f in features])
    table = means.select(F.inline(rows))
    middle = table.agg(F.median("mean_abs")).scalar()
    return table.withColumn("above_median", F.col("mean_abs") > middle).orderBy(F.desc("mean_abs"), "feature")
