"""The training job: load, split, resample, train, tune, save, log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators import curves, model as M
from ledgerwatch.operators.sampling import stratified_split
from ledgerwatch.operators.smote import smote
from ledgerwatch.sources.run_log import append_run
from ledgerwatch.sources.transactions import scan_features
from ledgerwatch.workspace import written

TEST_SHARE = 0.2

# The two runs that are compared.
RUNS = {
    "Full (with leakage)": S.FULL_FEATURES,
    "Realistic (no leakage)": S.REALISTIC_FEATURES,
}


@dataclass(frozen=True)
class TrainedRun:
    model: M.FraudModel
    metrics: dict[str, float]
    scored_test: DataFrame


def split_features(features: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The written feature table with ``is_test``, the same rows for every run."""
    return written(stratified_split(features, S.LABEL, key, TEST_SHARE, seed), "split")


def train_run(
    split: DataFrame,
    key: str,
    columns: Sequence[str] = S.REALISTIC_FEATURES,
    trees: int = M.TRAIN_PARAMS["n_estimators"],
    depth: int = M.TRAIN_PARAMS["max_depth"],
) -> TrainedRun:
    """Resample the training rows, fit, and tune the threshold on the test rows."""
    matrix = scan_features(split, columns, keep=[key, "is_test"])
    balanced = written(smote(matrix.where(~F.col("is_test")), key, columns), "balanced")
    fitted = M.train(balanced, columns, trees, depth, order=("base_key", "copy"))
    test = M.score(matrix.where("is_test"), fitted).select(key, "score", S.LABEL)
    metrics = curves.evaluate(test, "score", S.LABEL).first().asDict()
    return TrainedRun(replace(fitted, threshold=metrics["best_threshold"]), metrics, test)


def run_params(run: str, columns: Sequence[str], trees: int, depth: int) -> dict[str, object]:
    return {
        "feature_set": run,
        "n_features": len(columns),
        "features": ", ".join(columns),
        "test_size": TEST_SHARE,
        "resampling": "SMOTE(random_state=42)",
        **M.TRAIN_PARAMS,
        "n_estimators": trees,
        "max_depth": depth,
    }


def train_all(features: DataFrame, key: str, out: str, trees: int, depth: int) -> dict[str, TrainedRun]:
    """Both feature sets over one split; models and the run log go below ``out``."""
    spark = features.sparkSession
    split = split_features(features, key)
    done = {}
    for run, columns in RUNS.items():
        trained = train_run(split, key, columns, trees, depth)
        M.save_model(trained.model, f"{out}/model_{len(columns)}")
        append_run(spark, f"{out}/runs", run, run_params(run, columns, trees, depth), trained.metrics)
        done[run] = trained
    return done
