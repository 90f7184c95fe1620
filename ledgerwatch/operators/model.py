"""Boosted-tree training, scoring and storage with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.workspace import use_checkpoint_dir

# Training parameters of the full job.
TRAIN_PARAMS = {
    "n_estimators": 300,
    "max_depth": 6,
    "learning_rate": 0.1,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "random_state": 42,
}


PART_ROWS = 500_000  # training rows sorted by one task


@dataclass(frozen=True)
class FraudModel:
    """A trained classifier with its feature order and decision threshold."""

    classifier: GBTClassificationModel
    features: tuple[str, ...]
    threshold: float = 0.5


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the vector column, from float32 values as in training."""
    named = [f"_f32_{c}" for c in features]
    narrowed = df.withColumns({n: F.col(c).cast("float") for n, c in zip(named, features, strict=True)})
    return VectorAssembler(inputCols=named, outputCol="_features", handleInvalid="error").transform(narrowed).drop(*named)


def train(
    df: DataFrame,
    features: Sequence[str] = S.REALISTIC_FEATURES,
    trees: int = TRAIN_PARAMS["n_estimators"],
    depth: int = TRAIN_PARAMS["max_depth"],
    label: str = S.LABEL,
    order: Sequence[str] = (),
) -> FraudModel:
    """Fit gradient-boosted trees.

    ``order`` names columns that identify a row: the rows are dealt out and sorted by
    them, so that the seeded row sampling picks the same rows on every run and retry.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    if order:
        parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
        df = df.repartition(parts, *order).sortWithinPartitions(*order)
    matrix = assemble(df, features).select("_features", F.col(label).cast("double").alias("_label"))
    booster = GBTClassifier(
        featuresCol="_features",
        labelCol="_label",
        maxIter=trees,
        maxDepth=depth,
        stepSize=TRAIN_PARAMS["learning_rate"],
        subsamplingRate=TRAIN_PARAMS["subsample"],
        featureSubsetStrategy=str(TRAIN_PARAMS["colsample_bytree"]),
        seed=TRAIN_PARAMS["random_state"],
    )
    return FraudModel(booster.fit(matrix), tuple(features))


def score(df: DataFrame, model: FraudModel, name: str = "score") -> DataFrame:
    """Add the probability of fraud. Runs in the JVM, row by row, without a shuffle."""
    scored = model.classifier.transform(assemble(df, model.features))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def save_model(model: FraudModel, path: str) -> None:
    """The trees, and beside them one row with threshold and feature order."""
    spark = SparkSession.getActiveSession()
    model.classifier.write().overwrite().save(f"{path}/trees")
    spark.range(1).select(
        F.lit(model.threshold).alias("threshold"), F.array(*[F.lit(c) for c in model.features]).alias("features")
    ).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> FraudModel:
    settings = spark.read.parquet(f"{path}/settings").first()
    return FraudModel(
        GBTClassificationModel.load(f"{path}/trees"), tuple(settings["features"]), settings["threshold"]
    )


def model_info(model: FraudModel, metrics: DataFrame | None = None, feature_set: str = "realistic") -> DataFrame:
    """One row describing a model; ``metrics`` is the one-row result of its evaluation."""
    spark = SparkSession.getActiveSession()
    labels = [F.lit(x) for c in model.features for x in (c, S.FEATURE_LABELS.get(c, c))]
    base = spark.range(1).select(
        F.lit(type(model.classifier).__name__).alias("model_type"),
        F.lit(feature_set).alias("feature_set"),
        F.array(*[F.lit(c) for c in model.features]).alias("features"),
        F.create_map(*labels).alias("feature_labels"),
        F.lit(float(model.threshold)).alias("threshold"),
        F.lit(model.classifier.getNumTrees).alias("n_estimators"),
    )
    if metrics is None:
        return base
    row = metrics.first().asDict()
    return base.withColumn(
        "metrics", F.create_map(*[F.lit(x) for n, v in row.items() for x in (n, float(v))])
    )
