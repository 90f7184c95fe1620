"""The table of training runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(
    spark: SparkSession, path: str, run: str, params: Mapping[str, object], metrics: Mapping[str, float]
) -> None:
    """Add one run: parameters and metrics as maps."""
    run_row(spark, run, params, metrics).write.mode("append").parquet(path)


def run_row(spark: SparkSession, run: str, params: Mapping[str, object], metrics: Mapping[str, float]) -> DataFrame:
    param_items = [F.lit(x) for k, v in params.items() for x in (k, str(v))]
    metric_items = [F.lit(x) for k, v in metrics.items() for x in (k, float(v))]
    return spark.range(1).select(
        F.lit(run).alias("run"), F.create_map(*param_items).alias("params"), F.create_map(*metric_items).alias("metrics")
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_compare(runs: DataFrame, names: list[str]) -> DataFrame:
    """One row per metric, one column per run."""
    listed = runs.where(F.col("run").isin(*names)).select("run", F.explode("metrics").alias("metric", "value"))
    return listed.groupBy("metric").pivot("run", names).agg(F.first("value"))
