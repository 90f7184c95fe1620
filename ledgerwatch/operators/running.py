"""Running totals over an ordered table of any size, without one task seeing it all."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 100_000


def running_totals(
    table: DataFrame,
    order: str,
    sums: Sequence[str],
    group: str | None = None,
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``<col>_before``: the total of ``col`` over the rows ahead in ``order``.

    ``table`` has one row per (group, order) value, as a ``groupBy`` leaves it, so
    no value repeats however often it occurs in the data. It is read several times:
    pass a written table. ``group`` must have few distinct values (a class label).
    Rows whose order is NULL must be left out before; NaN counts as the largest value.

    The order column is cut at approximate quantiles into buckets of about
    ``bucket_rows`` rows; the totals of the buckets give each bucket its start. The
    cut points only spread the work; the sums are exact wherever they fall.
    """
    count = table.count()
    buckets = max(2, -(-count // bucket_rows))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = table.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * buckets)).first()[0] or [0.0]
    groups = [group] if group else []
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inner = sorted({c for c in cuts if isfinite(c)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    cut = (
        Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep")
        .transform(table.withColumn("_order", F.col(order).cast("double")))
        .withColumn("_bucket", F.col("_bucket").cast("int"))
        .drop("_order")
    )
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    ahead = Window.partitionBy(*groups).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*groups, "_bucket")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(*groups, "_bucket", *[_zero(F.sum(c).over(ahead)).alias(f"_{c}_start") for c in sums])
    )
    inside = (
        Window.partitionBy(*groups, "_bucket").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(starts, [*groups, "_bucket"])
        .withColumns({f"{c}_before": F.col(f"_{c}_start") + _zero(F.sum(c).over(inside)) for c in sums})
        .select(*table.columns, *[f"{c}_before" for c in sums])
    )


def _zero(column):
    return F.coalesce(column, F.lit(0))
