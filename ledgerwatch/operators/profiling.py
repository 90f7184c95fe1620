"""Profiles of a transaction log: one aggregate pass each, combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators.running import running_totals
from ledgerwatch.workspace import written

def _fraud() -> Column:
    return F.col(S.LABEL).cast("long")


def chunk_profile(df: DataFrame, key: str, chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """Rows, fraud rows and fraud percentage per chunk of ``chunk_rows`` consecutive keys."""
    chunk = (F.floor(F.col(key) / chunk_rows) + 1).cast("int")
    return df.groupBy(chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_fraud()).alias("fraud_rows"),
        F.round(F.avg(_fraud()) * 100, 4).alias("fraud_pct"),
    )


def ingest_totals(chunks: DataFrame) -> DataFrame:
    """Totals over ``chunk_profile``."""
    rate = F.try_divide(F.sum("fraud_rows").cast("double"), F.sum("rows").cast("double")) * 100
    return chunks.agg(
        F.sum("rows").alias("total_rows"),
        F.sum("fraud_rows").alias("total_fraud"),
        F.round(rate, 4).alias("fraud_rate_pct"),
        F.count(F.lit(1)).alias("chunks"),
    )


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and share per class; the window runs over the classes, not the rows."""
    counts = df.groupBy(S.LABEL).agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows").cast("double") / F.sum("rows").over(Window.partitionBy()) * 100
    return counts.select(
        F.col(S.LABEL).cast("int").alias(S.LABEL),
        F.when(F.col(S.LABEL) == 1, "Fraud").otherwise("Legitimate").alias("name"),
        "rows",
        F.round(share, 4).alias("pct"),
    )


def fraud_by_type(df: DataFrame) -> DataFrame:
    """Fraud count, total and rate per type, most fraud first."""
    return (
        df.groupBy("type")
        .agg(F.sum(_fraud()).alias("fraud_count"), F.count(F.lit(1)).alias("total"))
        .withColumn("fraud_rate_pct", F.round(F.col("fraud_count") / F.col("total") * 100, 4))
        .orderBy(F.desc("fraud_count"), "type")
    )


def ranked_types(by_type: DataFrame) -> DataFrame:
    """The types of ``fraud_by_type`` by rank; the window runs over the types."""
    order = Window.orderBy(F.desc("fraud_count"), "type")
    return by_type.select(F.row_number().over(order).alias("rank"), "type", "fraud_count")


def anomaly_precision(df: DataFrame) -> DataFrame:
    """How often a balance anomaly is fraud, in one pass. NULL precision without anomalies."""
    relevant, anomaly = C.is_relevant(), C.balance_anomaly()
    counts = df.agg(
        F.count_if(relevant).alias("relevant_rows"),
        F.count_if(anomaly).alias("anomaly_rows"),
        F.count_if(anomaly & (F.col(S.LABEL) == 1)).alias("anomaly_fraud"),
    )
    precision = F.try_divide(F.col("anomaly_fraud").cast("double"), F.col("anomaly_rows").cast("double")) * 100
    return counts.withColumn("precision_pct", F.round(precision, 2))


def amount_stats(df: DataFrame, **layout) -> DataFrame:
    """Rows, mean, exact median and maximum of the amount per class.

    The median comes from running counts over distinct amounts, so no task holds
    a class; the built-in exact percentile would. NULL and NaN amounts are left out.
    """
    counts = written(
        df.where(F.col("amount").isNotNull() & ~F.isnan("amount") & F.col(S.LABEL).isin(0, 1))
        .groupBy(F.col(S.LABEL).cast("int").alias(S.LABEL), "amount")
        .agg(F.count(F.lit(1)).alias("n")),
        "amount_counts",
    )
    placed = running_totals(counts, "amount", ["n"], group=S.LABEL, **layout)
    totals = counts.groupBy(S.LABEL).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("amount") * F.col("n")).alias("_sum"),
        F.max("amount").alias("max"),
    )
    # totals has one row per class
    spot = placed.join(F.broadcast(totals), S.LABEL)
    lower, upper = F.expr("(rows - 1) div 2"), F.expr("rows div 2")

    def covers(position):
        return (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))

    middle = (F.max(F.when(covers(lower), F.col("amount"))) + F.max(F.when(covers(upper), F.col("amount")))) / 2
    return spot.groupBy(S.LABEL, "rows", "_sum", "max").agg(F.round(middle, 4).alias("median")).select(
        S.LABEL, "rows", F.round(F.col("_sum") / F.col("rows"), 4).alias("mean"), "median", "max"
    )


def amount_histogram(df: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width bins of the clipped amount, each class over its own range.

    The ranges are one row of four numbers, used as a scalar subquery: no join. A
    class with a single amount gets the unit range around it.
    """
    clipped = df.where(F.col("amount").isNotNull() & ~F.isnan("amount") & F.col(S.LABEL).isNotNull()).select(
        F.col(S.LABEL).cast("int").alias(S.LABEL), C.clip_amount().alias("amount")
    )
    fraud, amount = F.col(S.LABEL) == 1, F.col("amount")
    ranges = clipped.agg(
        F.struct(
            F.min(F.when(fraud, amount)).alias("lo1"),
            F.max(F.when(fraud, amount)).alias("hi1"),
            F.min(F.when(~fraud, amount)).alias("lo0"),
            F.max(F.when(~fraud, amount)).alias("hi0"),
        )
    ).scalar()
    lo = F.when(fraud, ranges["lo1"]).otherwise(ranges["lo0"])
    hi = F.when(fraud, ranges["hi1"]).otherwise(ranges["hi0"])
    placed = clipped.withColumns({"_lo": lo, "_hi": hi}).withColumns(
        {
            "_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    )
    position = (amount - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
    return placed.groupBy(S.LABEL, F.least(F.floor(position), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def label_summary(df: DataFrame, *by: str, label: str = S.LABEL) -> DataFrame:
    """Rows, positives and positive percentage, per split if asked."""
    positive = F.col(label).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(positive).alias("positives"),
        F.round(F.avg(positive) * 100, 4).alias("positive_pct"),
    )
