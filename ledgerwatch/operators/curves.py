"""Ranking metrics of a binary score: ROC, precision-recall, thresholds, reports.

Every metric starts from one row per distinct score (``score_counts``), which
combines map-side, so ties and hot scores cost nothing after the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.running import running_totals
from ledgerwatch.workspace import written

F1_GUARD = 1e-9


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and rows per distinct score, written once for the passes that follow.

    Rows without a score or a label, and those whose score is NaN, are left out.
    """
    counts = (
        df.where(_scored(score, label))
        .groupBy(F.col(score).alias("score"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    return written(counts, "score_counts")


def _scored(score: str, label: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()


def running_curve(counts: DataFrame, **layout) -> DataFrame:
    """Per score, highest first: positives and rows at or above it."""
    totals = running_totals(counts, "score", ["pos", "n"], descending=True, **layout)
    return totals.select(
        "score",
        "pos",
        "n",
        F.col("pos_before").alias("tp_before"),
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("n_before") + F.col("n")).alias("predicted"),
    )


def curve_points(counts: DataFrame, **layout) -> DataFrame:
    """``running_curve`` with precision, recall and F1 at every score."""
    positives = counts.agg(F.sum("pos")).scalar()
    p, r = F.col("precision"), F.col("recall")
    return (
        running_curve(counts, **layout)
        .withColumns({"precision": F.col("tp") / F.col("predicted"), "recall": F.try_divide(F.col("tp"), positives)})
        .withColumn("f1", 2 * p * r / (p + r + F1_GUARD))
    )


def pr_curve(counts: DataFrame, **layout) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    return curve_points(counts, **layout).select("score", "precision", "recall", "f1")


def with_end_point(curve: DataFrame) -> DataFrame:
    """The curve closed by precision 1 at recall 0, which belongs to no score."""
    end = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(0.0).alias("f1"),
    )
    return curve.unionByName(end)


def roc_auc(counts: DataFrame, **layout) -> DataFrame:
    """Area under the ROC curve, ties at half weight. NULL if only one class occurs."""
    return running_curve(counts, **layout).agg(_area_under_roc().alias("roc_auc"))


def pr_auc(counts: DataFrame, **layout) -> DataFrame:
    """Average precision: recall steps times precision, without interpolation."""
    return running_curve(counts, **layout).agg(_average_precision().alias("pr_auc"))


def _area_under_roc() -> Column:
    negatives = F.col("n") - F.col("pos")
    won = negatives.cast("double") * (F.col("tp_before") + F.col("pos") / 2)
    return F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum(negatives).cast("double"))


def _average_precision() -> Column:
    step = F.col("pos") * (F.col("tp") / F.col("predicted"))
    return F.try_divide(F.sum(step), F.sum("pos").cast("double"))


def _best_point() -> Column:
    point = F.struct("score", "f1", "precision", "recall", "tp", "predicted")
    return F.max_by(point, F.struct("f1", -F.col("score")))


def best_threshold(counts: DataFrame, **layout) -> DataFrame:
    """The score with the highest F1, the lowest such score on ties."""
    best = curve_points(counts, **layout).agg(_best_point().alias("best"))
    return best.select(
        F.col("best.score").alias("best_threshold"),
        F.col("best.f1").alias("best_f1"),
        F.col("best.precision").alias("precision"),
        F.col("best.recall").alias("recall"),
    )


def confusion_matrix(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    hit, fraud = F.col(score) >= F.lit(threshold), F.col(label) == 1
    return df.where(_scored(score, label)).agg(
        F.count_if(~hit & ~fraud).alias("true_negatives"),
        F.count_if(hit & ~fraud).alias("false_positives"),
        F.count_if(~hit & fraud).alias("false_negatives"),
        F.count_if(hit & fraud).alias("true_positives"),
    )


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages.

    From a one-row confusion matrix; undefined ratios count as 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    rows = matrix.select(
        *_class_scores("legit", tn, fn, fp),
        *_class_scores("fraud", tp, fp, fn),
        (tn + fp).alias("legit_n"),
        (fn + tp).alias("fraud_n"),
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
    )
    total = F.col("legit_n") + F.col("fraud_n")

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    def per_class(name):
        return line(name.capitalize(), *[F.col(f"{name}_{m}") for m in ("precision", "recall", "f1", "n")])

    def macro(m):
        return (F.col(f"legit_{m}") + F.col(f"fraud_{m}")) / 2

    def weighted(m):
        return _ratio(F.col(f"legit_{m}") * F.col("legit_n") + F.col(f"fraud_{m}") * F.col("fraud_n"), total)

    names = ("precision", "recall", "f1")
    lines = F.array(
        per_class("legit"),
        per_class("fraud"),
        line("accuracy", F.col("accuracy"), F.col("accuracy"), F.col("accuracy"), total),
        line("macro avg", *[macro(m) for m in names], total),
        line("weighted avg", *[weighted(m) for m in names], total),
    )
    return rows.select(F.inline(lines))


def evaluate(df: DataFrame, score: str = "score", label: str = "label", **layout) -> DataFrame:
    """The thirteen metrics of a scored table as one row, threshold tuned on the same rows.

    One aggregate over the curve: the point at a threshold already holds the hits
    and predictions the confusion matrix needs.
    """
    at_half = F.col("score") >= 0.5
    row = curve_points(score_counts(df, score, label), **layout).agg(
        _area_under_roc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        _best_point().alias("best"),
        F.sum("pos").alias("p"),
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(at_half, F.col("pos"))), F.lit(0)).alias("half_tp"),
        F.coalesce(F.sum(F.when(at_half, F.col("n"))), F.lit(0)).alias("half_predicted"),
    )
    tp, predicted = F.col("best.tp"), F.col("best.predicted")
    half_tp, half_predicted = F.col("half_tp"), F.col("half_predicted")
    return row.select(
        "roc_auc",
        "pr_auc",
        F.col("best.score").alias("best_threshold"),
        F.col("best.f1").alias("best_f1"),
        F.col("best.precision").alias("precision"),
        F.col("best.recall").alias("recall"),
        (F.col("rows") - F.col("p") - predicted + tp).alias("true_negatives"),
        (predicted - tp).alias("false_positives"),
        (F.col("p") - tp).alias("false_negatives"),
        tp.alias("true_positives"),
        _ratio(half_tp, F.col("p")).alias("recall_at_0.5"),
        _ratio(half_tp, half_predicted).alias("precision_at_0.5"),
        _ratio(2 * half_tp, half_predicted + F.col("p")).alias("f1_at_0.5"),
    )


def _class_scores(name, hits, wrong, missed):
    precision, recall = _ratio(hits, hits + wrong), _ratio(hits, hits + missed)
    return (
        precision.alias(f"{name}_precision"),
        recall.alias(f"{name}_recall"),
        _ratio(2 * hits, 2 * hits + wrong + missed).alias(f"{name}_f1"),
    )


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
