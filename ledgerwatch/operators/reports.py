"""Report rows from scores and attributions: array expressions on each row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C

ATTRIBUTIONS = "attributions"


def flagged_features(features: tuple[str, ...] = S.REALISTIC_FEATURES, top: int = 3, name: str = ATTRIBUTIONS) -> Column:
    """Labels of the ``top`` features that raise the score most, highest first."""
    entries = [
        F.struct((-F.col(name)[i]).alias("_order"), F.lit(i).alias("_i"), F.lit(_label(f)).alias("label"))
        for i, f in enumerate(features)
    ]
    raising = F.filter(F.array(*entries), lambda e: e["_order"] < 0)
    return F.slice(F.sort_array(raising), 1, top)["label"]


def drivers(features: tuple[str, ...] = S.REALISTIC_FEATURES, name: str = ATTRIBUTIONS) -> Column:
    """Every feature by absolute attribution, largest first, ties in model order.

    Reads the feature columns beside the attributions for ``raw_value``.
    """
    entries = []
    for i, f in enumerate(features):
        value = F.round(F.col(name)[i], 6)
        entries.append(
            F.struct(
                (-F.abs(value)).alias("_order"),
                F.lit(i).alias("_i"),
                F.lit(f).alias("feature"),
                F.lit(_label(f)).alias("label"),
                value.alias("shap_value"),
                F.round(C.narrow(f), 4).alias("raw_value"),
                F.when(F.col(name)[i] > 0, "increases_fraud").otherwise("decreases_fraud").alias("direction"),
            )
        )
    return F.transform(F.sort_array(F.array(*entries)), lambda e: e.dropFields("_order", "_i"))


def top_drivers(df: DataFrame, keep: list[str], top: int, features=S.REALISTIC_FEATURES, name: str = ATTRIBUTIONS) -> DataFrame:
    """One row per driver, ``rank`` from 1, the first ``top`` of each input row."""
    listed = df.select(*keep, F.posexplode(F.slice(drivers(features, name), 1, top)).alias("_p", "_d"))
    return listed.select(*keep, (F.col("_p") + 1).alias("rank"), "_d.*")


def driver_sentence(top: Column, score: Column) -> Column:
    """The strongest driver of a row in words."""
    # fixed wording, four decimals
    direction = F.when(top["shap_value"] > 0, "increases").otherwise("decreases")
    return F.concat(
        F.lit("Primary driver: '"),
        top["label"],
        F.lit("' "),
        direction,
        F.lit(" fraud probability by "),
        F.format_string("%.4f", F.round(F.abs(top["shap_value"]), 4)),
        F.lit(" SHAP units. Overall risk score: "),
        F.format_string("%.4f", F.round(score, 4)),
        F.lit("."),
    )


def predict_report(attributed: DataFrame, key: str, threshold: float, features=S.REALISTIC_FEATURES) -> DataFrame:
    """Score, class, label and flagged features. Class and label use the unrounded score."""
    return attributed.select(
        key,
        F.round("score", 4).alias("risk_score"),
        C.predicted_class("score", threshold).alias("predicted_class"),
        C.risk_label("score", threshold).alias("risk_label"),
        F.lit(float(threshold)).alias("threshold_used"),
        flagged_features(features).alias("flagged_features"),
    )


def explain_report(attributed: DataFrame, key: str, features=S.REALISTIC_FEATURES) -> DataFrame:
    """Score, base value, all drivers in order, the first by name, and a summary."""
    listed = attributed.withColumn("_drivers", drivers(features))
    return listed.select(
        key,
        F.round("score", 4).alias("risk_score"),
        F.round("base_value", 6).alias("base_value"),
        F.col("_drivers").alias("features"),
        F.col("_drivers")[0]["label"].alias("top_driver"),
        driver_sentence(F.col("_drivers")[0], F.col("score")).alias("summary"),
    )


def velocity_check(df: DataFrame, key: str, above: int = S.VELOCITY_FLAG_ABOVE) -> DataFrame:
    """The account's counters, missing ones as 0, and the flag for a busy day."""
    counters = {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in S.VELOCITY_FEATURES}
    return df.select(
        key,
        *[counters[c].alias(c) for c in ("velocity_1hr", "velocity_3hr", "velocity_24hr", "velocity_cumcount")],
        (counters["velocity_24hr"] > above).alias("risk_flag"),
        F.lit(velocity_note(above)).alias("note"),
    )


def velocity_note(above: int = S.VELOCITY_FLAG_ABOVE) -> str:
    return f"risk_flag=True when velocity_24hr > {above} (Customer Risk Rating Matrix)."


def confident_fraud(df: DataFrame, threshold: float, score: str = "score", label: str = S.LABEL) -> DataFrame:
    return df.where((F.col(label) == 1) & (F.col(score) >= F.lit(threshold)))


def _label(feature: str) -> str:
    return S.FEATURE_LABELS.get(feature, feature)
