"""Checks of incoming transactions: every failed rule by name, nothing dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C

_BALANCES = ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")


def failed_rules(velocity: bool = True):
    """Names of the rules a row breaks, in a fixed order. NULL, NaN and infinity break their rule."""

    def number(name):
        # NaN is above every number, so it is below no bound either
        return F.col(name) < F.lit(float("inf"))

    rules = [
        ("step", F.col("step").between(S.FIRST_STEP, S.LAST_STEP)),
        ("type", C.is_relevant()),
        ("amount", (F.col("amount") > 0) & number("amount")),
        *[(name, (F.col(name) >= 0) & number(name)) for name in _BALANCES],
    ]
    if velocity:
        rules += [(name, (F.col(name) >= 0) & number(name)) for name in S.VELOCITY_FEATURES]
    broken = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules]
    return F.array_compact(F.array(*broken))


def default_velocity(df: DataFrame, default: int = 1) -> DataFrame:
    """Missing velocity counters set to ``default`` (1 on a request, 0 in the velocity check)."""
    have = set(df.columns)
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(default)).cast("int") if name in have else F.lit(default)
            for name in S.VELOCITY_FEATURES
        }
    )


def validate(df: DataFrame) -> DataFrame:
    """Add ``failed``: the rules each row breaks, empty for a valid one."""
    return df.withColumn("failed", failed_rules(all(c in df.columns for c in S.VELOCITY_FEATURES)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the rejected ones with their reasons."""
    checked = validate(df)
    valid = F.size("failed") == 0
    return checked.where(valid).drop("failed"), checked.where(~valid)
