"""Balance, amount and type features of a transaction: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators.velocity import add_velocity


def filter_types(df: DataFrame) -> DataFrame:
    """Only the types in which fraud occurs; the predicate reaches the file scan."""
    return df.where(C.is_relevant())


def add_balance_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "orig_balance_diff": F.col("oldbalanceOrg") - F.col("newbalanceOrig") - F.col("amount"),
            "dest_balance_diff": F.col("newbalanceDest") - F.col("oldbalanceDest") - F.col("amount"),
            "orig_zero_after": C.flag(F.col("newbalanceOrig") == 0),
            "dest_unchanged": C.flag(F.col("newbalanceDest") == F.col("oldbalanceDest")),
        }
    )


def add_request_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_amount": C.log_amount(), "type_encoded": C.type_code()})


def feature_table(df: DataFrame, key: str, keep: tuple[str, ...] = (), **velocity) -> DataFrame:
    """The whole feature table from the raw log: the row key, ``keep``, and 17 columns."""
    narrow = filter_types(df).select(
        key,
        *[c for c in keep if c != key],
        *[c for c in ("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
                      "oldbalanceDest", "newbalanceDest", S.LABEL) if c not in keep],
    )
    counted = add_velocity(narrow, key=key, **velocity)
    full = add_request_features(add_balance_features(counted))
    return full.select(key, *[c for c in keep if c not in (key, *S.FEATURE_TABLE)], *S.FEATURE_TABLE)


def add_features_array(df: DataFrame, features: tuple[str, ...] = S.REALISTIC_FEATURES, name: str = "features") -> DataFrame:
    """The ordered float32 vector of a transaction as an array column."""
    return df.withColumn(name, F.array(*[F.col(c).cast("float") for c in features]))
