"""Column expressions: everything here stays in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwatch import schema as S

HASH_BITS = 48


def type_code(type_col: str = "type") -> Column:
    """Model code of a transaction type; NULL for a type the model does not know."""
    kind = F.col(type_col)
    pairs = list(S.TYPE_CODES.items())
    first, code = pairs[0]
    expr = F.when(kind == first, F.lit(code))
    for name, code in pairs[1:]:
        expr = expr.when(kind == name, F.lit(code))
    return expr.cast("byte")


def is_relevant(type_col: str = "type") -> Column:
    return F.col(type_col).isin(*S.TYPE_CODES)


def bucket(step_col: str, hours: int) -> Column:
    """Fixed bucket number of an hour counter."""
    return F.floor(F.col(step_col) / hours).cast("int")


def flag(condition: Column) -> Column:
    return condition.cast("byte")


def log_amount(amount_col: str = "amount") -> Column:
    return F.log1p(F.col(amount_col))


def clip_amount(amount_col: str = "amount", upper: float = S.AMOUNT_CLIP) -> Column:
    return F.least(F.col(amount_col), F.lit(upper))


def hash_key(key_col: str, seed: int = 42) -> Column:
    """Seeded 48-bit number of a row key: random-like, the same on every retry."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key_col).cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def unit_interval(key: Column) -> Column:
    """A number in [0, 1) from a 48-bit hash key."""
    return key.cast("double") / float(1 << HASH_BITS)


def risk_label(score_col: str, threshold) -> Column:
    score, limit = F.col(score_col), _as_column(threshold)
    return (
        F.when(score >= limit, "HIGH").when(score >= limit * S.MEDIUM_SHARE, "MEDIUM").otherwise("LOW")
    )


def predicted_class(score_col: str, threshold) -> Column:
    return (F.col(score_col) >= _as_column(threshold)).cast("int")


def balance_anomaly() -> Column:
    """Origin emptied while the destination did not move."""
    return reduce(
        Column.__and__,
        [
            is_relevant(),
            F.col("newbalanceOrig") == 0,
            F.col("oldbalanceOrg") > 0,
            F.col("newbalanceDest") == F.col("oldbalanceDest"),
        ],
    )


def feature_label(feature_col: str) -> Column:
    return _looked_up(S.FEATURE_LABELS, feature_col)


def tool_label(name_col: str) -> Column:
    """Display name of a tool; an unknown tool keeps its own name."""
    return F.coalesce(_looked_up(S.TOOL_LABELS, name_col), F.col(name_col))


def _looked_up(values: dict[str, str], col: str) -> Column:
    pairs = [F.lit(item) for entry in values.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


def narrow(col: str) -> Column:
    """The value as the model sees it: float32, widened again for arithmetic."""
    return F.col(col).cast("float").cast("double")


def recommendation(label: Column, velocity_flag: Column) -> Column:
    """ESCALATE a high score, or a medium one with the velocity flag; MONITOR either alone."""
    return (
        F.when((label == "HIGH") | ((label == "MEDIUM") & velocity_flag), "ESCALATE")
        .when((label == "MEDIUM") | velocity_flag, "MONITOR")
        .otherwise("CLEAR")
    )


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
