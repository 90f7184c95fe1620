"""Velocity of a log that grows: features of the new rows from a small table carried per account.

The carried table has one row per account: all its rows so far, and those in its last hour's 3- and
24-hour bucket. New rows are counted by themselves; what the account did before comes by a join with
its carried row. Old rows are touched only in the buckets that the new rows go on filling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import columns as C
from ledgerwatch.operators.velocity import SLICE_ROWS, add_velocity

CARRY = "account string, last_step int, total long, in_3hr long, in_24hr long"


def carry_of(rows: DataFrame, account: str = "nameOrig", step: str = "step") -> DataFrame:
    """The carried table of a log: per account its last hour, its rows, and those in that hour's buckets.

    Rows are counted per (account, hour) first, with map-side combining, so a busy account is a few hundred rows.
    """
    hours = rows.groupBy(F.col(account).alias("account"), F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    last = hours.groupBy("account").agg(F.max("step").alias("last_step"))

    def within(length: int) -> Column:
        return F.sum(F.when(C.bucket("step", length) == C.bucket("last_step", length), F.col("n")).otherwise(0))

    placed = _by_account(hours, last)
    return placed.groupBy("account").agg(
        F.max("last_step").cast("int").alias("last_step"),
        F.sum("n").alias("total"),
        within(3).alias("in_3hr"),
        within(24).alias("in_24hr"),
    )


def merged_carry(kept: DataFrame, new: DataFrame) -> DataFrame:
    """The carried table after the new rows, from those of the old and of the new part alone."""
    old = kept.select(F.struct("account").alias("_a"), F.struct("last_step", "total", "in_3hr", "in_24hr").alias("old"))
    now = new.select(F.struct("account").alias("_a"), F.struct("last_step", "total", "in_3hr", "in_24hr").alias("now"))
    step = F.coalesce("now.last_step", "old.last_step")

    def bucket(length: int, count: str) -> Column:
        same = F.floor(F.col("old.last_step") / length) == F.floor(step / length)
        return F.coalesce(f"now.{count}", F.lit(0)) + F.when(same, F.col(f"old.{count}")).otherwise(0)

    return old.join(now, "_a", "full").select(
        F.col("_a.account").alias("account"),
        step.alias("last_step"),
        (F.coalesce("old.total", F.lit(0)) + F.coalesce("now.total", F.lit(0))).alias("total"),
        bucket(3, "in_3hr").alias("in_3hr"),
        bucket(24, "in_24hr").alias("in_24hr"),
    )


def require_later(new: DataFrame, last_step: int | None, step: str = "step") -> None:
    """Raise unless all new rows are in hours after the kept ones (``last_step``, None if there are none)."""
    first = new.agg(F.min(step)).first()[0]
    if first is not None and last_step is not None and first <= last_step:
        raise ValueError(f"rows of hour {first} come after hour {last_step} was counted")


def added_velocity(
    new: DataFrame, kept: DataFrame, key: str, account: str = "nameOrig", step: str = "step", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The new rows with the counters they have in the whole log. Reads the new rows and the carried table only."""
    require_later(new, kept.agg(F.max("last_step")).first()[0], step)
    alone = add_velocity(new, key, account, step, slice_rows)
    before = kept.select(F.struct("account").alias("_a"), "last_step", "total", "in_3hr", "in_24hr")
    joined = alone.withColumn("_a", F.struct(F.col(account).alias("account"))).join(before, "_a", "left")

    def plus(length: int) -> Column:
        same = C.bucket(step, length) == C.bucket("last_step", length)
        return (F.col(f"velocity_{length}hr") + F.when(same, F.col(f"in_{length}hr")).otherwise(0)).cast("int")

    offsets = {"velocity_cumcount": (F.col("velocity_cumcount") + F.coalesce("total", F.lit(0))).cast("int")}
    return joined.withColumns(offsets | {f"velocity_{h}hr": plus(h) for h in (3, 24)}).select(*alone.columns)


def refreshed(old: DataFrame, new: DataFrame, account: str = "nameOrig", step: str = "step") -> DataFrame:
    """Old feature rows whose 3- or 24-hour bucket the new rows go on filling, with the counters they have now.

    ``old`` may be cut to the day in which the new rows begin: no earlier row changes.
    """
    first = new.agg(F.min(step)).first()[0]
    open_days = old.where(F.lit(False) if first is None else C.bucket(step, 24) >= int(first) // 24)
    hours = new.groupBy(F.col(account).alias("account"), F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    out = open_days
    for length in (3, 24):
        bucket = C.bucket("step", length)
        more = hours.groupBy(F.struct("account", bucket.alias("bucket")).alias("_b")).agg(F.sum("n").alias("_more"))
        mine = F.struct(F.col(account).alias("account"), C.bucket(step, length).alias("bucket")).alias("_b")
        name = f"velocity_{length}hr"
        grown = (F.col(name) + F.coalesce("_more", F.lit(0))).cast("int")
        out = out.withColumn("_b", mine).join(more, "_b", "left").withColumn(name, grown).select(*old.columns)
    return out


def _by_account(hours: DataFrame, last: DataFrame) -> DataFrame:
    left = hours.withColumn("_a", F.struct("account"))
    return left.join(last.select(F.struct("account").alias("_a"), "last_step"), "_a")
