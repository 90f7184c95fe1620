"""Account velocity: how many transactions an account made per hour, 3 hours and day.

Two plans give the same columns. A log of at most ``slice_rows`` relevant rows takes
four windows over one shuffle by account: no group can exceed the checked count. A
larger log takes the sliced plan, which never holds an account, or an account's
hour, in one task:

* the row keys are cut into slices of about ``slice_rows`` rows, at quantiles and evenly
  between them, so that uneven keys do no harm;
* rows are counted per (account, hour, slice), with map-side combining;
* running sums over those counts give the offsets, over at most one row per hour of
  an account and one row per slice of an hour;
* the rows themselves shuffle once, by (account, hour, slice), and are numbered there.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import columns as C

SLICE_ROWS = 4_000_000
QUANTILES = 1_024


def add_velocity(
    df: DataFrame,
    key: str,
    account: str = "nameOrig",
    step: str = "step",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``velocity_cumcount`` (0-based) and ``velocity_1hr``, ``_3hr``, ``_24hr``.

    ``key`` is a unique integer row key; it orders the rows of one account and hour.
    """
    rows = df.count()
    if rows <= slice_rows:
        return _windowed(df, key, account, step)
    return _sliced(_with_slice(df, key, -(-rows // slice_rows)), key, account, step)


def account_rank(key: str, account: str = "nameOrig", step: str = "step") -> Column:
    return F.row_number().over(Window.partitionBy(account).orderBy(step, key)) - 1


def bucket_count(hours: int, account: str = "nameOrig", step: str = "step") -> Column:
    """Rows of the account in the row's whole bucket, later ones included."""
    bucket = F.col(step) if hours == 1 else C.bucket(step, hours)
    return F.count(F.lit(1)).over(Window.partitionBy(account, bucket)).cast("int")


def _windowed(df: DataFrame, key: str, account: str, step: str) -> DataFrame:
    by_account = df.repartition(account)  # serves all four windows, whichever of them are used
    return by_account.withColumn("velocity_cumcount", account_rank(key, account, step)).withColumns(
        {f"velocity_{h}hr": bucket_count(h, account, step) for h in (1, 3, 24)}
    )


def _with_slice(df: DataFrame, key: str, slices: int) -> DataFrame:
    """Add ``_slice``, rising with the key: about ``slices`` parts of like size."""
    blocks = min(slices, QUANTILES)
    shares = [i / blocks for i in range(blocks + 1)]
    position = F.col(key).cast("double")
    edges = sorted(set(df.agg(F.percentile_approx(position, shares, 10 * QUANTILES)).first()[0]))
    placed = df.withColumn("_position", position)
    if len(edges) > 2:
        splits = [float("-inf"), *edges[1:-1], float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_position", outputCol="_block").transform(placed)
    else:
        placed = placed.withColumn("_block", F.lit(0))
    blocks = max(1, len(edges) - 1)
    per_block = -(-slices // blocks)
    bounds = F.array(*[F.lit(e) for e in (edges if len(edges) > 1 else [edges[0], edges[0] + 1])])
    block = F.col("_block").cast("int")
    low, high = F.get(bounds, block), F.get(bounds, block + 1)
    inside = F.floor((F.col("_position") - low) / (high - low) * per_block)
    part = F.least(F.greatest(inside, F.lit(0)), F.lit(per_block - 1))
    return placed.withColumn("_slice", block * per_block + part).drop("_position", "_block")


def _sliced(df: DataFrame, key: str, account: str, step: str) -> DataFrame:
    rows = _with_slot(df, account, step)
    counts = _slot_counts(rows)
    earlier_hours = Window.partitionBy("_account").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    per_hour = (
        counts.groupBy("_slot._hour")
        .agg(F.sum("_n").alias("velocity_1hr"))
        .withColumns({"_account": F.col("_hour.account"), "_step": F.col("_hour.step")})
        .withColumn("_hours_before", _total("velocity_1hr", earlier_hours))
        .withColumns(
            {
                f"velocity_{h}hr": F.sum("velocity_1hr").over(Window.partitionBy("_account", C.bucket("_step", h)))
                for h in (3, 24)
            }
        )
    )
    placed = _placed(rows, counts, per_hour.drop("_account", "_step"), key)
    return placed.select(
        *_original(df, account, step),
        (F.col("_hours_before") + F.col("_place")).cast("int").alias("velocity_cumcount"),
        *[F.col(f"velocity_{h}hr").cast("int").alias(f"velocity_{h}hr") for h in (1, 3, 24)],
    )


def asof_rows(
    df: DataFrame,
    hours: DataFrame,
    key: str,
    account: str = "nameOrig",
    step: str = "step",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Velocity up to and including each row, rows of an hour taken in key order.

    ``hours`` has a row per account and hour with its rows ``n``, the account's rows
    before it (``velocity_cumcount``) and those up to its end in its 3- and 24-hour
    bucket. Rows whose hour is not there are left for later.
    """
    slices = -(-df.count() // slice_rows)
    sliced = _with_slice(df, key, slices) if slices > 1 else df.withColumn("_slice", F.lit(0).cast("long"))
    rows = _with_slot(sliced, account, step)
    per_hour = hours.select(
        _hour(account, step),
        "n",
        F.col("velocity_cumcount").alias("_hours_before"),
        *[F.col(f"velocity_{h}hr").alias(f"_to_end_{h}") for h in (1, 3, 24)],
    )
    placed = _placed(rows, _slot_counts(rows), per_hour, key)
    return placed.select(
        *_original(sliced, account, step),
        (F.col("_hours_before") + F.col("_place")).cast("int").alias("velocity_cumcount"),
        *[
            (F.col(f"_to_end_{h}") - F.col("n") + F.col("_place") + 1).cast("int").alias(f"velocity_{h}hr")
            for h in (1, 3, 24)
        ],
    )


def _hour(account: str, step: str) -> Column:
    # inside a struct NULL equals NULL, so rows without account or hour stay
    return F.struct(F.col(account).alias("account"), F.col(step).alias("step")).alias("_hour")


def _with_slot(df: DataFrame, account: str, step: str) -> DataFrame:
    """Account, hour and slice as one key column in place of the three."""
    slot = F.struct(_hour(account, step), F.col("_slice").alias("slice"))
    return df.withColumn("_slot", slot).drop(account, step, "_slice")


def _original(df: DataFrame, account: str, step: str) -> list[Column]:
    back = {account: F.col("_slot._hour.account").alias(account), step: F.col("_slot._hour.step").alias(step)}
    return [back.get(c, F.col(c)) for c in df.columns if c != "_slice"]


def _slot_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))


def _placed(rows: DataFrame, counts: DataFrame, per_hour: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their hour and ``_place``, their number in it from 0."""
    earlier_slices = (
        Window.partitionBy("_slot._hour").orderBy("_slot.slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_slice = counts.select("_slot", "_slot._hour", _total("_n", earlier_slices).alias("_slices_before"))
    per_slot = per_slice.join(per_hour, "_hour").drop("_hour")
    in_slot = Window.partitionBy("_slot").orderBy(key)
    return rows.join(per_slot, "_slot").withColumn(
        "_place", F.col("_slices_before") + F.row_number().over(in_slot) - 1
    )


def _total(col: str, window) -> Column:
    return F.coalesce(F.sum(col).over(window), F.lit(0))
