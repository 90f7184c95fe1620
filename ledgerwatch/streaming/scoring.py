"""Scoring of arriving transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import model as M
from ledgerwatch.operators.features import add_request_features
from ledgerwatch.operators.validation import default_velocity, validate
from ledgerwatch.streaming.velocity import asof_table


def score_batch(batch: DataFrame, model: M.FraudModel) -> tuple[DataFrame, DataFrame]:
    """Scored valid rows and rejected rows of a batch (or of a whole table)."""
    return score_checked(validate(default_velocity(batch)), model, batch.columns)


def score_checked(checked: DataFrame, model: M.FraudModel, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same for rows that are validated already; ``columns`` of the valid ones stay."""
    valid = F.size("failed") == 0
    scored = M.score(add_request_features(checked.where(valid).drop("failed")), model)
    labelled = scored.select(
        *columns,
        F.col("score").alias("_score"),
        C.predicted_class("score", model.threshold).alias("predicted_class"),
        C.risk_label("score", model.threshold).alias("risk_label"),
    )
    accepted = labelled.withColumn("risk_score", F.round("_score", 4)).drop("_score")
    return accepted, checked.where(~valid)


def with_counters(requests: DataFrame, counters: DataFrame, account: str = "nameOrig", step: str = "step") -> DataFrame:
    """Requests with the velocity counters of their account, themselves included.

    ``counters`` has a row per account and closed hour, as ``velocity.start_asof`` writes them. A
    request takes the last closed hour up to its own; an account without one counts as new. The
    search runs on the different (account, hour) pairs, so an account is at most a few
    hundred rows of it however many requests it has.
    """
    counted = [c for c in S.VELOCITY_FEATURES if c in requests.columns]
    requests = requests.drop(*counted)
    asked = requests.select(F.struct(F.col(account).alias("account"), F.col(step).alias("step")).alias("_hour")).distinct()
    known = counters.select(
        F.col("nameOrig").alias("account"), F.col("step").cast("int").alias("step"), F.lit(0).alias("asks"),
        F.struct("step", "n", "velocity_cumcount", "velocity_3hr", "velocity_24hr").alias("last"),
    ).join(asked.select(F.col("_hour.account").alias("account")).distinct(), "account", "left_semi")
    both = known.unionByName(
        asked.select("_hour.account", F.col("_hour.step").cast("int").alias("step"), F.lit(1).alias("asks")),
        allowMissingColumns=True,
    )
    so_far = Window.partitionBy("account").orderBy("step", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("last", ignorenulls=True).over(so_far)).where("asks = 1")
    last, now = F.col("last"), F.col("step")

    def within(hours: int, count: Column) -> Column:
        same = F.floor(last["step"] / hours) == F.floor(now / hours)
        return (F.when(same, count).otherwise(0) + 1).cast("int")

    pairs = found.select(
        F.struct("account", "step").alias("_hour"),
        F.coalesce(last["velocity_cumcount"] + last["n"], F.lit(0)).cast("int").alias("velocity_cumcount"),
        within(1, last["n"]).alias("velocity_1hr"),
        within(3, last["velocity_3hr"]).alias("velocity_3hr"),
        within(24, last["velocity_24hr"]).alias("velocity_24hr"),
    )
    keyed = requests.withColumn("_hour", F.struct(F.col(account).alias("account"), F.col(step).cast("int").alias("step")))
    return keyed.join(pairs, "_hour", "left").drop("_hour")


def start_scoring(
    stream: DataFrame, model: M.FraudModel, out: str, counters: str | None = None, **trigger
) -> StreamingQuery:
    """Score a stream; valid rows go to ``out/scored``, rejected ones to ``out/rejected``.

    With ``counters``, the table of ``velocity.start_asof``, each request is scored with its account's
    counters as of the last closed hour; without, with those it carries or 1. Each micro-batch
    overwrites its own folder, so a batch replayed after a failure replaces what the failed
    attempt wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if counters:
            batch = with_counters(batch, asof_table(batch.sparkSession, counters))
        checked = validate(default_velocity(batch)).persist()  # read, joined and checked once for both tables
        scored, rejected = score_checked(checked, model, batch.columns)
        scored.write.mode("overwrite").parquet(f"{out}/scored/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        checked.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
