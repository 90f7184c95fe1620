"""Account velocity on a stream.

``closed_counts`` gives the final count of each account and bucket once its window is
behind the watermark. ``start_asof`` goes on from the closed hours: per account and
hour, what the account had done so far. Since the hours are counted (with map-side
combining) before they reach the per-account state, an account costs the state at most
one row per hour, however many transactions it makes; accounts that fall silent leave the
state. ``open_hours`` and ``open_buckets`` complete the counts of an input that has ended.
``start_asof_rows`` then releases the
transactions of the closed hours, each with the counters up to and including itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerwatch.functions import columns as C
from ledgerwatch.operators.velocity import asof_rows
from ledgerwatch.sources.transactions import event_time

WATERMARK = "1 hour"
HOURS_SCHEMA = "nameOrig string, step int, n long"


def relevant_stream(log: DataFrame, epoch_seconds: int) -> DataFrame:
    """Account and event time of the relevant transactions of a log that counts in hours."""
    relevant = log.where(C.is_relevant())
    return relevant.select("nameOrig", "step", event_time("step", epoch_seconds).alias("ts"))


def closed_counts(stream: DataFrame, hours: int, watermark: str = WATERMARK) -> DataFrame:
    """Rows per account and bucket of ``hours``, for append mode.

    Steps start at 1, one hour after the first day begins, so buckets of ``step``
    begin an hour before the clock's multiples.
    """
    length = f"{hours} hours"
    window = F.window("ts", length, length, f"{hours - 1} hours")
    return (
        stream.withWatermark("ts", watermark)
        .groupBy("nameOrig", window)
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .select("nameOrig", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
    )


def closed_hours(stream: DataFrame, epoch_seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Closed one-hour counts with the hour as ``step`` (1 for the hour at ``epoch_seconds``)."""
    step = F.floor((F.unix_seconds("start") - epoch_seconds) / 3600) + 1
    return closed_counts(stream, 1, watermark).select("nameOrig", step.cast("int").alias("step"), F.col("n").cast("long").alias("n"))


def closed_buckets(hours: DataFrame, length: int, epoch_seconds: int) -> DataFrame:
    """Rows per account and bucket of ``length`` hours from a stream of closed hours, for append mode.

    ``hours`` is what ``closed_hours`` gives, so the log is counted once for all lengths. A
    bucket is closed once an hour after its last one is. Rows per account and ``bucket``.
    """
    starts = F.timestamp_seconds((F.col("step").cast("long") - 1) * 3600 + epoch_seconds)
    window = F.window("start", f"{length} hours", f"{length} hours", f"{length - 1} hours")
    return (
        hours.withColumn("start", starts)
        .withWatermark("start", "0 seconds")
        .groupBy("nameOrig", window.alias("window"))
        .agg(F.sum("n").cast("int").alias("n"))
        .select(
            "nameOrig",
            F.floor(((F.unix_seconds(F.col("window.start")) - epoch_seconds) / 3600 + 1) / length).cast("int").alias("bucket"),
            "n",
        )
    )


def start_accept(stream: DataFrame, out: str, key: str, watermark: str = WATERMARK, **trigger) -> StreamingQuery:
    """Append the rows that are not behind the watermark, each key once, to the table ``out/table``.

    Counts, counters and released rows all start from this table: what it holds is never late
    for a later stream with the same watermark, so a late row disturbs none of them.
    """
    accepted = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    by_day = accepted.withColumn("day", F.floor(F.unix_seconds("ts") / 86_400).cast("int"))
    return start_append(by_day, out, ("day",), **trigger)


def late_rows(rows: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``late``: whether the stream left them out as behind its watermark."""
    seen = accepted.select(key, F.lit(False).alias("late"))
    return rows.join(seen, key, "left").withColumn("late", F.coalesce("late", F.lit(True)))


def start_append(df: DataFrame, out: str, partition_by: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Append a stream to the table ``out/table``; its commit log makes each batch appear whole, once."""
    return (
        df.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .outputMode("append")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


ASOF_SCHEMA = (
    "nameOrig string, step int, n long, velocity_cumcount long,"
    " velocity_1hr long, velocity_3hr long, velocity_24hr long, life int, ended boolean"
)
STATE_SCHEMA = "life int, step int, total long, count3 long, count24 long"
IDLE_HOURS = 72  # of silence after which an account leaves the state; at least the longest bucket
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counters(StatefulProcessor):
    """Counters of an account as of each closed hour, kept until the account has been silent for ``idle`` hours.

    A timer on event time stands ``idle`` hours behind the account's last one. When the watermark
    passes it, the state goes, and one row with ``ended`` says how far this life of the account got.
    An account that comes back starts a new life, named after its first hour, from 0; ``with_past``
    adds what earlier lives had.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hours = sorted((int(r.step), int(r.n)) for part in rows for r in part.itertuples())
        if self.counts.exists():
            life, at, total, count3, count24 = self.counts.get()
            self.handle.deleteTimer(self._due(at))
        else:
            life, at, total, count3, count24 = hours[0][0], -1, 0, 0, 0
        out = []
        for step, n in hours:
            count3 = n + (count3 if step // 3 == at // 3 else 0)
            count24 = n + (count24 if step // 24 == at // 24 else 0)
            out.append((key[0], step, n, total, n, count3, count24, life, False))
            total, at = total + n, step
        self.counts.update((life, at, total, count3, count24))
        self.handle.registerTimer(self._due(at))
        yield _asof_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        life, at, total, _, _ = self.counts.get()
        self.counts.clear()
        yield _asof_frame([(key[0], at, 0, total, 0, 0, 0, life, True)])

    def close(self) -> None:
        pass

    def _due(self, step: int) -> int:
        return (step + self.idle) * 3_600_000


def _asof_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in ASOF_SCHEMA.split(", ")])


def asof_counts(hours: DataFrame, idle: int = IDLE_HOURS) -> DataFrame:
    """From closed hours: rows of the account before the hour, and up to its end in its buckets."""
    if idle < 24:
        raise ValueError("an account must stay for the longest bucket, 24 hours")
    spark = hours.sparkSession
    if spark.conf.get(_STORE) != _ROCKSDB:
        spark.conf.set(_STORE, _ROCKSDB)  # the store that has timers; and state on disk instead of the heap
    timed = hours.withColumn("_hour", F.timestamp_seconds(F.col("step").cast("long") * 3600)).withWatermark("_hour", "0 seconds")
    return timed.groupBy("nameOrig").transformWithStateInPandas(Counters(idle), ASOF_SCHEMA, "Append", "EventTime")


def start_asof(spark: SparkSession, hours_table: str, out: str, idle: int = IDLE_HOURS, **trigger) -> StreamingQuery:
    """Keep the counters as of each closed hour in ``out/table``; ended lives are a folder of their own."""
    hours = spark.readStream.schema(HOURS_SCHEMA).parquet(hours_table)
    return start_append(asof_counts(hours, idle), out, ("ended",), **trigger)


def with_past(hours: DataFrame, ended: DataFrame) -> DataFrame:
    """As-of rows with the totals of the account's ended lives added to ``velocity_cumcount``.

    Only accounts that fell silent have ended lives, so the second table is the small one; the
    lookup is by (account, life), not by row.
    """
    lives = hours.select("nameOrig", "life").distinct()
    earlier = ended.select("nameOrig", F.col("life").alias("before"), F.col("velocity_cumcount").alias("total"))
    past = lives.join(earlier, "nameOrig").where("before < life").groupBy("nameOrig", "life").agg(F.sum("total").alias("past"))
    whole = F.col("velocity_cumcount") + F.coalesce("past", F.lit(0))
    return hours.join(past, ["nameOrig", "life"], "left").withColumn("velocity_cumcount", whole).drop("past", "life", "ended")


def asof_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``start_asof`` has written so far: one row per account and closed hour."""
    rows = spark.read.schema(ASOF_SCHEMA).parquet(path)
    return with_past(rows.where("not ended"), rows.where("ended"))


def open_hours(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """When the input has ended: counts of the hours that the stream has not closed, in the form of ``closed_hours``.

    ``rows`` are the accepted rows, ``hours`` the closed ones. The watermark is one for all accounts, so
    whatever is later than the last closed hour is open, and nothing is counted twice.
    """
    last = hours.agg(F.max("step")).first()[0]
    rest = rows if last is None else rows.where(F.col("step") > last)
    return rest.groupBy("nameOrig", "step").agg(F.count(F.lit(1)).alias("n"))


def open_buckets(hours: DataFrame, closed: DataFrame, length: int) -> DataFrame:
    """When the input has ended: the buckets of ``length`` hours later than the last closed one, from all hours."""
    bucket = C.bucket("step", length)
    last = closed.agg(F.max("bucket")).first()[0]
    rest = hours if last is None else hours.where(bucket > last)
    return rest.groupBy("nameOrig", bucket.alias("bucket")).agg(F.sum("n").cast("int").alias("n"))


def start_asof_rows(
    spark: SparkSession, asof_table: str, rows_table: str, out: str, key: str, epoch_seconds: int, **trigger
) -> StreamingQuery:
    """Transactions with their counters, hour by hour as the hours close.

    ``rows_table`` is what ``start_accept`` wrote, with ``key``, ``nameOrig``, ``step`` and ``ts``,
    laid out by day: a batch reads the days of the hours it releases. Since the hours were
    counted from the same table, late rows have no part in either. Each batch overwrites
    its own folder below ``out/rows``.
    """

    def release(batch: DataFrame, batch_id: int) -> None:
        first, last = batch.agg(F.min("step"), F.max("step")).first()
        if first is None:
            return
        hours = with_past(batch, spark.read.schema(ASOF_SCHEMA).parquet(asof_table).where("ended"))
        days = [F.floor((F.lit(step) - 1 + epoch_seconds // 3600) / 24) for step in (first, last)]
        table = spark.read.parquet(rows_table).where(F.col("day").between(*days) & F.col("step").between(first, last))
        rows = table.select(key, "nameOrig", "step")
        asof_rows(rows, hours, key).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return (
        spark.readStream.schema(ASOF_SCHEMA)
        .parquet(asof_table)
        .where("not ended")
        .writeStream.foreachBatch(release)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
