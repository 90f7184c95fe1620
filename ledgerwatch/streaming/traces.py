"""Traces that arrive: a streaming sink of trace lines, and calls paired with results across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch.functions import columns as C
from ledgerwatch.functions.text import snippet
from ledgerwatch.sources.trace import parse_trace, trace_line
from ledgerwatch.streaming.velocity import start_append

WATERMARK = "1 hour"
WAIT = "1 hour"
END = "end"
LINE_FIELDS = "investigation_id bigint, seq bigint, ts timestamp, type string, name string, input string, content string"
PAIRS = "investigation_id bigint, seq bigint, name string, result_seq bigint, result string"


def start_trace(events: DataFrame, out: str, *fields: str, **trigger) -> StreamingQuery:
    """Append events as trace lines below ``out/table``, each batch once."""
    return (
        events.select(trace_line(*(fields or events.columns)).alias("value"))
        .writeStream.format("text")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_trace(spark: SparkSession, path: str, schema: str = LINE_FIELDS, files_per_batch: int = 1000) -> DataFrame:
    """Events of arriving trace lines."""
    return parse_trace(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), schema)


def paired_calls(events: DataFrame, wait: str = WAIT, watermark: str = WATERMARK) -> DataFrame:
    """Every tool call of a stream with each result of the same tool in its investigation within ``wait`` of it.

    A stream-stream left outer join: both sides stay in state until the watermark is past what may still
    meet them, then a call without a result comes out alone. Rows for append mode; ``answered`` makes them
    the pairs that the batch form gives.
    """
    # filters move below the watermark, so the end marker passes both of them and moves both watermarks on;
    # it meets nothing, having no investigation, and is never passed itself
    timed = events.withWatermark("ts", watermark)
    calls = timed.where(F.col("type").isin("tool_call", END)).select("investigation_id", "seq", "name", "ts")
    results = timed.where(F.col("type").isin("tool_result", END)).select(
        F.col("investigation_id").alias("_of"),
        F.col("name").alias("_tool"),
        F.col("seq").alias("result_seq"),
        F.col("content").alias("result"),
        F.col("ts").alias("_result_ts"),
    )
    span = F.expr(f"interval {wait}")
    near = (F.col("_result_ts") >= F.col("ts") - span) & (F.col("_result_ts") <= F.col("ts") + span)
    met = calls.join(results, (F.col("investigation_id") == F.col("_of")) & (F.col("name") == F.col("_tool")) & near, "left_outer")
    return met.select("investigation_id", "seq", "name", "result_seq", "result")


def start_pairs(events: DataFrame, out: str, wait: str = WAIT, watermark: str = WATERMARK, **trigger) -> StreamingQuery:
    return start_append(paired_calls(events, wait, watermark), out, **trigger)


def answered(pairs: DataFrame) -> DataFrame:
    """One row per call from what ``start_pairs`` wrote: its last result, as ``trace_pair`` has it.

    A call is its investigation, number and tool: an event that is delivered twice is one call.
    """
    last = pairs.groupBy("investigation_id", "seq", "name").agg(F.max_by("result", "result_seq").alias("result"))
    return last.select(
        "investigation_id",
        "seq",
        "name",
        C.tool_label("name").alias("label"),
        "result",
        F.col("result").isNotNull().alias("done"),
        snippet(F.col("result")).alias("snippet"),
    )


def end_marker(spark: SparkSession, ts: str = "9999-01-01 00:00:00") -> DataFrame:
    """An event later than any other: appended to a bounded input, it lets every call without a result come out."""
    row = spark.range(1).select(F.lit(None).cast("bigint").alias("investigation_id"), F.lit(0).cast("bigint").alias("seq"))
    return row.select("*", F.to_timestamp(F.lit(ts)).alias("ts"), F.lit(END).alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("content"))
