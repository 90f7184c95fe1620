"""Pairing and display of investigation events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import columns as C
from ledgerwatch.functions.text import snippet


def trace_pair(events: DataFrame, investigation: str = "investigation_id") -> DataFrame:
    """Every tool call beside the last result of the same tool in its investigation.

    ``events`` has ``investigation, seq, type, name, content``. The results combine
    map-side to one row per tool; calls of a very busy investigation are split by
    AQE's skew join, each piece meeting the same single result.
    """
    keys = [investigation, "name"]
    results = (
        events.where(F.col("type") == "tool_result")
        .groupBy(*keys)
        .agg(F.max_by("content", "seq").alias("result"))
    )
    calls = events.where(F.col("type") == "tool_call").select(*keys, "seq")
    return calls.join(results, keys, "left").select(
        investigation,
        "seq",
        "name",
        C.tool_label("name").alias("label"),
        "result",
        F.col("result").isNotNull().alias("done"),
        snippet(F.col("result")).alias("snippet"),
    )
