"""Investigation traces as lines of text: ``data: {json}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.text import stripped

PREFIX = "data: "
EVENT_FIELDS = "type string, name string, input string, content string"
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def trace_line(*fields: str) -> Column:
    """One event as a line; absent fields are left out of the JSON.

    ``input``, the arguments of a call, is a text that holds a JSON object; it stands
    in the line as that object, after the other fields. Any other text stays a string.
    """
    others = F.to_json(F.struct(*[f for f in fields if f != "input"]))
    if "input" not in fields:
        return F.concat(F.lit(PREFIX), others)
    whole = F.from_json(F.concat(F.lit("["), F.col("input"), F.lit("]")), "array<map<string,string>>", _STRICT)
    is_object = F.startswith("input", F.lit("{")) & F.endswith("input", F.lit("}")) & (F.size(whole) == 1)
    shown = F.when(F.coalesce(is_object, F.lit(False)), F.col("input")).otherwise(
        F.regexp_extract(F.to_json(F.struct("input")), r"(?s)^\{\"input\":(.*)\}$", 1)
    )
    head = F.substring(others, F.lit(1), F.length(others) - 1)
    comma = F.when(others == "{}", "").otherwise(",")
    spliced = F.concat(head, comma, F.lit('"input":'), shown, F.lit("}"))
    return F.concat(F.lit(PREFIX), F.when(F.col("input").isNull(), others).otherwise(spliced))


def write_trace(events: DataFrame, path: str, *fields: str) -> None:
    fields = fields or tuple(events.columns)
    events.select(trace_line(*fields).alias("value")).write.mode("overwrite").text(path)


def read_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_trace(lines: DataFrame, schema: str = EVENT_FIELDS, line: str = "value") -> DataFrame:
    """Events from lines. Lines without the prefix, blank or malformed ones are skipped.

    Read as the one element of an array, an object with anything behind it is malformed too.
    """
    keep = [c for c in lines.columns if c != line]
    raw = stripped(F.substring(F.col(line), len(PREFIX) + 1, 2**31 - 1))
    in_array = F.from_json(F.concat(F.lit("["), F.col("_raw"), F.lit("]")), f"array<struct<{schema}>>", _STRICT)
    return (
        lines.where(F.startswith(F.col(line), F.lit(PREFIX)))
        .withColumn("_raw", raw)
        .where(F.startswith("_raw", F.lit("{")) & F.endswith("_raw", F.lit("}")))
        .withColumn("_events", in_array)
        .where(F.size("_events") == 1)
        .select(*keep, F.col("_events")[0].alias("_event"))
        .select(*keep, "_event.*")
    )
