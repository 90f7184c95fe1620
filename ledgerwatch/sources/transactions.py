"""Scans of the transaction log, its feature table, and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch import schema as S


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 11-column log with declared types: no inference pass over the files."""
    return spark.read.schema(S.TXN_SCHEMA).option("header", True).csv(path)


def stream_csv(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream of arriving files, a bounded number per batch."""
    reader = spark.readStream.schema(S.TXN_SCHEMA).option("header", True)
    return reader.option("maxFilesPerTrigger", files_per_batch).csv(path)


def event_time(step: str, epoch_seconds: int) -> Column:
    """The start of hour ``step`` as a time; hour 1 starts at ``epoch_seconds``."""
    return F.timestamp_seconds(F.lit(epoch_seconds).cast("long") + (F.col(step) - 1) * 3600)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def missing_columns(df: DataFrame, required: Sequence[str] = (S.LABEL,)) -> list[str]:
    return [name for name in required if name not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str] = (S.LABEL,)) -> DataFrame:
    """``df`` itself, or an error naming what it lacks, before anything is read."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_types(df: DataFrame) -> DataFrame:
    """Name and type of each column, in order."""
    fields = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
              for i, (n, t) in enumerate(df.dtypes)]
    one = df.sparkSession.range(1)
    return one.select(F.inline(F.array(*fields)))


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``.

    The last key wanted is found among the keys alone; whole rows move only up to it.
    """
    last = df.select(key).orderBy(key).limit(n).agg(F.max(key)).scalar()
    return df.where(F.col(key) <= last).orderBy(key).limit(n)


def scan_features(df: DataFrame, features: Sequence[str] = S.FULL_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The model matrix as columns: float32 features and the label."""
    return df.select(
        *keep,
        *[F.col(c).cast("float").alias(c) for c in features],
        F.col(S.LABEL).cast("byte").alias(S.LABEL),
    )


def write_features(df: DataFrame, path: str, keep: Sequence[str] = ()) -> None:
    """The 17-column feature table, with key columns beside it on request."""
    df.select(*keep, *S.FEATURE_TABLE).write.mode("overwrite").parquet(path)


def features_sanity(df: DataFrame) -> DataFrame:
    """Rows, fraud rows, fraud rate and column count of a feature table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(S.LABEL).cast("long")).alias("fraud_rows"),
        F.round(F.avg(F.col(S.LABEL).cast("double")) * 100, 4).alias("fraud_rate_pct"),
        F.lit(len(df.columns)).alias("columns"),
    )


BROKEN = "_broken"


def scan_csv_checked(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The log with two columns more: ``_broken``, a line that does not fit the schema, whole, and ``_file``.

    A line is broken if it has too few or too many fields or a field that cannot be read as its type; its
    readable fields are filled. Sound lines have NULL there. Empty fields are NULL values, not faults; blank
    lines, and with ``header`` lines that repeat the column names, are no rows. Lines are read as text and
    parsed as wholes, so a line is judged alike whichever columns are used.
    """
    shape = T.StructType([*S.TXN_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.col("value") != ",".join(S.TXN_SCHEMA.names))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    read = lines.withColumn("row", F.from_csv("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape), options))
    return read.select("row.*", "_file")


def split_log(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and (file, line) of the broken ones for a table of their own."""
    sound = checked.where(F.col(BROKEN).isNull()).drop(BROKEN, "_file")
    broken = checked.where(F.col(BROKEN).isNotNull()).select(F.col("_file").alias("file"), F.col(BROKEN).alias("line"))
    return sound, broken
