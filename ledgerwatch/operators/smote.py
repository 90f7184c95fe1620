"""SMOTE: new minority rows on the segments between minority rows and their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators.neighbors import self_knn
from ledgerwatch.operators.sampling import smallest_by_hash

NEIGHBORS = 5
COPIES_PER_TASK = 100_000


def minority_points(df: DataFrame, key: str, features: Sequence[str], label: str = S.LABEL) -> DataFrame:
    return df.where(F.col(label) == 1).select(
        F.col(key).cast("long").alias("id"), F.array(*[C.narrow(c) for c in features]).alias("vector")
    )


def smote_neighbors(
    df: DataFrame, key: str, features: Sequence[str], k: int = NEIGHBORS, label: str = S.LABEL, **layout
) -> DataFrame:
    """The ``k`` nearest minority rows of each minority row, itself left out."""
    return self_knn(minority_points(df, key, features, label), k, **layout)


def synthetic_rows(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int = NEIGHBORS,
    seed: int = 42,
    label: str = S.LABEL,
    **layout,
) -> DataFrame:
    """As many new minority rows as the two classes differ by.

    The new rows are shared evenly over the minority rows, the remainder going to
    the smallest hashes; neighbour and position on the segment come from hashes of
    (row, copy), so a re-run of a lost task makes the same rows. Feature columns
    are float, integer-coded ones included. ``base_key`` names the origin row.
    """
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("minority"), F.count_if(F.col(label) == 0).alias("majority")
    ).first()
    missing = counts["majority"] - counts["minority"]
    if missing > 0 and counts["minority"] < 2:
        raise ValueError("SMOTE needs at least two minority rows")
    each, rest = divmod(max(missing, 0), max(counts["minority"], 1))

    points = minority_points(df, key, features, label).withColumn("_one", F.lit(1))
    extra = smallest_by_hash(points, {1: rest}, "_one", "id", seed)
    copies = points.select("id", (F.lit(each).cast("long") + extra.cast("int")).alias("copies"), "vector")
    near = (
        smote_neighbors(df, key, features, k, label, **layout)
        .groupBy(F.col("query_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "vector"))).alias("near"))  # at most k entries
    )
    # a row with very many copies makes them in pieces, on as many tasks
    pieces = (
        copies.where("copies > 0")
        .join(near, "id")
        .withColumn("_first", F.explode(F.expr(f"sequence(1L, greatest(copies, 1L), {COPIES_PER_TASK}L)")))
        .repartition("id", "_first")
    )
    last = f"least(greatest(copies, 1L), _first + {COPIES_PER_TASK - 1})"
    made = pieces.withColumn("copy", F.explode(F.expr(f"sequence(_first, {last})"))).withColumn(
        "_key", F.concat_ws("/", "id", "copy")
    )
    pick = F.pmod(C.hash_key("_key", seed), F.size("near")) + 1
    made = made.withColumns(
        {"_near": F.element_at("near", pick.cast("int"))["vector"], "_u": C.unit_interval(C.hash_key("_key", seed + 1))}
    )
    point = F.zip_with("vector", "_near", lambda a, b: (a + F.col("_u") * (b - a)).cast("float"))
    return made.withColumn("_new", point).select(
        F.col("id").alias("base_key"),
        "copy",
        *[F.col("_new")[i].alias(name) for i, name in enumerate(features)],
        F.lit(1).cast("byte").alias(label),
    )


def smote(df: DataFrame, key: str, features: Sequence[str], label: str = S.LABEL, **options) -> DataFrame:
    """The rows of ``df`` followed by the synthetic ones, marked ``is_synthetic``."""
    original = df.select(
        F.col(key).cast("long").alias("base_key"),
        F.lit(0).cast("long").alias("copy"),
        *[F.col(c).cast("float").alias(c) for c in features],
        F.col(label).cast("byte").alias(label),
        F.lit(False).alias("is_synthetic"),
    )
    made = synthetic_rows(df, key, features, label=label, **options).withColumn("is_synthetic", F.lit(True))
    return original.unionByName(made)
