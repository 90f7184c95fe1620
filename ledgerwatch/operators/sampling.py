"""Samples and splits chosen by a seeded hash of the row key: exact, repeatable, no row shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import columns as C

CUT_BITS = 16


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with probability ``fraction``, decided by its key alone."""
    return df.where(C.hash_key(key, seed) < F.lit(int(fraction * (1 << C.HASH_BITS))))


def fraud_and_sample(df: DataFrame, key: str, label: str, fraction: float, seed: int = 42) -> DataFrame:
    """Every positive row, and of the others a hash sample."""
    return df.where((F.col(label) == 1) | (C.hash_key(key, seed) < F.lit(int(fraction * (1 << C.HASH_BITS)))))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the smallest hashes of the key."""
    return df.orderBy(C.hash_key(key, seed), key).limit(n)


def smallest_by_hash(
    df: DataFrame, need: Mapping[int, int], group: str, key: str, seed: int = 42, cut_bits: int = CUT_BITS
) -> Column:
    """A predicate true for exactly ``need[g]`` rows of each group ``g`` of ``df``, or all it has.

    Picks the rows with the smallest (hash, key). The hash range is cut into
    2^``cut_bits`` even parts; a histogram finds the part holding the last row
    wanted, and only that part (1/65,536 of a group) is sorted. The answer is a
    pair of numbers per group, so applying it shuffles nothing.
    """
    wanted = {g: n for g, n in need.items() if n > 0}
    if not wanted:
        return F.lit(False)
    shift = C.HASH_BITS - cut_bits
    hashed = df.select(F.col(group).alias("_g"), F.col(key).alias("_key"), C.hash_key(key, seed).alias("_h"))
    hashed = hashed.where(F.col("_g").isin(*wanted))
    target = _lookup("_g", wanted)

    parts = hashed.groupBy("_g", F.shiftright("_h", shift).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    holds_last = (F.col("_ahead") < target) & (target <= F.col("_ahead") + F.col("_n"))
    cuts = {r["_g"]: (r["_part"], r["_ahead"]) for r in placed.where(holds_last).collect()}

    in_part = F.shiftright("_h", shift) == _lookup("_g", {g: part for g, (part, _) in cuts.items()})
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_key"))
    last = hashed.where(in_part).withColumn("_rank", rank)
    left = _lookup("_g", {g: wanted[g] - before for g, (_, before) in cuts.items()})
    last_rows = {r["_g"]: (r["_h"], r["_key"]) for r in last.where(F.col("_rank") == left).collect()}

    own_hash = C.hash_key(key, seed)
    chosen = F.col(group).isin([g for g in wanted if g not in cuts])  # groups with no more rows than wanted
    for g, (last_hash, last_key) in last_rows.items():
        inside = (own_hash < last_hash) | ((own_hash == last_hash) & (F.col(key) <= last_key))
        chosen = chosen | ((F.col(group) == g) & inside)
    return chosen


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42, **layout
) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * labelled rows) rows, each class in proportion.

    A row without a label is never a test row.
    """
    labelled = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = smallest_by_hash(labelled, test_counts(counts, test_share), label, key, seed, **layout)
    return df.withColumn("is_test", F.coalesce(chosen, F.lit(False)))


def test_counts(counts: Mapping[int, int], test_share: float) -> dict[int, int]:
    """Test rows per class: proportional, the remainder to the largest fractions."""
    rows = sum(counts.values())
    if not rows:
        return {}
    total = -int(-rows * test_share // 1)
    exact = {c: n * total / rows for c, n in counts.items()}
    need = {c: int(x) for c, x in exact.items()}
    spare = total - sum(need.values())
    for c in sorted(counts, key=lambda c: (need[c] - exact[c], c))[:spare]:
        need[c] += 1
    return need


test_counts.__test__ = False


def _lookup(col: str, values: Mapping[int, int]) -> Column:
    expr = F.lit(None).cast("long")
    for key, value in values.items():
        expr = F.when(F.col(col) == key, F.lit(value).cast("long")).otherwise(expr)
    return expr
