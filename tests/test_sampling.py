import math

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import sampling
from ledgerwatch.operators.smote import smote, smote_neighbors

FEATURES = ("a", "b")


def labelled(spark, rows, fraud):
    return spark.range(rows).select(F.col("id").alias("key"), (F.col("id") < fraud).cast("byte").alias("isFraud"))


@pytest.mark.parametrize("rows,fraud", [(1000, 37), (35, 3), (7, 7), (1, 0), (0, 0), (101, 50)])
@pytest.mark.parametrize("cut_bits", [16, 2])
def test_split_is_exact_and_proportional(spark, rows, fraud, cut_bits):
    df = labelled(spark, rows, fraud)
    got = sampling.stratified_split(df, "isFraud", "key", cut_bits=cut_bits)
    counts = {(r[0], r[1]): r[2] for r in got.groupBy("isFraud", "is_test").count().collect()}
    assert sum(n for (_, test), n in counts.items() if test) == math.ceil(0.2 * rows)
    assert sum(counts.values()) == rows
    if rows >= 35:
        assert abs(counts.get((1, True), 0) - 0.2 * fraud) < 1


def test_rows_without_label_stay_out_of_the_test(spark):
    df = labelled(spark, 100, 20).withColumn("isFraud", F.when(F.col("key") % 4 > 0, F.col("isFraud")))
    rows = sampling.stratified_split(df, "isFraud", "key").collect()
    assert len(rows) == 100 and sum(r["is_test"] for r in rows) == 15
    assert not any(r["is_test"] for r in rows if r["isFraud"] is None)


def test_split_does_not_depend_on_layout(spark):
    df = labelled(spark, 500, 60)
    first = {r["key"] for r in sampling.stratified_split(df, "isFraud", "key").where("is_test").collect()}
    again = {
        r["key"]
        for r in sampling.stratified_split(df.repartition(7), "isFraud", "key", cut_bits=1).where("is_test").collect()
    }
    assert first == again
    other = {r["key"] for r in sampling.stratified_split(df, "isFraud", "key", seed=1).where("is_test").collect()}
    assert first != other


def test_split_shuffles_no_rows(spark):
    from plans import exchanges

    assert exchanges(sampling.stratified_split(labelled(spark, 500, 60), "isFraud", "key")) == 0


def test_hash_sample_share(spark):
    n = sampling.hash_sample(spark.range(20_000).withColumnRenamed("id", "key"), "key", 0.01).count()
    assert 140 <= n <= 260


def test_first_by_hash_has_no_repeats(spark):
    df = spark.range(100).withColumnRenamed("id", "key")
    picked = [r["key"] for r in sampling.first_by_hash(df, "key", 10).collect()]
    assert len(set(picked)) == 10
    assert sampling.first_by_hash(df.limit(4), "key", 10).count() == 4


def clusters(spark):
    rows = [(i, float((i * 37) % 101), float((i * 61) % 97), 1 if i % 9 == 0 else 0) for i in range(400)]
    rows += [(1000 + i, 50.0, 50.0, 1) for i in range(20)]  # copies
    return spark.createDataFrame(rows, "key long, a double, b double, isFraud byte")


@pytest.mark.parametrize("layout", [{}, {"few_queries": 0, "cells": 4, "block": 8}])
def test_smote(spark, layout):
    df = clusters(spark)
    points = {r["key"]: (r["a"], r["b"]) for r in df.where("isFraud = 1").collect()}
    near = {}
    for r in smote_neighbors(df, "key", FEATURES, **layout).collect():
        near.setdefault(r["query_id"], []).append(r["id"])
    for key, ids in near.items():
        d = {k: (points[k][0] - points[key][0]) ** 2 + (points[k][1] - points[key][1]) ** 2 for k in points if k != key}
        assert sorted(ids) == sorted(sorted(d, key=lambda k: (d[k], k))[:5])
    rows = smote(df, "key", FEATURES, **layout).collect()
    made = [r for r in rows if r["is_synthetic"]]
    assert len(rows) - len(made) == df.count()
    assert sum(r["isFraud"] for r in rows) * 2 == len(rows)
    per_base = {}
    for r in made:
        per_base[r["base_key"]] = per_base.get(r["base_key"], 0) + 1
        x, y = points[r["base_key"]]
        on_segment = False
        for k in near[r["base_key"]]:
            u, v = points[k]
            cross = (u - x) * (r["b"] - y) - (v - y) * (r["a"] - x)
            inside = min(x, u) - 1e-3 <= r["a"] <= max(x, u) + 1e-3 and min(y, v) - 1e-3 <= r["b"] <= max(y, v) + 1e-3
            on_segment |= abs(cross) < 1e-2 and inside
        assert on_segment
    assert max(per_base.values()) - min(per_base.values()) <= 1


def test_smote_repeats(spark):
    df = clusters(spark)
    first = sorted(map(tuple, smote(df, "key", FEATURES).collect()))
    assert first == sorted(map(tuple, smote(df.repartition(5), "key", FEATURES).collect()))


def test_smote_in_pieces(spark, monkeypatch):
    from ledgerwatch.operators import smote as module

    whole = sorted(map(tuple, smote(clusters(spark), "key", FEATURES).collect()))
    monkeypatch.setattr(module, "COPIES_PER_TASK", 2)
    assert whole == sorted(map(tuple, smote(clusters(spark), "key", FEATURES).collect()))


def test_smote_balanced_already(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, 2.0, 2.0, 0)], "key long, a double, b double, isFraud byte")
    assert smote(df, "key", FEATURES).count() == 2


def test_smote_without_a_neighbour(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, 2.0, 2.0, 0), (2, 2.0, 2.0, 0)], "key long, a double, b double, isFraud byte")
    with pytest.raises(ValueError):
        smote(df, "key", FEATURES)
