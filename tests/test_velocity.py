import re

import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators.features import feature_table
from ledgerwatch.operators import velocity
from ledgerwatch.operators.velocity import add_velocity
from ledgerwatch.registry.tables import transactions

from plans import exchanges, text


@pytest.fixture(scope="module")
def skewed(spark):
    """One account owns half the rows, most of them in one hour; keys are sparse and uneven;
    some rows lack the account or the hour."""
    rows = []
    for i in range(600):
        account = "hot" if i % 2 else f"C{i % 37}"
        step = 5 if account == "hot" and i % 5 else 1 + (i * 7) % 60
        rows.append((i * i * 3 + 11, step, account))
    rows += [(2_000_000 + i, 3 if i % 2 else None, None if i % 3 else "C1") for i in range(24)]
    return spark.createDataFrame(rows, "key long, step int, nameOrig string")


def expected(rows):
    out = {}
    ordered = sorted(rows, key=lambda r: (r["nameOrig"] or "", -1 if r["step"] is None else r["step"], r["key"]))

    def bucket(r, hours):
        return None if r["step"] is None else r["step"] // hours

    for r in rows:
        same = [x for x in ordered if x["nameOrig"] == r["nameOrig"]]
        out[r["key"]] = (
            [x["key"] for x in same].index(r["key"]),
            sum(x["step"] == r["step"] for x in same),
            sum(bucket(x, 3) == bucket(r, 3) for x in same),
            sum(bucket(x, 24) == bucket(r, 24) for x in same),
        )
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 100, 7, 1])
def test_both_plans_match_brute_force(skewed, slice_rows):
    got = {
        r["key"]: tuple(r[c] for c in S.VELOCITY_FEATURES)
        for r in add_velocity(skewed, "key", slice_rows=slice_rows).collect()
    }
    assert got == expected(skewed.collect())


@pytest.mark.parametrize("quantiles", [4, 1024])
@pytest.mark.parametrize("outlier", [2**62, -(2**62)])
def test_slices_stay_even_with_uneven_keys(spark, monkeypatch, quantiles, outlier):
    monkeypatch.setattr(velocity, "QUANTILES", quantiles)
    keys = spark.range(1000).select("id").unionByName(spark.createDataFrame([(outlier,)], "id long"))
    rows = velocity._with_slice(keys, "id", 100).orderBy("id").collect()
    slices = [r["_slice"] for r in rows]
    assert slices == sorted(slices)
    biggest = max(slices.count(s) for s in set(slices))
    assert biggest <= (40 if quantiles == 1024 else 300)


def test_slices_of_one_key(spark):
    assert velocity._with_slice(spark.range(7, 8), "id", 3).first()["_slice"] >= 0


@pytest.mark.parametrize("slice_rows", [10_000, 5])
def test_asof_rows_match_brute_force(spark, skewed, slice_rows):
    whole = add_velocity(skewed, "key", slice_rows=slice_rows)
    hours = whole.groupBy("nameOrig", "step").agg(
        F.count(F.lit(1)).alias("n"), F.min("velocity_cumcount").alias("velocity_cumcount")
    )
    rows = skewed.collect()

    def within(x, r, h):
        return None not in (x["step"], r["step"]) and x["step"] // h == r["step"] // h

    ends = spark.createDataFrame(
        [
            (r["nameOrig"], r["step"], *[
                sum(x["nameOrig"] == r["nameOrig"] and within(x, r, h) and x["step"] <= r["step"] for x in rows) for h in (1, 3, 24)
            ])
            for r in {(x["nameOrig"], x["step"]): x for x in rows}.values() if r["step"] is not None
        ],
        "nameOrig string, step int, velocity_1hr long, velocity_3hr long, velocity_24hr long",
    )
    closed = hours.join(ends, hours.nameOrig.eqNullSafe(ends.nameOrig) & (hours.step == ends.step)).select(
        hours.nameOrig, hours.step, "n", "velocity_cumcount", "velocity_1hr", "velocity_3hr", "velocity_24hr"
    )
    got = velocity.asof_rows(skewed, closed, "key", slice_rows=slice_rows).collect()
    assert len(got) == sum(r["step"] is not None for r in rows)
    for r in got:
        upto = [
            x for x in rows
            if x["nameOrig"] == r["nameOrig"] and x["step"] is not None and (x["step"], x["key"]) <= (r["step"], r["key"])
        ]
        missing = sum(x["nameOrig"] == r["nameOrig"] and x["step"] is None for x in rows)
        assert r["velocity_cumcount"] == len(upto) - 1 + missing
        assert [r[f"velocity_{h}hr"] for h in (1, 3, 24)] == [sum(within(x, r, h) for x in upto) for h in (1, 3, 24)]


def test_sliced_plan_equals_windows_on_the_log(spark, sf_dir):
    log = transactions(spark, sf_dir)
    plain, sliced = feature_table(log, "event_id"), feature_table(log, "event_id", slice_rows=50)
    assert plain.dtypes == sliced.dtypes
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0


def test_window_plan_has_one_shuffle(spark, sf_dir):
    assert exchanges(feature_table(transactions(spark, sf_dir), "event_id")) == 1


def test_sliced_plan_shuffles_the_rows_once_by_slot(spark, sf_dir):
    plan = text(feature_table(transactions(spark, sf_dir), "event_id", slice_rows=50))
    exchanges_by = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    # counts per slot (for both branches), slices of an hour, hours, account; and the rows
    assert exchanges_by.count("_account") == 1 and "nameOrig" not in exchanges_by
    rows = plan[: plan.index("Join")]
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", rows) == ["_slot"]


def test_type_filter_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    transactions(spark, sf_dir).write.parquet(path)
    plan = feature_table(spark.read.parquet(path), "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(type, [CASH_OUT,TRANSFER])]" in plan
    assert "nameDest" not in plan


def test_empty_log(spark, sf_dir):
    assert feature_table(transactions(spark, sf_dir).where("false"), "event_id").count() == 0


def test_session_zone_does_not_move_the_hours(spark, sf_dir):
    before = transactions(spark, sf_dir).agg(F.sum(F.col("step") * F.col("event_id"))).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = transactions(spark, sf_dir).agg(F.sum(F.col("step") * F.col("event_id"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after


def test_types_are_filtered_by_the_scan_of_the_events(spark, sf_dir):
    from ledgerwatch.registry.tables import features

    plan = features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [click,purchase])" in plan
