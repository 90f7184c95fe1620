"""Broken lines, logs in parts, tables by account, traces that arrive: against the whole in one piece."""

import random

import plans
import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators import increment
from ledgerwatch.operators.trace import trace_pair
from ledgerwatch.operators.velocity import add_velocity
from ledgerwatch.sources import account_table
from ledgerwatch.sources import transactions as log
from ledgerwatch.streaming import traces

COUNTERS = list(S.VELOCITY_FEATURES)


def test_broken_lines_keep_file_and_text(spark, tmp_path):
    head = ",".join(S.TXN_SCHEMA.names)
    good = "1,TRANSFER,10.5,C1,1,2,D1,3,4,0,0"
    bad = [
        "1,TRANSFER,10.5,C1,1,2,D1,3,4,0",
        "1,TRANSFER,10.5,C1,1,2,D1,3,4,0,0,9",
        "one,TRANSFER,10.5,C1,1,2,D1,3,4,0,0",
        "1,TRANSFER,much,C1,1,2,D1,3,4,0,0",
        "nonsense",
    ]
    (tmp_path / "a.csv").write_text("\n".join([head, good, *bad[:3], "", good]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, "2,CASH_OUT,,C2,1,2,D1,3,4,1,0", *bad[3:]]) + "\n")
    checked = log.scan_csv_checked(spark, str(tmp_path))
    sound, broken = log.split_log(checked)
    assert sound.columns == S.TXN_SCHEMA.names
    assert sorted(((r["step"], r["amount"]) for r in sound.collect()), key=str) == [(1, 10.5), (1, 10.5), (2, None)]
    got = {(r["file"].rsplit("/", 1)[1], r["line"]) for r in broken.collect()}
    assert got == {("a.csv", x) for x in bad[:3]} | {("b.csv", x) for x in bad[3:]}
    # judged alike whatever is asked for
    assert checked.where("_broken is not null").select("type").count() == len(bad)
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "c.csv").write_text(head + "\n")
    assert log.scan_csv_checked(spark, str(empty)).count() == 0


def drawn(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "c"]), rng.randint(1, 120)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, nameOrig string, step int")


@pytest.mark.parametrize("cuts", [[10, 47], [0, 500]])
def test_parts_of_a_log_equal_the_whole(spark, cuts):
    rows = drawn(spark)
    want = {tuple(r) for r in add_velocity(rows, "event_id").select("event_id", *COUNTERS).collect()}
    kept, have = spark.createDataFrame([], increment.CARRY), rows.limit(0).select("*", *[F.lit(0).alias(c) for c in COUNTERS])
    for low, high in zip([-1, *cuts], [*cuts, 10**6]):
        part = rows.where((F.col("step") > low) & (F.col("step") <= high))
        added = increment.added_velocity(part, kept, "event_id")
        renewed = increment.refreshed(have, part)
        rest = have.join(renewed.select("event_id"), "event_id", "left_anti")
        done = rest.unionByName(renewed).unionByName(added).collect()
        have = spark.createDataFrame(done, "event_id long, nameOrig string, step int, " + ", ".join(f"{c} int" for c in COUNTERS))
        carried = increment.merged_carry(kept, increment.carry_of(part)).collect()
        kept = spark.createDataFrame(carried, increment.CARRY)
    assert {tuple(r) for r in have.select("event_id", *COUNTERS).collect()} == want
    again = increment.carry_of(rows)
    assert {tuple(r) for r in again.select(kept.columns).collect()} == {tuple(r) for r in kept.collect()}


def test_late_parts_are_refused(spark):
    rows = drawn(spark)
    kept = increment.carry_of(rows.where("step <= 50"))
    with pytest.raises(ValueError, match="was counted"):
        increment.added_velocity(rows.where("step >= 50"), kept, "event_id")


def test_no_exchange_on_a_table_by_account(spark, tmp_path):
    rows = drawn(spark)
    table = account_table.write_by_account(rows, "drawn_by_account", str(tmp_path / "t"), 4)
    try:
        found = account_table.velocity_by_account(table, "event_id")
        assert "Exchange" not in plans.text(found)
        want = {tuple(r) for r in add_velocity(rows, "event_id").select("event_id", *COUNTERS).collect()}
        assert {tuple(r) for r in found.select("event_id", *COUNTERS).collect()} == want
        counts = table.groupBy("nameOrig").count().hint("merge")
        assert "Exchange" not in plans.text(counts.join(table, "nameOrig"))
        one = account_table.account_rows(spark, "drawn_by_account", ["b"])
        assert one.count() == rows.where("nameOrig = 'b'").count()
        # a scan that no operator needs in buckets does not name them unless told to
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = account_table.account_rows(spark, "drawn_by_account", ["b"])
        assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("drop table drawn_by_account")


def test_calls_meet_results_across_batches(spark, tmp_path):
    hour = 3600
    rows = [
        (1, 0, 10 * hour, "tool_call", "t", None),
        (1, 1, 10 * hour + 5, "tool_call", "u", None),
        (2, 0, 11 * hour, "tool_call", "t", None),
        (1, 2, 10 * hour + 50, "tool_result", "t", "first"),
        (1, 3, 10 * hour + 60, "tool_result", "t", "second"),
        (2, 1, 30 * hour, "tool_result", "t", "far too late"),
        (3, 0, 31 * hour, "tool_call", "v", None),
        (None, 0, 90 * hour, "end", None, None),
    ]
    shape = "investigation_id long, seq long, ts long, type string, name string, content string"
    shown = []
    for batch in (rows[:3], rows[3:5], rows[5:7], rows[7:]):
        part = spark.createDataFrame(batch, shape).withColumn("ts", F.timestamp_seconds("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        traces.start_trace(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/trace").awaitTermination()
        arriving = traces.stream_trace(spark, f"{tmp_path}/trace/table")
        traces.start_pairs(arriving, f"{tmp_path}/pairs").awaitTermination()
        pairs = spark.read.schema(traces.PAIRS).parquet(f"{tmp_path}/pairs/table")
        shown.append({(r["investigation_id"], r["seq"], r["result"]) for r in traces.answered(pairs).collect()})
    assert shown[0] == set()
    assert shown[1] == {(1, 0, "second")}
    assert shown[2] == shown[1] | {(1, 1, None), (2, 0, None)}  # behind the watermark without a result
    assert shown[3] == shown[2] | {(3, 0, None)}
    lines = spark.read.text(f"{tmp_path}/trace/table")
    assert lines.count() == len(rows) and lines.where("value like 'data: {%'").count() == len(rows)
    # the batch form on what came in time
    batch = spark.createDataFrame([r for r in rows[:5]], shape)
    assert {(r["investigation_id"], r["seq"], r["result"]) for r in trace_pair(batch).collect()} == shown[2]
