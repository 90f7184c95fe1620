import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators.features import add_request_features, filter_types
from ledgerwatch.operators import model as M
from ledgerwatch.operators.validation import default_velocity
from ledgerwatch.registry.model_queries import trained
from ledgerwatch.registry.tables import transactions
from ledgerwatch.sources.event_log import EPOCH_SECONDS
from ledgerwatch.streaming import scoring, velocity

COLUMNS = ["event_id", "step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def arrivals(spark, rows, path, parts):
    """Rows written in ``parts`` files, in time order, one micro-batch each."""
    for i in range(parts):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scoring_equals_batch(spark, sf_dir, tmp_path):
    model = trained(spark, sf_dir).model
    log = transactions(spark, sf_dir).select(*COLUMNS).withColumn("part", F.col("event_id") % 3)
    stream = arrivals(spark, log, str(tmp_path / "in"), 3)
    scoring.start_scoring(stream, model, str(tmp_path / "out")).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "out/scored"))
    rejected = spark.read.parquet(str(tmp_path / "out/rejected"))
    assert scored.select("batch").distinct().count() == 3
    assert scored.count() + rejected.count() == log.count()
    batch = M.score(add_request_features(default_velocity(filter_types(log.drop("part")).where("amount > 0"))), model)
    both = scored.join(batch.select("event_id", F.round("score", 4).alias("want")), "event_id")
    assert both.count() == scored.count() and both.where("risk_score <> want").count() == 0
    assert rejected.where(F.size("failed") == 0).count() == 0


def asof_by_hand(rows):
    out, total = {}, {}
    counts = {}
    for account, step in rows:
        counts[account, step] = counts.get((account, step), 0) + 1
    for (account, step), n in sorted(counts.items(), key=lambda x: x[0][1]):
        before = total.get(account, 0)
        total[account] = before + n
        out[account, step] = (
            n, before, n,
            sum(c for (a, s), c in counts.items() if a == account and s // 3 == step // 3 and s <= step),
            sum(c for (a, s), c in counts.items() if a == account and s // 24 == step // 24 and s <= step),
        )
    return out


def test_asof_over_many_batches(spark, sf_dir, tmp_path):
    log = filter_types(transactions(spark, sf_dir)).select("ts", "step", "nameOrig")
    parts = log.withColumn("part", F.least(F.floor(F.col("step") / 150), F.lit(4)).cast("int"))
    stream = arrivals(spark, parts, str(tmp_path / "in"), 5)
    hours = velocity.closed_hours(stream, EPOCH_SECONDS)
    velocity.start_append(hours, str(tmp_path / "hours")).awaitTermination()
    # the second stream goes on from its own checkpoint
    for _ in range(2):
        velocity.start_asof(spark, str(tmp_path / "hours/table"), str(tmp_path / "asof")).awaitTermination()
    got = {
        (r["nameOrig"], r["step"]): (r["n"], r["velocity_cumcount"], r["velocity_1hr"], r["velocity_3hr"], r["velocity_24hr"])
        for r in spark.read.parquet(str(tmp_path / "asof/table")).collect()
    }
    want = asof_by_hand([(r["nameOrig"], r["step"]) for r in log.collect()])
    last = max(step for _, step in got)
    assert got == {k: v for k, v in want.items() if k[1] <= last}
    assert len(got) >= len(want) - 8


def test_rows_of_closed_hours_over_many_batches(spark, sf_dir, tmp_path):
    log = filter_types(transactions(spark, sf_dir)).select("event_id", "ts", "step", "nameOrig")
    log.withColumn("day", F.floor(F.unix_seconds("ts") / 86_400).cast("int")).write.partitionBy("day").parquet(str(tmp_path / "log"))
    parts = log.withColumn("part", F.least(F.floor(F.col("step") / 240), F.lit(2)).cast("int"))
    hours = velocity.closed_hours(arrivals(spark, parts, str(tmp_path / "in"), 3), EPOCH_SECONDS)
    # one batch of hours after the other, each releasing its transactions
    query = (
        hours.writeStream.format("parquet").option("path", str(tmp_path / "hours/table"))
        .option("checkpointLocation", str(tmp_path / "hours/checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    velocity.start_asof(spark, str(tmp_path / "hours/table"), str(tmp_path / "asof")).awaitTermination()
    velocity.start_asof_rows(
        spark, str(tmp_path / "asof/table"), str(tmp_path / "log"), str(tmp_path / "rows"), "event_id", EPOCH_SECONDS
    ).awaitTermination()
    got = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "rows/rows")).collect()}
    rows = sorted(log.collect(), key=lambda r: (r["step"], r["event_id"]))
    seen = []
    for r in rows:
        before = [x for x in seen if x["nameOrig"] == r["nameOrig"]]
        seen.append(r)
        if r["event_id"] in got:
            want = [len(before)] + [1 + sum(x["step"] // h == r["step"] // h for x in before) for h in (1, 3, 24)]
            assert [got[r["event_id"]][c] for c in S.VELOCITY_FEATURES] == want
    assert len(rows) - len(got) <= 6


def test_closed_buckets_equal_batch_counts(spark, sf_dir, tmp_path):
    log = filter_types(transactions(spark, sf_dir)).select("ts", "step", "nameOrig")
    stream = arrivals(spark, log.withColumn("part", F.lit(0)), str(tmp_path / "in"), 1)
    velocity.start_append(velocity.closed_counts(stream, 24), str(tmp_path / "out")).awaitTermination()
    got = {
        (r["nameOrig"], r["bucket"]): r["n"]
        for r in spark.read.parquet(str(tmp_path / "out/table")).select(
            "nameOrig", "n", F.expr(f"(unix_seconds(start) - {EPOCH_SECONDS}) div 3600 + 1").alias("first")
        ).withColumn("bucket", F.floor(F.col("first") / 24)).collect()
    }
    want = {(r["nameOrig"], r["b"]): r["count"] for r in log.withColumn("b", F.floor(F.col("step") / 24)).groupBy("nameOrig", "b").count().collect()}
    latest = log.agg(F.unix_seconds(F.max("ts"))).first()[0] - EPOCH_SECONDS
    assert got == {k: n for k, n in want.items() if (k[1] * 24 + 23) * 3600 <= latest - 3600}


def accept(spark, rows, folder, parts):
    """Rows arriving part by part, each part run to its end."""
    shape = rows.drop("part").schema
    for part in range(parts):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(shape).parquet(f"{folder}/in")
        velocity.start_accept(stream, f"{folder}/accepted", "event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/accepted/table")


def test_late_rows_are_named(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, 0), (2, 100, 0), (3, 90, 1), (4, 30, 1), (5, 300, 1), (6, 239, 2), (7, 240, 2), (8, 500, 2)],
        "event_id long, minute int, part int",
    ).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH_SECONDS) + F.col("minute") * 60)).drop("minute")
    accepted = accept(spark, rows, str(tmp_path), 3)
    got = {r["event_id"]: r["late"] for r in velocity.late_rows(rows, accepted, "event_id").collect()}
    # a row at the watermark itself is late
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False}
    assert S.LAST_STEP == 743


def test_late_rows_disturb_no_counters(spark, sf_dir, tmp_path):
    """Every tenth row arrives three days late: the others have the counters of a log without it."""
    log = filter_types(transactions(spark, sf_dir)).select("event_id", "ts", "step", "nameOrig")
    part = F.least(F.floor((F.col("step") + F.when(F.col("event_id") % 10 == 0, 72).otherwise(0)) / 150), F.lit(4))
    accepted = accept(spark, log.withColumn("part", part.cast("int")), str(tmp_path), 5)
    kept = accepted.select("event_id", "nameOrig", "step").collect()
    assert 0 < log.count() - len(kept) < log.count() / 8
    rows = spark.readStream.schema(accepted.schema).parquet(f"{tmp_path}/accepted/table")
    velocity.start_append(velocity.closed_hours(rows, EPOCH_SECONDS), f"{tmp_path}/hours").awaitTermination()
    velocity.start_asof(spark, f"{tmp_path}/hours/table", f"{tmp_path}/asof").awaitTermination()
    velocity.start_asof_rows(
        spark, f"{tmp_path}/asof/table", f"{tmp_path}/accepted/table", f"{tmp_path}/rows", "event_id", EPOCH_SECONDS
    ).awaitTermination()
    got = {r["event_id"]: r for r in spark.read.parquet(f"{tmp_path}/rows/rows").collect()}
    assert len(kept) - len(got) <= 6
    seen = []
    for r in sorted(kept, key=lambda r: (r["step"], r["event_id"])):
        before = [x for x in seen if x["nameOrig"] == r["nameOrig"]]
        seen.append(r)
        if r["event_id"] in got:
            want = [len(before)] + [1 + sum(x["step"] // h == r["step"] // h for x in before) for h in (1, 3, 24)]
            assert [got[r["event_id"]][c] for c in S.VELOCITY_FEATURES] == want


def test_silent_accounts_leave_the_state_and_resume(spark, tmp_path):
    steps = {"a": [1, 2, 30, 200, 201, 450], "b": list(range(1, 460, 20)), "c": [5], "d": [460]}
    rows = [(name, step, 2) for name, found in steps.items() for step in found]
    for low in range(0, 480, 80):
        part = [r for r in rows if low <= r[1] < low + 80]
        spark.createDataFrame(part, velocity.HOURS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/hours")
        query = velocity.start_asof(spark, f"{tmp_path}/hours", f"{tmp_path}/asof", idle=48)
        query.awaitTermination()
    written_rows = spark.read.schema(velocity.ASOF_SCHEMA).parquet(f"{tmp_path}/asof/table")
    ended = {(r["nameOrig"], r["life"], r["step"], r["velocity_cumcount"]) for r in written_rows.where("ended").collect()}
    assert ended == {("a", 1, 30, 6), ("a", 200, 201, 4), ("c", 5, 5, 2)}
    state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{tmp_path}/asof/checkpoint")
    assert {r["key"][0] for r in state.select("key").collect()} == {"a", "b", "d"}
    got = {(r["nameOrig"], r["step"]): r["velocity_cumcount"] for r in velocity.asof_table(spark, f"{tmp_path}/asof/table").collect()}
    assert got == {(name, step): 2 * i for name, found in steps.items() for i, step in enumerate(found)}


def test_idle_time_covers_the_longest_bucket(spark):
    with pytest.raises(ValueError, match="24 hours"):
        velocity.asof_counts(spark.createDataFrame([], velocity.HOURS_SCHEMA), idle=23)


def test_open_hours_and_buckets_complete_a_bounded_input(spark):
    rows = spark.createDataFrame([("a", s) for s in (1, 1, 2, 5, 7, 7)] + [("b", 7), ("b", 2)], "nameOrig string, step int")
    hours = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 2, 1)], velocity.HOURS_SCHEMA)
    rest = velocity.open_hours(rows, hours)
    assert {tuple(r) for r in rest.collect()} == {("a", 5, 1), ("a", 7, 2), ("b", 7, 1)}
    every = hours.unionByName(rest)
    closed = spark.createDataFrame([("a", 0, 3), ("b", 0, 1)], "nameOrig string, bucket int, n int")
    assert {tuple(r) for r in velocity.open_buckets(every, closed, 3).collect()} == {("a", 1, 1), ("a", 2, 2), ("b", 2, 1)}
    none = velocity.open_hours(rows, hours.limit(0))
    assert none.agg(F.sum("n")).first()[0] == 8
    assert velocity.open_hours(rows.limit(0), hours).count() == 0
