"""The commands, from a CSV log to findings."""

import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.jobs import JOBS, main
from ledgerwatch.registry.tables import transactions


@pytest.fixture(scope="module")
def work(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    log = transactions(spark, sf_dir)
    log.orderBy("event_id").coalesce(1).select(*S.TXN_SCHEMA.names).write.option("header", True).csv(f"{root}/log")
    requests = log.where("event_id < 60").select(
        F.col("event_id").alias("row_id"), "step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
        "newbalanceDest",
    )
    requests.write.parquet(f"{root}/requests")
    (root / "docs").mkdir()
    (root / "docs/a.txt").write_text(
        "Suspicious transaction reports have a deadline of thirty days after detection.\n\n"
        "More than five transactions in a day count as high velocity and escalate to review.\n\n"
        "An account balance drained to zero is a fraud signal that needs a hold and a call.\n"
    )
    return root


def test_from_log_to_findings(spark, work):
    def read(name):
        return spark.read.parquet(f"{work}/{name}")

    main(["ingest", "--log", f"{work}/log", "--chunk-rows", "300", "--out", f"{work}/ingest"])
    assert read("ingest/totals").first().asDict()["total_rows"] == 1000
    assert [r["rows"] for r in read("ingest/chunks").orderBy("chunk").collect()] == [300, 300, 300, 100]
    assert read("ingest/preview").count() == 5

    main(["profile", "--log", f"{work}/log", "--sample", "0.5", "--out", f"{work}/profile"])
    assert read("profile/fraud_by_type").count() == 5
    stats = {r["isFraud"]: r["rows"] for r in read("profile/amount_stats").collect()}
    assert stats[1] == 17 and 400 < stats[0] < 600

    main(["features", "--log", f"{work}/log", "--out", f"{work}/features"])
    assert read("features/sanity").first()["rows"] == 412
    assert read("features/features").columns == ["row_id", *S.FEATURE_TABLE]

    main(["train", "--features", f"{work}/features/features", "--trees", "4", "--depth", "3", "--out", f"{work}/models"])
    assert read("models/runs").count() == 2

    model = f"{work}/models/model_12"
    main(["explain", "--features", f"{work}/features/features", "--model", model, "--out", f"{work}/explain"])
    assert read("explain/importance").count() == 12

    main(["score", "--requests", f"{work}/requests", "--model", model, "--out", f"{work}/scored"])
    predictions, rejected = read("scored/predictions"), read("scored/rejected")
    assert predictions.count() + rejected.count() == 60
    assert read("scored/explanations").where(F.size("features") != 12).count() == 0

    main(["corpus", "--docs", f"{work}/docs", "--out", f"{work}/corpus"])
    assert read("corpus/vectors").count() == 3

    main(["investigate", "--requests", f"{work}/requests", "--model", model, "--corpus", f"{work}/corpus", "--out", f"{work}/found"])
    findings = read("found/findings")
    assert findings.count() == predictions.count()
    assert spark.read.text(f"{work}/found/trace").where("value like 'data: {%'").count() >= 7 * findings.count()

    main(["score-stream", "--requests", f"{work}/requests", "--model", model, "--out", f"{work}/stream"])
    assert read("stream/scored").count() == predictions.count()


def test_velocity_stream(spark, work):
    main(["velocity-stream", "--log", f"{work}/log", "--out", f"{work}/velocity"])
    hours = spark.read.parquet(f"{work}/velocity/asof/table")
    counts = spark.read.parquet(f"{work}/velocity/counts_1h/table")
    assert hours.count() == counts.count() > 300
    days = spark.read.parquet(f"{work}/velocity/counts_24h/table")
    log = spark.read.schema(S.TXN_SCHEMA).option("header", True).csv(f"{work}/log").where("type in ('TRANSFER', 'CASH_OUT')")
    per_day = log.groupBy("nameOrig", F.floor(F.col("step") / 24).alias("day")).count()
    assert per_day.count() - days.count() <= 8
    assert days.agg(F.sum("n")).first()[0] <= log.count()


def test_velocity_counts_are_whole_when_the_input_ends(spark, work):
    main(["velocity-stream", "--log", f"{work}/log", "--out", f"{work}/whole"])
    log = spark.read.schema(S.TXN_SCHEMA).option("header", True).csv(f"{work}/log").where("type in ('TRANSFER', 'CASH_OUT')")
    for hours in (1, 3, 24):
        parts = [spark.read.parquet(f"{work}/whole/counts_{hours}h{part}") for part in ("/table", "_open")]
        found = parts[0].select("nameOrig", "n").unionByName(parts[1].select("nameOrig", "n"))
        assert found.agg(F.sum("n")).first()[0] == log.count()
        want = log.groupBy("nameOrig", F.floor(F.col("step") / hours)).count()
        assert found.count() == want.count()


def test_velocity_rows(spark, sf_dir, work):
    from ledgerwatch.registry.tables import transactions

    log = transactions(spark, sf_dir).select("event_id", "type", "nameOrig", "step")
    log.write.mode("overwrite").parquet(f"{work}/keyed")
    main(["velocity-rows", "--log", f"{work}/keyed", "--key", "event_id", "--out", f"{work}/rows"])
    rows = spark.read.parquet(f"{work}/rows/rows")
    relevant = log.where("type in ('TRANSFER', 'CASH_OUT')")
    assert relevant.count() - rows.count() <= 8  # the last hour is open
    assert spark.read.parquet(f"{work}/rows/late").count() == 0
    ordered = sorted((r["nameOrig"], r["step"], r["event_id"], r["velocity_cumcount"]) for r in rows.collect())
    place = {}
    for account, _, _, counted in ordered:
        assert counted == place.get(account, 0)
        place[account] = counted + 1


def test_jobs_leave_no_intermediate_tables(spark, tmp_path):
    import os

    from ledgerwatch.workspace import job_folder, new_dir, written

    outside = new_dir(spark, "kept")
    with job_folder(spark, "outer") as outer:
        spark.range(3).write.parquet(new_dir(spark, "a"))
        with pytest.raises(RuntimeError), job_folder(spark, "inner") as inner:
            assert written(spark.range(2), "b").count() == 2 and os.listdir(inner)
            raise RuntimeError
        assert not os.path.exists(inner) and os.listdir(outer)
    assert not os.path.exists(outer)
    assert os.path.dirname(new_dir(spark, "kept")) == os.path.dirname(outside)


def test_session_settings(spark):
    from ledgerwatch.session import SETTINGS, open_session

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    session = open_session("settings")
    assert session.conf.get("spark.sql.session.timeZone") == "UTC"
    assert "RocksDB" in session.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, v in before.items():
        if v is not None:
            spark.conf.set(k, v)


def test_every_job_has_a_help_line():
    assert all(run.__doc__ for run, _ in JOBS.values())


def test_unknown_job():
    with pytest.raises(SystemExit):
        main(["nothing"])
