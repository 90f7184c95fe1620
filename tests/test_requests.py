import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch import workspace
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import reports, validation
from ledgerwatch.plans import investigation
from ledgerwatch.registry.tables import LINEAR_TERMS
from ledgerwatch.sources import transactions as log

REQUEST = (
    "step int, type string, amount double, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double,"
    " newbalanceDest double, velocity_cumcount int, velocity_1hr int, velocity_3hr int, velocity_24hr int"
)
FRAUD = (1, "TRANSFER", 181.0, 181.0, 0.0, 0.0, 0.0, 1, 1, 1, 1)


def failed(spark, **changes):
    names = [part.split()[0] for part in REQUEST.split(", ")]
    row = tuple({**dict(zip([n.strip() for n in names], FRAUD, strict=True)), **changes}.values())
    return validation.validate(spark.createDataFrame([row], REQUEST)).first()["failed"]


def test_valid_request(spark):
    assert failed(spark) == []


@pytest.mark.parametrize(
    "field,value",
    [("type", "PAYMENT"), ("amount", -100.0), ("amount", 0.0), ("step", 0), ("step", 744), ("oldbalanceOrg", -0.01),
     ("velocity_24hr", -1), ("type", None), ("amount", None), ("newbalanceDest", None)],
)
def test_rejected_request(spark, field, value):
    assert failed(spark, **{field: value}) == [field]


def test_several_rules_at_once(spark):
    assert failed(spark, step=0, amount=-1.0, oldbalanceDest=-1.0) == ["step", "amount", "oldbalanceDest"]


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([FRAUD, (0, *FRAUD[1:])], REQUEST)
    valid, rejected = validation.split_valid(df)
    assert (valid.count(), rejected.count()) == (1, 1)
    assert valid.columns == df.columns


def test_missing_velocity(spark):
    df = spark.createDataFrame([(None,), (3,)], "velocity_24hr int")
    assert [tuple(r) for r in validation.default_velocity(df).select(*S.VELOCITY_FEATURES).collect()] == [(1, 1, 1, 1), (1, 1, 1, 3)]
    assert validation.default_velocity(df, 0).first()["velocity_24hr"] == 0


@pytest.mark.parametrize(
    "label,velocity,outcome",
    [("MEDIUM", 8, "ESCALATE"), ("LOW", 14, "MONITOR"), ("LOW", 6, "MONITOR"), ("LOW", 1, "CLEAR"), ("HIGH", 1, "ESCALATE"), ("MEDIUM", 5, "MONITOR")],
)
def test_recommendation(spark, label, velocity, outcome):
    df = spark.createDataFrame([(label, velocity)], "label string, v24 int")
    assert df.select(C.recommendation(F.col("label"), F.col("v24") > S.VELOCITY_FLAG_ABOVE)).first()[0] == outcome


def test_velocity_check(spark):
    df = spark.createDataFrame([(1, None, 2, 4, 7), (2, 1, 1, 1, 5)], "key long, velocity_cumcount int, velocity_1hr int, velocity_3hr int, velocity_24hr int")
    rows = reports.velocity_check(df, "key").orderBy("key").collect()
    assert [r["risk_flag"] for r in rows] == [True, False] and rows[0]["velocity_cumcount"] == 0


def test_drivers_keep_model_order_on_ties(spark):
    values = [0.5, -0.5, 0.0, 0.5] + [0.0] * 8
    df = spark.createDataFrame([(values,)], "attributions array<double>")
    df = df.withColumns({c: F.lit(1.0) for c in S.REALISTIC_FEATURES})
    listed = df.select(reports.drivers().alias("d"), reports.flagged_features().alias("f")).first()
    assert [d["feature"] for d in listed["d"][:3]] == ["step", "type_encoded", "log_amount"]
    assert listed["d"][1]["direction"] == "decreases_fraud" and listed["d"][3]["direction"] == "decreases_fraud"
    assert listed["f"] == ["Hour of transaction", "Log amount"]


def test_raw_value_is_the_float32_one(spark):
    df = spark.createDataFrame([([0.0] * 12, 20_000_001.37)], "attributions array<double>, amount double")
    df = df.withColumns({c: F.lit(1.0) for c in S.REALISTIC_FEATURES if c != "amount"})
    raw = {d["feature"]: d["raw_value"] for d in df.select(reports.drivers()).first()[0]}
    assert raw["amount"] == 20_000_002.0


def test_stand_in_terms_cover_the_features():
    assert tuple(LINEAR_TERMS) == S.REALISTIC_FEATURES
    assert set(S.FULL_FEATURES) - set(S.REALISTIC_FEATURES) == set(S.BALANCE_FEATURES)


def test_missing_columns_are_named(spark):
    df = spark.range(1)
    assert log.missing_columns(df) == ["isFraud"]
    with pytest.raises(ValueError, match="isFraud"):
        log.require_columns(df)


def test_csv_schema_and_preview(spark, tmp_path):
    (tmp_path / "log.csv").write_text(",".join(S.TXN_SCHEMA.names) + "\n1,PAYMENT,9.5,C1,10,0.5,M1,0,0,0,0\n")
    df = log.scan_csv(spark, str(tmp_path / "log.csv"))
    assert df.schema.simpleString() == S.TXN_SCHEMA.simpleString()
    assert df.first()["amount"] == 9.5
    assert [r["type"] for r in log.column_types(df).orderBy("position").limit(3).collect()] == ["int", "string", "double"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())
    Context.master = "local[2]"
    assert workspace.shared_dir(Session()) == workspace.shared_dir(Session())


def test_sort_query_is_in_order(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.queries()["sort_account_step"](spark, sf_dir).collect()
    keys = [(r["nameOrig"], r["step"], r["event_id"]) for r in rows]
    assert keys == sorted(keys)


def test_questions_follow_the_finding(spark):
    rows = [("HIGH", "CASH_OUT", True, ["Amount", "Hour"]), ("LOW", "TRANSFER", False, []), ("LOW", "TRANSFER", None, None)]
    df = spark.createDataFrame(rows, "label string, type string, flag boolean, drivers array<string>")
    asked = df.select(investigation.question(F.col("label"), F.col("type"), F.col("flag"), F.col("drivers"))).collect()
    assert [r[0] for r in asked] == [
        "high risk cash out with many transactions in a day because of amount and hour", "low risk transfer", "low risk transfer",
    ]


def test_rejected_transactions_leave_an_error_event(spark):
    df = spark.createDataFrame([(4, ["step", "amount"])], "key long, failed array<string>")
    (event,) = investigation.error_events(df, "key").collect()
    assert event.asDict() == {
        "investigation_id": 4, "seq": 0, "type": "error", "name": None, "input": None, "content": "invalid transaction: step, amount",
    }


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_numbers_that_are_none_are_rejected_by_name(spark, bad):
    good = {"step": 5, "type": "TRANSFER", "amount": 1.0, "oldbalanceOrg": 1.0, "newbalanceOrig": 0.0, "oldbalanceDest": 0.0, "newbalanceDest": 0.0}
    numbers = [n for n, v in good.items() if isinstance(v, float)]
    rows = [tuple(bad if n == name else v for n, v in good.items()) for name in numbers]
    shape = ", ".join(f"{n} {'int' if n == 'step' else 'string' if n == 'type' else 'double'}" for n in good)
    checked = validation.validate(spark.createDataFrame(rows, shape)).collect()
    assert [r["failed"] for r in checked] == [[n] for n in numbers]
    assert validation.split_valid(spark.createDataFrame(rows, shape))[0].count() == 0
