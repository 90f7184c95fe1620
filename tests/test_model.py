from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators import attribution, model as M, reports
from ledgerwatch.registry.model_queries import trained
from ledgerwatch.sources import run_log

SMALL = ("a", "b", "c")


@pytest.fixture(scope="module")
def small(spark):
    df = spark.range(400).select(
        F.col("id").alias("key"),
        (F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 61 % 89).cast("double").alias("b"),
        (F.col("id") % 5).cast("double").alias("c"),
        F.lit(1.0).alias("never_split"),
    )
    df = df.withColumn("isFraud", ((F.col("a") > 60) & (F.col("b") < 40) | (F.col("a") + F.col("b") > 150)).cast("byte"))
    df = df.cache()
    return df, M.train(df, (*SMALL, "never_split"), trees=6, depth=4)


def tree_expectation(tree, node, row, known):
    n = tree[node]
    if n["leftChild"] < 0:
        return n["prediction"]
    f = n["split"]["featureIndex"]
    left, right = n["leftChild"], n["rightChild"]
    if f in known:
        goes = left if row[f] <= n["split"]["leftCategoriesOrThreshold"][0] else right
        return tree_expectation(tree, goes, row, known)
    a, b = tree[left]["rawCount"], tree[right]["rawCount"]
    return (a * tree_expectation(tree, left, row, known) + b * tree_expectation(tree, right, row, known)) / (a + b)


def test_attributions_are_subset_shapley(spark, small, tmp_path):
    df, model = small
    model.classifier.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m/data")).collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    weights = model.classifier.treeWeights
    rows = df.limit(6)
    got = {r["key"]: r for r in attribution.explain_rows(rows, model, "key").collect()}

    def value(row, known):
        return 2 * sum(w * tree_expectation(trees[t], 0, row, known) for t, w in enumerate(weights))

    n = 4
    for r in rows.collect():
        x = [r[c] for c in model.features]
        for i in range(n):
            others = [j for j in range(n) if j != i]
            phi = sum(
                factorial(k) * factorial(n - k - 1) / factorial(n) * (value(x, {*s, i}) - value(x, set(s)))
                for k in range(n)
                for s in combinations(others, k)
            )
            assert got[r["key"]]["attributions"][i] == pytest.approx(phi, abs=1e-9)
        assert got[r["key"]]["base_value"] == pytest.approx(value(x, set()), abs=1e-9)
        assert got[r["key"]]["attributions"][3] == 0


def test_attributions_add_up_to_the_margin(small):
    df, model = small
    scored = M.score(df, model)
    rows = attribution.explain_table(scored, model, ["key", "score"]).collect()
    for r in rows:
        assert r["base_value"] + sum(r["attributions"]) == pytest.approx(np.log(r["score"] / (1 - r["score"])), abs=1e-9)
        assert 0 <= r["score"] <= 1


def test_save_and_load(spark, small, tmp_path):
    df, model = small
    tuned = M.FraudModel(model.classifier, model.features, 0.37)
    M.save_model(tuned, str(tmp_path / "m"))
    loaded = M.load_model(spark, str(tmp_path / "m"))
    assert (loaded.threshold, loaded.features) == (0.37, model.features)
    both = M.score(df, tuned).join(M.score(df, loaded, "again").select("key", "again"), "key")
    assert both.where("score <> again").count() == 0


def test_training_run(spark, sf_dir):
    job = trained(spark, sf_dir)
    runs = run_log.read_runs(spark, f"{job.out}/runs")
    assert {r["run"] for r in runs.collect()} == {"Full (with leakage)", "Realistic (no leakage)"}
    compared = run_log.run_compare(runs, ["Full (with leakage)", "Realistic (no leakage)"])
    assert compared.count() == 13
    metrics = {r["run"]: r["metrics"] for r in runs.collect()}
    assert metrics["Full (with leakage)"]["roc_auc"] > 0.9
    info = M.model_info(job.model).first()
    assert info["n_estimators"] == 20 and len(info["feature_labels"]) == 12


def test_predict_and_explain_agree(spark, sf_dir):
    job = trained(spark, sf_dir)
    scored = M.score(job.features, job.model)
    explained = attribution.explain_table(scored, job.model, ["event_id", *S.FEATURE_TABLE, "score"])
    predicted = reports.predict_report(explained, "event_id", job.model.threshold)
    report = reports.explain_report(explained, "event_id")
    joined = predicted.join(report.withColumnRenamed("risk_score", "again").withColumnRenamed("features", "all"), "event_id")
    for r in joined.collect():
        assert r["risk_score"] == r["again"]
        assert len(r["all"]) == 12
        sizes = [abs(f["shap_value"]) for f in r["all"]]
        assert sizes == sorted(sizes, reverse=True)
        assert {f["direction"] for f in r["all"]} <= {"increases_fraud", "decreases_fraud"}
        assert r["top_driver"] == r["all"][0]["label"] and len(r["summary"]) > 20
        raising = [f["label"] for f in r["all"] if f["shap_value"] > 0]
        assert set(r["flagged_features"]) <= set(raising) | {f["label"] for f in r["all"] if f["shap_value"] == 0}
        assert r["risk_label"] in ("HIGH", "MEDIUM", "LOW")
        assert (r["predicted_class"] == 1) == (r["risk_label"] == "HIGH")


def test_importance(spark, sf_dir):
    job = trained(spark, sf_dir)
    explained = attribution.explain_rows(job.features, job.model, "event_id")
    rows = attribution.global_importance(explained, S.REALISTIC_FEATURES).collect()
    assert len(rows) == 12 and sum(r["above_median"] for r in rows) <= 6
    values = np.array([r["attributions"] for r in explained.collect()])
    want = dict(zip(S.REALISTIC_FEATURES, np.abs(values).mean(axis=0), strict=True))
    for r in rows:
        assert r["mean_abs"] == pytest.approx(want[r["feature"]], abs=1e-9)


def test_labels_at_the_thresholds(spark):
    from ledgerwatch.functions import columns as C

    df = spark.createDataFrame([(0.5,), (0.4999,), (0.3,), (0.2999,)], "s double")
    assert [r[0] for r in df.select(C.risk_label("s", 0.5)).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def uniform(name, low, high):
    """Numbers in [low, high), a fixed sequence per name."""
    from ledgerwatch.functions import columns as C

    return low + C.unit_interval(C.hash_key("key", hash_of(name))) * (high - low)


def hash_of(name):
    return sum(ord(c) * 31**i for i, c in enumerate(name)) % 10_000


@pytest.fixture(scope="module")
def separable(spark):
    """2,000 requests; those labelled move large sums and leave the sender with next to nothing."""
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 4 == 0).cast("byte").alias("isFraud"))
    bad = F.col("isFraud") == 1
    df = df.withColumns(
        {
            "step": F.ceil(uniform("hour", 0, 700)).cast("int"),
            "type_encoded": (1 + (F.col("key") % 2)).cast("byte"),
            "amount": F.when(bad, uniform("large", 20_000, 90_000)).otherwise(uniform("small", 10, 30_000)),
            "oldbalanceDest": uniform("there", 0, 8_000),
            "velocity_cumcount": F.floor(uniform("past", 0, 40)).cast("int"),
            "velocity_24hr": F.floor(uniform("day", 1, 9)).cast("int"),
        }
    )
    left = F.when(bad, uniform("rest", 0, 100)).otherwise(uniform("purse", 3_000, 60_000))
    df = df.withColumns({"newbalanceOrig": left, "oldbalanceOrg": left + F.col("amount")})
    df = df.withColumns(
        {
            "log_amount": F.log1p("amount"),
            "newbalanceDest": F.when(bad, F.col("oldbalanceDest")).otherwise(F.col("oldbalanceDest") + F.col("amount")),
            "velocity_1hr": F.lit(1),
            "velocity_3hr": F.least(F.lit(2), F.col("velocity_24hr")),
        }
    ).cache()
    return df, M.train(df, trees=15, depth=4, order=("key",))


def test_recall_on_separable_rows(separable):
    df, model = separable
    fraud = M.score(df, model).where("isFraud = 1")
    assert fraud.where("score >= 0.5").count() / fraud.count() > 0.8


def test_example_requests(spark, separable):
    from ledgerwatch.streaming.scoring import score_batch

    requests = spark.createDataFrame(
        [
            ("fraud", 1, "TRANSFER", 181.0, 181.0, 0.0, 0.0, 0.0, 1, 1, 1, 1),
            ("legit", 200, "CASH_OUT", 5000.0, 50000.0, 45000.0, 10000.0, 15000.0, 10, 1, 2, 3),
            ("bad type", 1, "PAYMENT", 181.0, 181.0, 0.0, 0.0, 0.0, 1, 1, 1, 1),
            ("bad amount", 1, "TRANSFER", -100.0, 181.0, 0.0, 0.0, 0.0, 1, 1, 1, 1),
        ],
        "name string, step int, type string, amount double, oldbalanceOrg double, newbalanceOrig double,"
        " oldbalanceDest double, newbalanceDest double, velocity_cumcount int, velocity_1hr int, velocity_3hr int,"
        " velocity_24hr int",
    )
    scored, rejected = score_batch(requests, separable[1])
    scores = {r["name"]: r["risk_score"] for r in scored.collect()}
    assert set(scores) == {"fraud", "legit"} and all(0 <= s <= 1 for s in scores.values())
    assert scores["legit"] < 0.9 and scores["fraud"] > scores["legit"]
    assert {r["name"]: r["failed"] for r in rejected.collect()} == {"bad type": ["type"], "bad amount": ["amount"]}


def test_training_repeats(separable):
    df, model = separable
    again = M.train(df.repartition(7), trees=15, depth=4, order=("key",))
    both = M.score(M.score(df, model), again, "again")
    assert both.where(F.abs(F.col("score") - F.col("again")) > 1e-9).count() == 0


def test_investigation_trace(spark, sf_dir):
    import json

    from ledgerwatch.registry import QUERIES

    events = QUERIES["trace_events"](spark, sf_dir).orderBy("investigation_id", "seq").collect()
    traces = {}
    for e in events:
        traces.setdefault(e["investigation_id"], []).append(e)
    findings = {r["event_id"]: r for r in QUERIES["investigate"](spark, sf_dir).collect()}
    assert set(traces) == set(findings) and len(findings) == 412
    for key, trace in traces.items():
        found = findings[key]
        assert [e["seq"] for e in trace] == list(range(len(trace)))
        tools = [e["name"] for e in trace if e["type"] == "tool_call"]
        expected = [t for t in S.TOOL_LABELS if t != "tool_explain_prediction" or found["risk_score"] >= 0.4]
        assert tools == expected and trace[-1]["type"] == "report"
        assert (found["summary"] is not None) == (found["risk_score"] >= 0.4)
        assert found["recommendation"] in trace[-1]["content"]
        assert all(len(e["content"]) <= 500 for e in trace if e["type"] == "tool_result")
        assert set(json.loads(trace[0]["input"])["transaction"]) == set(S.REQUEST_FIELDS)
        assert found["passages"]
