import random

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import curves, profiling
from ledgerwatch.operators.running import running_totals

SPLIT = {"bucket_rows": 8}


def table(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(7)
    rows = [(round(rnd.random() ** 3, 2), int(rnd.random() < 0.2)) for _ in range(700)]
    return rows + [(0.5, i % 3 == 0 and 1 or 0) for i in range(400)]


def brute(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before, best = 0.0, 0, (-1.0, 0.0)
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(p >= s for p in pos)
        predicted = sum(x >= s for x, _ in pairs)
        p, r = tp / predicted, tp / len(pos)
        ap += (tp - before) / len(pos) * p
        before = tp
        best = max(best, (2 * p * r / (p + r + 1e-9), -s))
    return auc, ap, best[0], -best[1]


@pytest.mark.parametrize("layout", [{}, SPLIT])
def test_metrics_match_brute_force(spark, pairs, layout):
    row = curves.evaluate(table(spark, pairs), **layout).first()
    auc, ap, f1, threshold = brute(pairs)
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert row["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert row["best_f1"] == pytest.approx(f1, abs=1e-12)
    assert row["best_threshold"] == threshold
    assert row["true_positives"] == sum(s >= threshold and y == 1 for s, y in pairs)
    assert row["false_positives"] == sum(s >= threshold and y == 0 for s, y in pairs)


@pytest.mark.parametrize("layout", [{}, SPLIT])
def test_all_scores_tied(spark, layout):
    counts = curves.score_counts(table(spark, [(0.3, i % 4 == 0 and 1 or 0) for i in range(40)]))
    assert curves.roc_auc(counts, **layout).first()[0] == 0.5
    assert curves.pr_auc(counts, **layout).first()[0] == 0.25


def test_one_class_only(spark):
    counts = curves.score_counts(table(spark, [(0.1, 0), (0.2, 0)]))
    assert curves.roc_auc(counts).first()[0] is None
    assert curves.pr_auc(counts).first()[0] is None


def test_empty_scores(spark):
    counts = curves.score_counts(table(spark, [(None, 1)]))
    assert curves.roc_auc(counts).first()[0] is None
    assert curves.running_curve(counts).count() == 0


def test_null_scores_are_left_out(spark):
    matrix = curves.confusion_matrix(table(spark, [(0.9, 1), (None, 1), (0.1, 0)]), 0.5).first()
    assert tuple(matrix) == (1, 0, 0, 1)


def test_report_with_no_hits(spark):
    report = {
        r["class"]: r
        for r in curves.classification_report(curves.confusion_matrix(table(spark, [(0.1, 1), (0.2, 0)]), 0.5)).collect()
    }
    assert report["Fraud"]["precision"] == 0.0 and report["Fraud"]["recall"] == 0.0
    assert report["Legit"]["recall"] == 1.0 and report["accuracy"]["f1"] == 0.5


def test_curve_ends(spark, pairs):
    counts = curves.score_counts(table(spark, pairs))
    closed = curves.with_end_point(curves.pr_curve(counts))
    assert closed.count() == len({s for s, _ in pairs}) + 1
    last = closed.where("score is null").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_by_bucket(spark, descending):
    rows = [(g, v, (v * 31 + g) % 7) for g in (0, 1) for v in range(300)]
    got = running_totals(
        spark.createDataFrame(rows, "g int, v int, n long"), "v", ["n"], group="g", descending=descending, **SPLIT
    ).collect()
    assert len(got) == 600
    for r in got:
        ahead = (x for g, v, x in rows if g == r["g"] and (v > r["v"] if descending else v < r["v"]) for x in [x])
        assert r["n_before"] == sum(ahead)


@pytest.mark.parametrize("layout", [{}, SPLIT])
@pytest.mark.parametrize("amounts", [[1, 2, 10, 20], [5], [3, 3, 3], list(range(101)), [7] * 50 + [9] * 50])
def test_exact_median(spark, layout, amounts):
    df = spark.createDataFrame([(float(a), y) for a in amounts for y in (0, 1)], "amount double, isFraud byte")
    ordered = sorted(amounts)
    middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    for r in profiling.amount_stats(df, **layout).collect():
        assert (r["rows"], r["median"], r["max"]) == (len(amounts), middle, max(amounts))
        assert r["mean"] == pytest.approx(sum(amounts) / len(amounts), abs=1e-4)


def test_histogram_of_one_amount(spark):
    df = spark.createDataFrame([(5.0, 1), (5.0, 1), (1.0, 0), (2.0, 0)], "amount double, isFraud byte")
    bins = {(r["isFraud"], r["bin"]): r["rows"] for r in profiling.amount_histogram(df).collect()}
    assert bins == {(1, 30): 2, (0, 0): 1, (0, 59): 1}


def test_anomaly_precision_without_anomalies(spark):
    row = spark.createDataFrame(
        [("TRANSFER", 5.0, 5.0, 0.0, 5.0, 0)],
        "type string, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double, isFraud byte",
    )
    assert profiling.anomaly_precision(row).first()["precision_pct"] is None


def test_class_shares_add_up(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "isFraud byte")
    got = {r["name"]: r["pct"] for r in profiling.class_distribution(df).collect()}
    assert got == {"Fraud": 25.0, "Legitimate": 75.0}
    assert profiling.label_summary(df).select(F.sum("positives")).first()[0] == 1


@pytest.mark.parametrize("layout", [{}, SPLIT, {"bucket_rows": 1}])
def test_nan_and_null_are_left_out_alike(spark, layout):
    rows = [(0.9, 1), (0.2, 0), (0.2, 1), (float("nan"), 1), (None, 1), (0.7, None), (0.4, 0)]
    row = curves.evaluate(table(spark, rows), **layout).first()
    whole = curves.evaluate(table(spark, [r for r in rows if r[0] is not None and r[0] == r[0] and r[1] is not None])).first()
    assert row == whole
    matrix = curves.confusion_matrix(table(spark, rows), 0.4).first()
    assert tuple(matrix) == (1, 1, 1, 1)


@pytest.mark.parametrize("layout", [{}, {"bucket_rows": 1}])
def test_amounts_with_nan_null_and_ties(spark, layout):
    rows = [(5.0, 0), (float("nan"), 0), (None, 0), (1.0, 0), (5.0, 0), (9.0, 1), (float("nan"), 1), (3.0, None)]
    df = spark.createDataFrame(rows, "amount double, isFraud int")
    got = {r["isFraud"]: tuple(r)[1:] for r in profiling.amount_stats(df, **layout).collect()}
    assert got == {0: (3, 3.6667, 5.0, 5.0), 1: (1, 9.0, 9.0, 9.0)}
    assert profiling.amount_histogram(df, 4).agg(F.sum("rows")).first()[0] == 4


def test_running_totals_put_nan_last(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2), (2.0, 4)], "v double, n long")
    got = {str(r["v"]): r["n_before"] for r in running_totals(df, "v", ["n"], bucket_rows=1).collect()}
    assert got == {"1.0": 0, "2.0": 2, "nan": 6}
