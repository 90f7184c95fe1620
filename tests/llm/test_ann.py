"""Neighbour graphs against brute force, and the defined results of odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, 7) for r in rows], SCHEMA)


def brute(rows, k=5, every=50):
    """Per query the k best other rows: cosine in doubles, ties to the smaller id."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for at, (q, v) in enumerate(good):
        if q % every == 0:
            scores = [(-(w @ v) / (np.linalg.norm(w) * np.linalg.norm(v)), i) for j, (i, w) in enumerate(good) if j != at and len(w) == len(v)]
            out[q] = sorted(scores)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard", [8192, 150])
def test_recall_and_scores(spark, shard):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 24))
    vectors = centres[rng.integers(0, 20, 900)] + 0.5 * rng.normal(size=(900, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=shard)), brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert [(-x[2], x[1]) for x in got[q]] == sorted((-x[2], x[1]) for x in got[q])
        hits += len({x[1] for x in got[q]} & {i for _, i in best})
        scores = dict((i, -s) for s, i in brute(rows, k=900)[q])
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in got[q])
    assert hits >= 0.95 * 5 * len(want)


def test_copies_go_to_the_smallest_ids(spark):
    """A third of the rows are one vector; they must not fill a graph, and ties go to the smaller id."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.0, 0.5] if i % 3 else rng.normal(size=4).tolist()) for i in range(600)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    for q, best in want.items():
        if q % 3:
            assert [x[1] for x in got[q]] == [i for _, i in best]


def test_odd_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, [1.0, 2.0, 3.0]), (-50, [-0.0, 2.0]),
    ]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0))
    assert [x[1] for x in got[0]] == [1, -50, 50, 50]
    assert [x[1] for x in got[50]] == [-50, 50, 1, 0]  # the other row of the same key is a candidate
    assert [x[1] for x in got[-50]] == [50, 50, 1, 0]
    assert 100 not in got  # nothing of its length


def test_large_and_small_numbers(spark):
    rows = [(0, [1e30, 1e30]), (1, [1e-30, 1e-30]), (2, [1e30, 0.0])]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") == 0))
    assert [x[1] for x in got[0]] == [1, 2] and abs(got[0][0][2] - 1) < 1e-12


def test_empty_table(spark):
    assert ann.nearest(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_tasks_grow_with_the_queries_alone(spark, monkeypatch):
    """Blocks of queries times shards would be tasks and copies of graphs without end, and the driver keeps an entry of each."""
    monkeypatch.setattr(ann, "QUERIES", 2)
    monkeypatch.setattr(ann, "PAIR_TASKS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6 + i % 2).tolist()) for i in range(600)] + [(i, [0.5, 1.0, 2.0]) for i in range(600, 700)]
    blocks, shards = 7, 80

    def tasks(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return "Join" in plan, max(int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan))

    one = ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=8)
    assert tasks(one) == (False, blocks)
    met = ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=8, read_shared=False)
    assert tasks(met) == (True, 16) and blocks * shards > 500
    got, want = found(one), brute(rows)
    assert got == found(met)
    assert set(got) == set(want) and one.schema["rank"].dataType.typeName() == "integer"
    assert all([x[1] for x in got[q]] == [i for _, i in best] for q, best in want.items())


def test_best_counts_copies():
    """Three copies of key 4 take three ranks; ties go to the smaller key."""
    one = tuple(np.array(x) for x in ([0, 0, 1], [4, 9, 5], [0.5, 0.9, 0.1], [3, 1, 1]))
    two = tuple(np.array(x) for x in ([0, 0], [2, 3], [0.5, 0.1], [1, 1]))
    best = ann._best(ann._best(None, one, 4), two, 4)
    assert [x.tolist() for x in best] == [[0, 0, 0, 1], [9, 2, 4, 5], [0.9, 0.5, 0.5, 0.1], [1, 1, 2, 1]]
    assert all(not len(x) for x in ann._best(None, tuple(x[:0] for x in one), 4))
