import random

import numpy as np
import plans
import pytest

from pyspark.sql import functions as F

from ledgerwatch.operators import neighbors
from ledgerwatch.operators.neighbors import grid, knn, packed, self_knn

SMALL = {"few_queries": 0, "cells": 12, "block": 16}


def points(seed, n, width, copies=0):
    rnd = random.Random(seed)
    rows = [(i, [round(rnd.gauss(0, 1) * (1 + i % 5), 3) for _ in range(width)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def brute(queries, base, k):
    out = {}
    for q, v in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in base)
        out[q] = [i for _, i in d[:k]]
    return out


def run(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


@pytest.mark.parametrize("layout", [{}, SMALL, {"few_queries": 0, "cells": 1, "block": 1000}, {"few_queries": 0, "cells": 200, "block": 3}])
@pytest.mark.parametrize("width,k", [(2, 3), (8, 7)])
def test_matches_brute_force(spark, layout, width, k):
    # a third of the vectors are copies of one
    base, queries = points(1, 120, width, copies=60), points(2, 50, width)
    queries += [(500 + i, base[0][1]) for i in range(10)]
    as_df = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    assert run(knn(as_df(queries), as_df(base), k, **layout)) == brute(queries, base, k)


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("width,with_vector", [(3, True), (20, False)])
def test_blocks_and_grid_match_brute_force(spark, width, with_vector, shared):
    base, queries = points(6, 150, width, copies=40), points(7, 70, width)
    as_df = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    layout = {"few_queries": 0, "bin_dimensions": 0, "grid_block": 16, "read_shared": shared}
    near = knn(as_df(queries), as_df(base), 4, with_vector=with_vector, **layout)
    assert run(near) == brute(queries, base, 4)
    if with_vector:
        known = dict(base)
        assert all(r["vector"] == known[r["id"]] for r in near.collect())


def test_grid_moves_blocks_not_pairs(spark):
    """At 384 dimensions 600 queries and 900 vectors shuffle 2 x 12 rows, each a block of whole vectors."""
    df = spark.range(900).select("id", F.transform(F.sequence(F.lit(1), F.lit(384)), lambda i: F.rand(3) + i).alias("vector"))
    asked, there = grid(packed(df.where("id < 600"), 225), packed(df, 225))
    assert (asked.count(), there.count()) == (12, 12)
    size = F.sum(F.length("vector_bytes"))
    assert asked.agg(size).first()[0] == 600 * 384 * 8 * 4 and there.agg(size).first()[0] == 900 * 384 * 8 * 3


def test_blocks_are_read_not_shuffled(spark):
    """At 384 dimensions the search shuffles each query once and k short rows per query, no vector of the other side."""
    rnd = np.random.default_rng(0)
    vectors = rnd.normal(size=(900, 384))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    near = knn(df.where("id < 600"), df, 3, few_queries=0, grid_block=100, read_shared=True)
    got = run(near)
    want = ((vectors[:600, None, :] - vectors[None, :, :]) ** 2).sum(axis=2).argsort(axis=1, kind="stable")[:, :3]
    assert got == {i: row.tolist() for i, row in enumerate(want)}
    plan = plans.text(near)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "FlatMapCoGroupsInArrow" not in plan
    assert sum("query_id" in line for line in shuffles) == 1 and sum("block_no" in line for line in shuffles) == 1


@pytest.mark.parametrize("shared", [True, False])
def test_blocks_grow_with_the_table(spark, monkeypatch, shared):
    """However small the least block, there are no more blocks than keep the cores busy: else what moves grows with the square."""
    sizes, pack = [], neighbors._packed_rows
    monkeypatch.setattr(neighbors, "_packed_rows", lambda df, block: sizes.append(block) or pack(df, block))
    rows = points(10, 900, 18)
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = run(knn(df.where("id < 600"), df, 3, few_queries=0, grid_block=4, read_shared=shared))
    assert got == brute(rows[:600], rows, 3)
    cores = spark.sparkContext.defaultParallelism
    assert sizes and all(block >= 600 / (2 * cores + 1) for block in sizes)


def test_cells_answer_for_whole_vectors(spark, tmp_path):
    """The query measures every dimension: here the first twelve are alike."""
    from ledgerwatch.registry import QUERIES, search_queries  # noqa: F401

    rows = [(i, [1.0] * 12 + v) for i, v in points(11, 80, 52)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run(QUERIES["knn_cells"](spark, str(tmp_path))) == brute(rows, rows, 3)


@pytest.mark.parametrize("layout", [{}, SMALL, {"few_queries": 0, "bin_dimensions": 0, "grid_block": 16, "read_shared": False}])
def test_vectors_that_are_no_numbers_are_nobodys_neighbours(spark, layout):
    rows = points(12, 60, 3)
    odd = [(100, [float("nan"), 1.0, 2.0]), (101, [1.0, float("inf"), 0.0])]
    as_df = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>")
    assert run(knn(as_df(rows), as_df(rows + (odd if layout != SMALL else [])), 3, **layout)) == brute(rows, rows, 3)
    assert run(knn(as_df(odd), as_df(rows), 3, **layout)) == {}


def test_scans_measure_only_what_may_be_near(monkeypatch):
    """Few queries against many vectors: once a query has k neighbours, nearly all pairs are left out by one product."""
    rnd = np.random.default_rng(2)
    queries, base = rnd.normal(size=(50, 384)), rnd.normal(size=(6_000, 384))
    measured, near = [], neighbors._maybe_near
    monkeypatch.setattr(neighbors, "_maybe_near", lambda *a: measured.append(near(*a)) or measured[-1])
    best = neighbors._folded(None, np.full(50, np.inf), queries, np.arange(6_000), base, 2, False, finite=True)
    want = neighbors._best(np.arange(50), queries, np.arange(6_000), base, 2, False)
    order = np.lexsort((want[1], want[2], want[0]))
    assert all(np.array_equal(a, b[order]) for a, b in zip(best[:3], want[:3], strict=True))
    assert sum(len(q) for q, _ in measured) < 1_000


def test_single_precision_only_leaves_out_what_is_farther(monkeypatch):
    rnd = np.random.default_rng(1)
    queries = rnd.normal(size=(40, 30)) * 10.0 ** rnd.integers(-3, 20, size=(40, 1))
    base = np.concatenate([queries[:20] * (1 + 1e-9), queries[:20], rnd.normal(size=(100, 30)) * 1e-5, np.full((2, 30), 1e30)])
    ids = rnd.permutation(len(base))
    monkeypatch.setattr(neighbors, "_FOLD_VECTORS", 13)
    monkeypatch.setattr(neighbors, "_FOLD_QUERIES", 7)
    best, far = None, np.full(len(queries), np.inf)
    for part in range(0, len(base), 50):
        best = neighbors._folded(best, far, queries, ids[part : part + 50], base[part : part + 50], 5, False)
    want_place, want_ids, want_distance, _ = neighbors._best(np.arange(40), queries, ids, base, 5, False)
    order = np.lexsort((want_ids, want_distance, want_place))
    assert best[0].tolist() == want_place[order].tolist() and best[1].tolist() == want_ids[order].tolist()
    assert best[2].tolist() == want_distance[order].tolist()


def test_pivots_come_from_a_thinned_table(spark):
    """With many partitions the driver is sent about twice the pivots in all, not that many per partition."""
    rows = points(8, 3000, 2)
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(40)
    got = run(knn(df.where("id < 20"), df, 3, few_queries=0, cells=8, block=64))
    assert got == brute(rows[:20], rows, 3)


def test_dense_cell_of_distinct_vectors(spark):
    """Half the vectors crowd into one cell, so it is dealt over many bins."""
    rnd = random.Random(9)
    base = [(i, [1e-5 * rnd.random(), 1e-5 * rnd.random(), 1e-5 * rnd.random()]) for i in range(150)]
    base += [(150 + i, [rnd.gauss(0, 9) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(base, "id long, vector array<double>")
    assert run(knn(df, df, 4, few_queries=0, cells=6, block=10)) == brute(base, base, 4)


@pytest.mark.parametrize("layout", [{}, SMALL])
def test_fewer_vectors_than_wanted(spark, layout):
    base = spark.createDataFrame(points(3, 2, 4), "id long, vector array<double>")
    assert {len(v) for v in run(knn(base, base, 5, **layout)).values()} == {2}


@pytest.mark.parametrize("layout", [{}, SMALL])
def test_empty_sides(spark, layout):
    some = spark.createDataFrame(points(3, 5, 4), "id long, vector array<double>")
    assert knn(some, some.where("false"), 2, **layout).count() == 0
    assert knn(some.where("false"), some, 2, **layout).count() == 0


@pytest.mark.parametrize("layout", [{}, SMALL])
def test_self_is_left_out_among_copies(spark, layout):
    rows = points(4, 30, 3, copies=15)
    got = run(self_knn(spark.createDataFrame(rows, "id long, vector array<double>"), 4, **layout))
    for q, v in rows:
        assert got[q] == brute([(q, v)], [p for p in rows if p[0] != q], 4)[q]


def test_copies_are_cut_before_the_shuffle(spark):
    from pyspark.sql import Window

    base = spark.createDataFrame(points(5, 10, 2, copies=50), "id long, vector array<double>")
    best = Window.partitionBy("vector").orderBy("id")
    plan = base.withColumn("_copy", F.row_number().over(best)).where("_copy <= 3")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
