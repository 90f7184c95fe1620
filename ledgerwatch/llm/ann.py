"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard.

Different vectors are dealt into shards by a hash. A shard's graph starts at random; every vector in turn
searches the graph greedily, and of what it finds keeps the neighbours that no nearer kept one covers
within ``ALPHA`` times its own distance. Neighbours point back and are pruned the same way. Queries go
through every shard with a beam search, many at a time, and the best of all shards are kept: the task of a
block of queries reads the graphs from the shared folder one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import seeded
from ledgerwatch.workspace import written

SHARD = 8_192  # vectors in a shard, about
DEGREE = 32
BEAM = 64
ALPHA = 1.2
BATCH = 256  # vectors that search at once
QUERIES = 1_024  # queries in a block, about
PAIR_TASKS = 4_096  # at most, for blocks that meet graphs by a join


def beam_search(points: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances (1 - cosine) of the ``beam`` nearest found per query; -1 where there are fewer."""
    many = len(queries)
    ids = np.full((many, beam), -1, dtype=np.int64)
    far = np.full((many, beam), np.inf)
    done = np.ones((many, beam), dtype=bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, 1 - queries @ points[start], False
    rows = np.arange(many)
    while len(rows):
        open_far = np.where(done[rows], np.inf, far[rows])
        place = open_far.argmin(axis=1)
        going = np.isfinite(open_far[np.arange(len(rows)), place])
        rows, place = rows[going], place[going]
        if not len(rows):
            break
        done[rows, place] = True
        found = links[ids[rows, place]]
        known = (found[:, :, None] == ids[rows][:, None, :]).any(axis=2) | (found < 0)
        away = 1 - np.einsum("qnd,qd->qn", points[np.maximum(found, 0)], queries[rows], optimize=True)
        away[known] = np.inf
        all_far = np.concatenate([far[rows], away], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(known, -1, found)], axis=1)
        all_done = np.concatenate([done[rows], known], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[rows] = np.take_along_axis(all_far, best, axis=1)
        ids[rows] = np.take_along_axis(all_ids, best, axis=1)
        done[rows] = np.take_along_axis(all_done, best, axis=1)
    return ids, far


def robust_prune(points: np.ndarray, which: np.ndarray, found: np.ndarray, away: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours per vector, of candidates ``found`` (-1: none) at distances ``away``."""
    away = np.where((found < 0) | (found == which[:, None]), np.inf, away)
    order = np.argsort(away, axis=1, kind="stable")
    found, away = np.take_along_axis(found, order, axis=1), np.take_along_axis(away, order, axis=1)
    again = found[:, 1:] == found[:, :-1]  # equal candidates are equally far, so neighbours
    away[:, 1:][again] = np.inf
    near = points[np.maximum(found, 0)]
    between = 1 - near @ near.transpose(0, 2, 1)
    alive = np.isfinite(away)
    out = np.full((len(which), degree), -1, dtype=np.int64)
    kept = np.zeros(len(which), dtype=np.int64)
    for i in range(found.shape[1]):
        take = np.flatnonzero(alive[:, i] & (kept < degree))
        if not len(take):
            continue
        out[take, kept[take]] = found[take, i]
        kept[take] += 1
        alive[take] &= alpha * between[take, i] > away[take]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """Links [vector, degree] (-1: none) and the vector where searches start; points have length 1."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int((points @ points.mean(axis=0)).argmax()) if n else 0
    links = np.full((n, degree), -1, dtype=np.int64)
    if n > 1:
        few = min(degree // 2, n - 1)
        links[:, :few] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, size=(n, few))) % n
    for sweep in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            which = order[i : i + BATCH]
            found, away = beam_search(points, links, start, points[which], beam)
            old = links[which]
            old_away = 1 - np.einsum("qnd,qd->qn", points[np.maximum(old, 0)], points[which], optimize=True)
            links[which] = robust_prune(points, which, np.concatenate([found, old], axis=1), np.concatenate([away, old_away], axis=1), degree, sweep)
            _point_back(points, links, which, degree, sweep)
    return links, start


def _point_back(points: np.ndarray, links: np.ndarray, which: np.ndarray, degree: int, alpha: float) -> None:
    """Add the links towards ``which`` from their new neighbours; full vectors are pruned."""
    to = links[which]
    source = np.repeat(which, (to >= 0).sum(axis=1))
    target = to[to >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads, first, many = np.unique(target, return_index=True, return_counts=True)
    if not len(heads):
        return
    width = degree + int(many.max())
    pool = np.full((len(heads), width), -1, dtype=np.int64)
    pool[:, :degree] = links[heads]
    pool[np.repeat(np.arange(len(heads)), many), degree + np.arange(len(target)) - np.repeat(first, many)] = source
    for i in range(0, len(heads), BATCH):
        own, some = heads[i : i + BATCH], pool[i : i + BATCH]
        away = 1 - np.einsum("qnd,qd->qn", points[np.maximum(some, 0)], points[own], optimize=True)
        links[own] = _merge(points, own, some, away, degree, alpha)


def _merge(points: np.ndarray, own: np.ndarray, some: np.ndarray, away: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The candidates themselves where they fit, else pruned."""
    ranked = np.sort(some, axis=1)[:, ::-1].copy()
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    fits = (ranked >= 0).sum(axis=1) <= degree
    out = np.full((len(own), degree), -1, dtype=np.int64)
    out[fits] = -np.sort(-ranked[fits], axis=1)[:, :degree]
    over = np.flatnonzero(~fits)
    if len(over):
        near = np.argsort(away[over], axis=1, kind="stable")[:, : max(2 * degree, 96)]
        out[over] = robust_prune(
            points, own[over], np.take_along_axis(some[over], near, axis=1), np.take_along_axis(away[over], near, axis=1), degree, alpha
        )
    return out


def _matrix(vectors: pd.Series | list) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    made = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, all components there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    shard: int = SHARD,
    beam: int = BEAM,
    read_shared: bool | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found per query row, its own row left out.

    Score is the cosine in double precision of the vectors as given; ties go to the smaller key. Vectors that
    are null, zero, empty or hold null or non-finite components take no part, nor do rows without a key;
    vectors of another length than the query's are no candidates. Equal vectors are one node that carries
    its ``k + 1`` least rows, so copies cannot fill a graph. Equal rows (key and vector) are rows of
    their own: a query's own row is left out once; equal query rows give the same result and count as one
    query. Other columns are ignored. ``read_shared`` says whether tasks can open the shared folder, where that
    is known; where they cannot, graphs travel to the blocks of queries.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")
    )
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    each = written(rows.groupBy("v", "vec_id", "asks").agg(F.count("*").alias("n")), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = (
        each.withColumn("nth", nth).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("rows"))
    )
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = F.create_map(*[F.lit(x) for d, n in sorted(sizes.items()) for x in (d, max(1, math.ceil(n / shard)))])
    dealt = nodes.select(
        F.size("v").alias("d"), F.pmod(seeded(1, F.col("v")), counts[F.size("v")]).cast("int").alias("shard"), "v", "rows"
    )

    def built(group: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(group.v)
        links, start = build_graph(_unit(points), beam=beam)
        return pd.DataFrame(
            {
                "d": [group.d.iloc[0]], "shard": [group.shard.iloc[0]], "start": [start],
                "points": [points.tobytes()],
                "links": [links.astype(np.int32).tobytes()],
                "row_ids": [[r["vec_id"] for own in group["rows"] for r in own]],
                "row_counts": [[r["n"] for own in group["rows"] for r in own]],
                "row_ends": [np.cumsum([len(own) for own in group["rows"]])],
            }
        )

    form = "d int, shard int, start int, points binary, links binary, row_ids array<long>, row_counts array<long>, row_ends array<long>"
    graphs = written(dealt.groupBy("d", "shard").applyInPandas(built, form), "graphs")
    asked = written(each.where("asks").select("vec_id", "v"), "asked")
    many = asked.count()
    files = sorted(graphs.inputFiles())
    if not (_opens(files[0]) if read_shared is None else read_shared):
        return _met(asked, graphs, counts, math.ceil(many / QUERIES), sum(math.ceil(n / shard) for n in sizes.values()), k, beam)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        block = pd.concat(parts, ignore_index=True)
        for _, own in block.groupby(block.v.map(len)):
            ids, own = own.vec_id.to_numpy(dtype=np.int64), _matrix(own.v)
            best = None
            for graph in _stored(files, own.shape[1]):
                best = _best(best, _answers(graph, ids, own, k, beam), k)
            if best is not None:
                at, vec_id, score, copies = (np.repeat(x, best[3]) for x in best)
                rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
                yield pd.DataFrame({"query_id": ids[at], "rank": rank, "vec_id": vec_id, "score": score})

    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(many / QUERIES), min(4 * cores, math.ceil(many / BATCH)))
    return asked.repartition(blocks, "vec_id", "v").mapInPandas(searched, "query_id long, rank int, vec_id long, score double")


def _met(asked: DataFrame, graphs: DataFrame, counts: Column, blocks: int, shards: int, k: int, beam: int) -> DataFrame:
    """The same where tasks cannot open the shared folder: every block of queries is joined with every graph."""
    sized = asked.select(F.size("v").alias("d"), "vec_id", "v")
    packed = (
        sized.groupBy("d", F.pmod(seeded(2, F.col("vec_id"), F.col("v")), F.lit(max(1, blocks))).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), counts[F.col("d")] - 1)))
    )
    pairs = packed.join(graphs, ["d", "shard"])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids, own = np.array([q["vec_id"] for q in b.asked], dtype=np.int64), _matrix([q["v"] for q in b.asked])
                at, vec_id, score, copies = _best(None, _answers(b, ids, own, k, beam), k)
                by = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in own], dtype=np.int64)
                yield pd.DataFrame({"query_id": ids[at], "asked_by": by[at], "vec_id": vec_id, "score": score, "copies": copies})

    pairs = pairs.repartition(min(max(blocks * shards, 1), PAIR_TASKS), "d", "shard", "block")
    found = pairs.mapInPandas(searched, "query_id long, asked_by long, vec_id long, score double, copies int")
    least = Window.partitionBy("query_id", "asked_by").orderBy(F.desc("score"), "vec_id")
    ranked = (
        found.select("query_id", "asked_by", "vec_id", "score", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k)
    )
    return ranked.select("query_id", "rank", "vec_id", "score")


def _opens(uri: str) -> bool:
    """Whether Arrow has a file system for a path."""
    try:
        filesystem, path = pa.fs.FileSystem.from_uri(uri)
        return filesystem.get_file_info(path).is_file
    except (pa.ArrowException, OSError):
        return False


def _stored(files: list[str], d: int) -> Iterator[pd.Series]:
    """The graphs of vectors of length ``d``, one in memory at a time."""
    for uri in files:
        filesystem, path = pa.fs.FileSystem.from_uri(uri)
        with filesystem.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                if batch.num_rows and batch.column("d")[0].as_py() == d:
                    yield batch.to_pandas().iloc[0]


Answers = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # place of the query, key found, score, how often


def _answers(graph, ids: np.ndarray, own: np.ndarray, k: int, beam: int) -> Answers:
    """What the queries ``own`` with the keys ``ids`` find in a graph."""
    raw = np.frombuffer(graph.points, dtype=np.float64).reshape(-1, graph.d)
    points = _unit(raw)
    links = np.frombuffer(graph.links, dtype=np.int32).reshape(len(points), -1).astype(np.int64)
    out = []
    for i in range(0, len(own), BATCH):
        some = own[i : i + BATCH]
        nodes, far = beam_search(points, links, graph.start, _unit(some), max(beam, 2 * k + 2))
        order = np.argsort(far, axis=1, kind="stable")[:, : 2 * k + 2]
        for j, query in enumerate(some):
            found = nodes[j][order[j]]
            found = found[found >= 0]
            scores = cosines(query, raw[found])
            for node, score in zip(found, scores, strict=True):
                same = np.array_equal(raw[node], query)
                for at in range(graph.row_ends[node - 1] if node else 0, graph.row_ends[node]):
                    vec_id = int(graph.row_ids[at])
                    copies = min(int(graph.row_counts[at]) - (same and vec_id == ids[i + j]), k)
                    if copies > 0:
                        out.append((i + j, vec_id, float(score), copies))
    at, vec_id, score, copies = zip(*out) if out else ((),) * 4
    return np.array(at, dtype=np.int64), np.array(vec_id, dtype=np.int64), np.array(score, dtype=np.float64), np.array(copies, dtype=np.int64)


def _best(best: Answers | None, more: Answers, k: int) -> Answers:
    """The ``k`` best per query of both, copies counted, in the order of rank; ties go to the smaller key."""
    at, vec_id, score, copies = more if best is None else (np.concatenate(x) for x in zip(best, more, strict=True))
    order = np.lexsort([vec_id, -score, at])
    at, vec_id, score, copies = at[order], vec_id[order], score[order], copies[order]
    before = np.cumsum(copies) - copies
    before -= before[np.searchsorted(at, at)]
    kept = before < k
    return at[kept], vec_id[kept], score[kept], np.minimum(copies, k - before)[kept]


def cosines(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    return candidates @ query / (np.linalg.norm(candidates, axis=1) * np.linalg.norm(query))
