"""Exact nearest neighbours by squared Euclidean distance, ties to the smaller id.

Few queries (a checked count) travel to the vectors: each task keeps the best ``k``
per query and ships only those. Many queries of many dimensions are dealt into blocks;
the vectors are packed into blocks of their own in the shared folder, and the task of a
query block reads those one after the other, folding the best ``k``: what shuffles is each
side once and ``k`` rows per query. Single precision products leave out most pairs, the
rest are measured as everywhere else. Where tasks cannot open the shared folder by
themselves, both sides meet in a grid of blocks, each block moved once per block opposite;
blocks grow with the table up to what a task holds, so there are few of them.

In few dimensions the triangle inequality leaves most pairs out, so there queries meet
the vectors by bin:

* copies of a vector beyond the ``k`` smallest ids can never be an answer and are
  left out first, before the shuffle that groups them;
* pivots, sampled by hash, cut space into cells; cells are packed into bins of about
  ``block`` vectors, and a denser cell is dealt over several bins;
* a query first searches the bins of the nearest cells that hold ``k`` vectors, which
  bounds its k-th distance, then every bin with a cell the triangle inequality cannot
  rule out;
* the visitors of a bin are dealt into blocks as well, so a popular bin becomes many tasks.

Pivots, bins and blocks decide only who meets whom; the answers are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.workspace import written

FEW_QUERIES = 8_192
CELLS = 4_096
BLOCK = 2_048
BIN_DIMENSIONS = 16  # above, bins rule nothing out
GRID_BLOCK = 16_384  # vectors in a block of the grid
_TILE_QUERIES, _TILE_VECTORS = 256, 1_024
_FOLD_QUERIES, _FOLD_VECTORS = 1_024, 2_048
_HELD_BYTES = 64 << 20  # of neighbours' vectors that a task keeps for its queries
_BROADCAST_BINS = 1_000_000
_SLACK = 1e-9
_SINGLE, _TINY = 1e17, 1e-30  # lengths whose squares single precision holds, and more than it loses in tiny ones
_NEAR_PIVOTS = 1e-6


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int = 3,
    few_queries: int = FEW_QUERIES,
    cells: int = CELLS,
    block: int = BLOCK,
    with_vector: bool = False,
    few: bool | None = None,
    bin_dimensions: int = BIN_DIMENSIONS,
    grid_block: int = GRID_BLOCK,
    read_shared: bool | None = None,
) -> DataFrame:
    """The ``k`` nearest ``base`` rows of every query.

    Both inputs have columns ``id`` (long) and ``vector`` (array of float or double).
    Returns ``query_id, rank (from 1), id, distance`` with the squared distance, and
    the neighbour's ``vector`` on request. Fewer than ``k`` rows come back only when
    ``base`` has fewer. ``grid_block`` is the least number of vectors in a block; a larger
    table has larger ones, as few as keep all cores busy. ``few`` is the answer of ``is_few`` if the caller has it; ``read_shared``
    says whether tasks can open files of the shared folder (found out by default).
    """
    queries = _doubles(queries)
    base = _doubles(base)
    if is_few(queries, few_queries) if few is None else few:
        found = _scan(queries, base, k, with_vector)
    elif _width(base) > bin_dimensions:
        found = _search_blocks(queries, base, k, grid_block, with_vector, read_shared)
    else:
        found = _search_bins(queries, base, k, cells, block, with_vector)
    columns = ["query_id", "rank", "id", "distance"] + (["vector"] if with_vector else [])
    return _nearest(found, k).select(*columns)


def is_few(queries: DataFrame, few_queries: int = FEW_QUERIES) -> bool:
    return queries.limit(few_queries + 1).count() <= few_queries


def self_knn(points: DataFrame, k: int, **layout) -> DataFrame:
    """The ``k`` nearest other points of every point, with their vectors."""
    near = knn(points, points, k + 1, with_vector=True, **layout).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows per query; each map task drops the others before the shuffle."""
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


_FOUND = "query_id long, id long, distance double, vector array<double>"
_FOUND_ARROW = pa.schema(
    [("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("vector", pa.list_(pa.float64()))]
)


def _scan(queries: DataFrame, base: DataFrame, k: int, with_vector: bool) -> DataFrame:
    rows = queries.orderBy("id").collect()  # at most few_queries rows, checked by knn
    if not rows:
        return base.sparkSession.createDataFrame([], _FOUND)
    ids = np.array([r["id"] for r in rows], dtype="int64")
    matrix = np.array([r["vector"] for r in rows], dtype="float64")

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        far = np.full(len(ids), np.inf)
        for batch in batches:
            if batch.num_rows:
                best = _folded(best, far, matrix, *_rows(batch), k, with_vector, finite=True)
        if best is not None:
            yield _found_batch((ids[best[0]], *best[1:]))

    return base.mapInArrow(best_of_partition, _FOUND)


def _width(base: DataFrame) -> int:
    first = base.select(F.size("vector").alias("width")).first()
    return first["width"] if first else 0


_PACKED = "id_bytes binary, vector_bytes binary, width int"


def packed(df: DataFrame, block: int) -> DataFrame:
    """``block_no`` and one buffer of ids and one of vectors for about ``block`` rows each, written.

    Rows are dealt out by a hash of their id, so blocks have like sizes.
    """
    return _packed_rows(written(df.select("id", "vector"), "vectors"), block)


def _packed_rows(df: DataFrame, block: int) -> DataFrame:
    """``packed`` for rows that are written already."""
    blocks = max(1, -(-df.count() // block))

    def pack(table: pa.Table) -> pa.Table:
        ids = np.ascontiguousarray(table.column("id").to_numpy())
        vectors = _matrix(table.column("vector").combine_chunks())
        return pa.table(
            {
                "block_no": pa.array([table.column("block_no")[0].as_py()], pa.int32()),
                "id_bytes": pa.array([ids.tobytes()], pa.binary()),
                "vector_bytes": pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary()),
                "width": pa.array([vectors.shape[1]], pa.int32()),
            }
        )

    dealt = df.withColumn("block_no", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block_no").applyInArrow(pack, f"block_no int, {_PACKED}"), "blocks")


def grid(rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed queries and vectors, each row once per block of the other side, keyed by ``(row, col)``."""
    row_ids, column_ids = (side.select("block_no").agg(F.collect_list("block_no")).scalar() for side in (rows, columns))
    return (
        rows.withColumnRenamed("block_no", "row").withColumn("col", F.explode(column_ids)),
        columns.withColumnRenamed("block_no", "col").withColumn("row", F.explode(row_ids)),
    )


def _search_blocks(
    queries: DataFrame, base: DataFrame, k: int, block: int, with_vector: bool, read_shared: bool | None
) -> DataFrame:
    queries, base = written(queries, "queries"), written(base, "vectors")
    cores = base.sparkSession.sparkContext.defaultParallelism
    width = max(_width(base), 1)
    asked = queries.count()
    rows, columns = (_block_size(n, isqrt(4 * cores) + 1, block) for n in (asked, base.count()))
    stored = _packed_rows(base, columns)
    files = sorted(stored.inputFiles())
    if with_vector:
        rows = max(256, min(rows, _HELD_BYTES // (8 * k * width)))
    if not files or (not _opens(files[0]) if read_shared is None else not read_shared):
        return _search_grid(queries, stored, k, rows, with_vector)
    held = min(rows, _block_size(asked, 2 * cores, block))
    blocks = max(1, -(-asked // held))

    def search(table: pa.Table) -> pa.Table:
        ids = np.ascontiguousarray(table.column("id").to_numpy())
        vectors = _matrix(table.column("vector").combine_chunks())
        best, far = None, np.full(len(ids), np.inf)
        for base_ids, there in _stored_blocks(files):
            best = _folded(best, far, vectors, base_ids, there, k, with_vector)
        if best is None:
            return _FOUND_ARROW.empty_table()
        return pa.Table.from_batches([_found_batch((ids[best[0]], *best[1:]))])

    dealt = queries.withColumn("block_no", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block_no").applyInArrow(search, _FOUND)


def _block_size(n: int, blocks: int, least: int) -> int:
    """Rows in a block when ``n`` are cut into ``blocks``, or into more where a task cannot hold so many."""
    return max(least, min(GRID_BLOCK, -(-n // blocks)))


def _opens(uri: str) -> bool:
    """Whether Arrow has a file system for a path."""
    try:
        filesystem, path = pa.fs.FileSystem.from_uri(uri)
        return filesystem.get_file_info(path).is_file
    except (pa.ArrowException, OSError):
        return False


def _stored_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each block that ``packed`` wrote, one in memory at a time."""
    for uri in files:
        filesystem, path = pa.fs.FileSystem.from_uri(uri)
        with filesystem.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["id_bytes", "vector_bytes", "width"]):
                yield _unpacked(batch)


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(table.column("id_bytes")[0].as_py(), dtype="int64")
    vectors = np.frombuffer(table.column("vector_bytes")[0].as_py(), dtype="float64")
    return ids, vectors.reshape(len(ids), table.column("width")[0].as_py())


def _folded(best, far, queries, base_ids, vectors, k, with_vector, finite=False):
    """``best`` (place of the query, id, distance, vector or nothing) with what another block of vectors has nearer.

    ``far`` holds each query's ``k``-th distance so far and is brought up to date. Queries go by place,
    since several may carry one id. ``finite``: distances that are infinite or no number count for nothing.
    """
    width = queries.shape[1]
    sizes = np.einsum("ij,ij->i", queries, queries)
    for j in range(0, len(base_ids), _FOLD_VECTORS):
        there = vectors[j : j + _FOLD_VECTORS]
        there_size = np.einsum("ij,ij->i", there, there)
        found = [best]
        for i in range(0, len(queries), _FOLD_QUERIES):
            asked, size = queries[i : i + _FOLD_QUERIES], sizes[i : i + _FOLD_QUERIES]
            q, b = _maybe_near(asked, size, there, there_size, far[i : i + _FOLD_QUERIES], k)
            distance = np.zeros(len(q))
            for d in range(width):  # as _distances sums
                gap = asked[q, d] - there[b, d]
                distance += gap * gap
            if finite and not np.isfinite(distance).all():
                real = np.isfinite(distance)
                q, b, distance = q[real], b[real], distance[real]
            found.append((q + i, base_ids[j + b], distance, (there if with_vector else there[:, :0])[b]))
        new = [np.concatenate([x[c] for x in found[1:]]) for c in range(4)]
        best = _merged(best, new, k) if best is not None else _merged(new, [x[:0] for x in new], k)
        full = np.bincount(best[0], minlength=len(far)) >= k
        worst = np.zeros(len(far))
        np.maximum.at(worst, best[0], best[2])
        far[full] = worst[full]
    return best


def _maybe_near(asked, size, there, there_size, limit, k):
    """(query, vector) places of all pairs that may be among the ``k`` nearest, or nearer than ``limit``."""
    width = asked.shape[1]
    norm, there_norm = np.sqrt(size), np.sqrt(there_size.max())
    if np.isfinite(limit).all() and norm.max() < _SINGLE and there_norm < _SINGLE:
        # half of (squared distance less the query's square) with its sign turned, as one product
        left = np.column_stack([asked, np.ones(len(asked))]).astype("float32")
        right = np.column_stack([there, -there_size / 2]).astype("float32")
        half = left @ right.T
        # more than such a product, and double sums, can be off
        off = (width + 16) * 2.0**-22 * there_norm * (norm + there_norm) + 2.0**-46 * (size + limit) + _TINY
        least = np.nextafter(((size - limit) / 2 - off).astype("float32"), np.float32(-np.inf))
        return np.nonzero(half >= least[:, None])
    size = size[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        near = size + there_size - 2.0 * (asked.astype("float32") @ there.astype("float32").T)
        # more than single precision products of that many numbers, and double sums, can be off
        off = (width + 8) * 2.0**-22 * np.sqrt(size * there_size) + 2.0**-48 * (size + there_size)
        low, high = near - off, near + off
    beyond = ~np.isfinite(near)  # single precision cannot say: measured below
    low[beyond], high[beyond] = -np.inf, np.inf
    if high.shape[1] >= k:
        limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
    return np.nonzero(low <= limit[:, None])


def _search_grid(queries: DataFrame, stored: DataFrame, k: int, block: int, with_vector: bool) -> DataFrame:
    rows, columns = grid(_packed_rows(queries, block), stored)

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return _FOUND_ARROW.empty_table()
        ids, vectors = _unpacked(asked)
        best = _folded(None, np.full(len(ids), np.inf), vectors, *_unpacked(there), k, with_vector, finite=True)
        return pa.Table.from_batches([_found_batch((ids[best[0]], *best[1:]))])

    keys = ["row", "col"]
    return rows.groupBy(*keys).cogroup(columns.groupBy(*keys)).applyInArrow(search, _FOUND)


def _search_bins(
    queries: DataFrame, base: DataFrame, k: int, cells: int, block: int, with_vector: bool
) -> DataFrame:
    spark = base.sparkSession
    copies = Window.partitionBy("vector").orderBy("id")
    base = written(
        base.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"), "vectors"
    )
    if _width(base) > BIN_DIMENSIONS:  # most queries visit most bins, so there should be few
        block = _block_size(base.count(), isqrt(4 * spark.sparkContext.defaultParallelism) + 1, block)
    wanted = min(cells, 2 * isqrt(base.count()) + 1)
    # the pivots: at most `cells` rows. A threshold on the hash first, so that tasks send about twice as many in all
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    thinned = base.where(place < F.lit(min(1.0, (2 * wanted + 64) / max(base.count(), 1))) * (1 << 30))
    sample = thinned.orderBy(place, "id").limit(wanted).collect()
    if not sample:
        return spark.createDataFrame([], _FOUND)
    pivots = _in_line(np.array([r["vector"] for r in sample], dtype="float64"))

    in_cells = written(base.mapInArrow(_assign(pivots), "id long, vector array<double>, cell int, reach double"), "cells")
    sizes, reach = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
    for r in in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect():
        sizes[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    first_bin, bins = _pack(sizes, block)
    layout = (pivots, sizes, reach, first_bin, bins)
    n_bins = int((first_bin + bins).max())
    # one row per cell, so at most `cells` rows
    places = F.broadcast(
        spark.createDataFrame(
            [(i, int(first_bin[i]), int(bins[i])) for i in range(len(pivots)) if sizes[i]],
            "cell int, first_bin int, bins int",
        )
    )
    in_bins = in_cells.join(places, "cell").select(
        (F.col("first_bin") + F.pmod(F.xxhash64("id"), F.col("bins"))).cast("int").alias("bin"), "id", "vector"
    )

    visit_schema = "query_id long, query array<double>, bin int"
    first = queries.mapInArrow(_visits(layout, k, bounded=False), visit_schema)
    meeting = {"k": k, "block": block, "n_bins": n_bins, "with_vector": with_vector}
    near = written(_nearest(_meet(first, in_bins, **meeting), k).drop("rank"), "near")
    bound = near.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("bound"))
    rest = queries.join(bound, "id").mapInArrow(_visits(layout, k, bounded=True), visit_schema)
    return near.unionByName(_meet(rest, in_bins, **meeting))


def _in_line(pivots: np.ndarray) -> np.ndarray:
    """Pivots ordered along their widest direction, so that near ones share bins."""
    centred = pivots - pivots.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.ones(pivots.shape[1])
    return pivots[np.argsort(centred @ axis, kind="stable")]


def _pack(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins per cell: small neighbours share one, large cells have several."""
    first, bins = np.zeros(len(sizes), dtype="int64"), np.ones(len(sizes), dtype="int64")
    current, held = 0, 0
    for i, n in enumerate(sizes):
        bins[i] = max(1, -(-int(n) // block))
        if held and (held + n > block):
            current, held = current + 1, 0
        first[i] = current
        if bins[i] > 1:
            current, held = current + int(bins[i]), 0
        else:
            held += int(n)
    return first, bins


def _assign(pivots):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in _tiles(batch):
                d2 = _distances(vectors, pivots)
                cell = d2.argmin(axis=1)
                reach = np.sqrt(d2[np.arange(len(ids)), cell])
                yield pa.record_batch(
                    [pa.array(ids), _lists(vectors), pa.array(cell.astype("int32")), pa.array(reach)],
                    names=["id", "vector", "cell", "reach"],
                )

    return assign


def _visits(layout, k, bounded):
    """The bins each query must search: those of the nearest cells holding ``k`` vectors, or, once
    its k-th distance is bounded, the others with a cell that may hold something as near."""
    pivots, sizes, reach, first_bin, bins = layout  # per cell, in pivot order
    # cells that share their first bin form one group, visited as a whole
    group_starts = np.flatnonzero(np.r_[True, first_bin[1:] != first_bin[:-1]])
    group_bins = [
        np.arange(first_bin[s], first_bin[s] + bins[s : e].max())
        for s, e in zip(group_starts, [*group_starts[1:], len(sizes)], strict=True)
    ]

    def groups(cells):
        return np.logical_or.reduceat(cells, group_starts, axis=1)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column("bound").to_numpy(zero_copy_only=False) if bounded else None
            start = 0
            for ids, vectors in _tiles(batch):
                d = np.sqrt(_distances(vectors, pivots))
                order = np.where(sizes > 0, d, np.inf).argsort(axis=1, kind="stable")
                ahead = sizes[order].cumsum(axis=1) - sizes[order]
                nearest = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(nearest, order, ahead < k, axis=1)
                wanted = groups(nearest & (sizes > 0))
                if bounded:
                    radius = np.sqrt(bounds[start : start + len(ids)])[:, None]
                    own = d.argmin(axis=1)
                    between = np.sqrt(_distances(pivots[own], pivots))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d**2 - d[np.arange(len(ids)), own][:, None] ** 2) / (2 * between)
                    plane = np.where(between > _NEAR_PIVOTS * (1 + d), plane, 0)
                    floor = np.maximum(d - reach, plane)
                    open_cells = (sizes > 0) & (floor <= radius + _SLACK * (1 + d + radius + reach))
                    wanted = ~wanted & groups(open_cells)
                start += len(ids)
                query, group = wanted.nonzero()
                if len(query):
                    counts = np.array([len(group_bins[g]) for g in group])
                    query = np.repeat(query, counts)
                    bin_ids = np.concatenate([group_bins[g] for g in group]).astype("int32")
                    yield pa.record_batch(
                        [pa.array(ids[query]), _lists(vectors[query]), pa.array(bin_ids)],
                        names=["query_id", "query", "bin"],
                    )

    return visits


def _meet(visits: DataFrame, in_bins: DataFrame, k: int, block: int, n_bins: int, with_vector: bool) -> DataFrame:
    """Search every visited bin, block by block, keeping the best ``k`` per block."""
    visits = written(visits, "visits")
    callers = visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    if n_bins <= _BROADCAST_BINS:  # two integers per bin
        callers = F.broadcast(callers)
    vectors = in_bins.join(callers, "bin").select(
        "bin", F.explode(F.expr("sequence(0, blocks - 1)")).alias("query_block"), "id", "vector"
    )
    asked = visits.join(callers, "bin").select(
        "bin", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("query_block"), "query_id", "query"
    )

    def search(queries: pa.Table, base: pa.Table) -> pa.Table:
        if not queries.num_rows or not base.num_rows:
            return _FOUND_ARROW.empty_table()
        ids = queries.column("query_id").to_numpy()
        matrix = _matrix(queries.column("query").combine_chunks())
        base_ids = base.column("id").to_numpy()
        vectors = _matrix(base.column("vector").combine_chunks())
        best = _folded(None, np.full(len(ids), np.inf), matrix, base_ids, vectors, k, with_vector, finite=True)
        return pa.Table.from_batches([_found_batch((ids[best[0]], *best[1:]))])

    keys = ["bin", "query_block"]
    return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(search, _FOUND)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype="int32") * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), _matrix(batch.column("vector"))


def _tiles(batch: pa.RecordBatch):
    """(ids, vectors) pieces whose distances to the pivots fit the cache."""
    if batch.num_rows:
        ids, vectors = _rows(batch)
        for i in range(0, len(ids), _TILE_QUERIES):
            yield ids[i : i + _TILE_QUERIES], vectors[i : i + _TILE_QUERIES]


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances, summed one dimension after the other so that they repeat exactly."""
    total = np.zeros((len(left), len(right)))
    gap = np.empty_like(total)
    for j in range(left.shape[1]):
        np.subtract(left[:, j, None], right[None, :, j], out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return total


def _best(query_ids, queries, base_ids, vectors, k, with_vector):
    """(query id, id, distance, vector or nothing) of the ``k`` nearest vectors of every query.

    Vectors go in id order, so keeping the earlier of two equal distances keeps the smaller id.
    """
    order = np.argsort(base_ids, kind="stable")
    base_ids, vectors = base_ids[order], vectors[order]
    found = []
    for i in range(0, len(query_ids), _TILE_QUERIES):
        tile = queries[i : i + _TILE_QUERIES]
        distance, place = np.full((len(tile), k), np.inf), np.full((len(tile), k), -1)
        for j in range(0, len(base_ids), _TILE_VECTORS):
            d2 = _distances(tile, vectors[j : j + _TILE_VECTORS])
            places = np.broadcast_to(np.arange(j, j + d2.shape[1]), d2.shape)
            d2, places = np.hstack([distance, d2]), np.hstack([place, places])
            last = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            kept = d2 <= last
            if (kept.sum(axis=1) > k).any():
                closer, tied = d2 < last, d2 == last
                kept = closer | (tied & (tied.cumsum(axis=1) <= k - closer.sum(axis=1, keepdims=True)))
            distance, place = d2[kept].reshape(-1, k), places[kept].reshape(-1, k)
        real = place >= 0
        found.append((np.repeat(query_ids[i : i + _TILE_QUERIES], real.sum(axis=1)), place[real], distance[real]))
    ids, place, distance = (np.concatenate(part) for part in zip(*found, strict=True))
    return ids, base_ids[place], distance, (vectors if with_vector else vectors[:, :0])[place]


def _merged(left, right, k):
    """The best ``k`` per query of two results."""
    ids, base_ids, distance, vectors = (np.concatenate(pair) for pair in zip(left, right, strict=True))
    order = np.lexsort((base_ids, distance, ids))
    sorted_ids = ids[order]
    count = np.arange(len(order))
    starts = np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]
    order = order[count - np.maximum.accumulate(np.where(starts, count, 0)) < k]
    return ids[order], base_ids[order], distance[order], vectors[order]


def _found_batch(best) -> pa.RecordBatch:
    query_ids, ids, distance, vectors = best
    return pa.record_batch(
        [pa.array(query_ids), pa.array(ids), pa.array(distance), _lists(vectors)], schema=_FOUND_ARROW
    )
