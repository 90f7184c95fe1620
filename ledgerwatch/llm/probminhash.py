"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is its runs of five words, each weighing as often as it occurs. Every run has a Poisson process whose rate
is its weight; each arrival falls into one of ``REGISTERS`` registers, which keeps the run that arrived first.
Processes stop once the next arrival is later than the latest register. Two texts agree in a register with
their probability Jaccard. Texts that agree in a band of registers are candidates, checked on all their runs.

Equal texts are one text from the start. Within a bucket a few leaders are compared with the members of other
components; links merge components, and buckets within one component are done. What is left after
``ROUNDS`` rounds is compared block by block: members in one block, those outside the bucket's largest
component in another, each pair in the first bucket it shares, and only links leave a task. So every pair
of different components that shares a bucket is compared, and no group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import joined_small, mixed, shingle_hashes, small_batches, word_hashes
from ledgerwatch.llm.components import components
from ledgerwatch.workspace import written

WIDTH = 5
LEAST = 0.8
BANDS = 30
ROWS = 6
REGISTERS = BANDS * ROWS
ROUNDS = 2
GROWTH = 8  # of the leaders of a bucket, and of the pairs of a text, from round to round
MEMBERS, LEADERS = 128, 64  # texts in a block
DEVIATIONS = 4.0  # of the agreement in registers, below which a pair is not checked

_U = np.uint64


def weighted_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of five words, ascending, and how often each occurs."""
    return np.unique(shingle_hashes(words, WIDTH), return_counts=True)


def signature(runs: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The run that arrives first in each register."""
    first = np.full(registers, np.inf)
    holder = np.zeros(registers, dtype=np.uint64)
    at = np.zeros(len(runs))
    rate = weights.astype(float)
    step, done = max(1, -(-8 * registers // max(len(runs), 1))), 0
    while len(runs):
        # arrivals done to done + step of each process
        nth = np.arange(done, done + step, dtype=np.uint64)
        draw = mixed(runs[:, None] + (nth + _U(1)) * _U(0x9E3779B97F4A7C15))
        gaps = -np.log(((draw >> _U(11)).astype(float) + 0.5) / 2.0**53) / rate[:, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        places = (mixed(draw ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(registers)).astype(np.int64)
        alive = times < first.max()
        t, k = times[alive], places[alive]
        who = np.broadcast_to(runs[:, None], times.shape)[alive]
        before = first[k]
        np.minimum.at(first, k, t)
        better = (t == first[k]) & (t < before)
        holder[k[better]] = who[better]
        at = times[:, -1]
        going = at < first.max()
        runs, rate, at, done = runs[going], rate[going], at[going], done + step
        step = 1 if len(runs) > registers else max(1, registers // max(len(runs), 1))
    return holder


def band_hashes(holder: np.ndarray) -> np.ndarray:
    rows = holder.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * _U(0xD6E8FEB86659FD93) + rows[:, i])
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Of ascending runs ``a`` and ``b`` with weights ``m`` and ``n``."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    m, n = m.astype(float), n.astype(float)
    only_a, only_b = m.sum() - m[i].sum(), n.sum() - n[j].sum()
    total = 0.0
    ratios, counts = np.unique(m[i] / n[j], return_inverse=True)
    for at, ratio in enumerate(ratios):
        above = only_a + ratio * only_b + np.maximum(m[i], ratio * n[j]).sum()
        total += m[i][counts == at].sum() / above
    return float(total)


def marks_of(holder: np.ndarray) -> bytes:
    """Sixteen bits of each register, for a quick estimate."""
    return holder.astype(np.uint16).tobytes()


def _digest(words: np.ndarray, text: str) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"\0" + text.encode("utf-8", "replace"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text hash, digest of the words, bands) per text; texts without words have no bands."""
    for batch in batches:
        digests, known = [], {}
        for text in batch.text:
            words = word_hashes(text)
            digest = _digest(words, text)
            if digest not in known:
                holder = signature(*weighted_shingles(words)) if len(words) else np.empty(0, dtype=np.uint64)
                known[digest] = (band_hashes(holder) if len(words) else holder.view(np.int64), marks_of(holder))
            digests.append(digest)
        yield pd.DataFrame(
            {
                "doc_id": batch.doc_id, "mark": batch.mark, "digest": digests, "bands": [known[d][0] for d in digests],
                "packed": [known[d][0].tobytes() for d in digests], "registers": [known[d][1] for d in digests],
            }
        )


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, runs, weights) of the wanted texts, once per batch."""
    for batch in batches:
        out: dict[int, tuple] = {}
        for ident, digest, text in zip(batch.id, batch.digest, batch.text, strict=True):
            if ident not in out:
                words = word_hashes(text)
                if _digest(words, text) == bytes(digest):
                    runs, weights = weighted_shingles(words)
                    out[ident] = (ident, runs.tobytes(), weights.astype(np.int32).tobytes())
        yield pd.DataFrame(list(out.values()), columns=["id", "runs", "weights"])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(least: float):
    low = least - DEVIATIONS * (least * (1 - least) / REGISTERS) ** 0.5

    def unpack(block: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(block.column(name).to_pylist()), dtype=kind).reshape(block.num_rows, -1)

    def weighted(block: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(block.column(c)[i].as_buffer(), dtype=t) for c, t in (("runs", np.uint64), ("weights", np.int32)))

    def compare(members: pa.Table, leaders: pa.Table) -> pa.Table:
        """Links between a block of members and one of leaders of the same bucket; most blocks are a few rows."""
        out = set()
        if members.num_rows and leaders.num_rows:
            (marks, led_marks), (bands, led_bands) = (
                (unpack(members, c, t), unpack(leaders, c, t)) for c, t in (("registers", np.uint16), ("bands", np.int64))
            )
            roots, led_roots = members.column("root").to_numpy(), leaders.column("root").to_numpy()
            band = members.column("band")[0].as_py()
            for j in range(leaders.num_rows):
                mine = np.flatnonzero((roots != led_roots[j]) & ((bands == led_bands[j]).argmax(axis=1) == band))
                mine = mine[(marks[mine] == led_marks[j]).mean(axis=1) >= low]
                mine = [i for i in mine.tolist() if (led_roots[j], roots[i]) not in out]
                leader = weighted(leaders, j) if mine else None
                for i in mine:
                    if probability_jaccard(*leader, *weighted(members, i)) >= least:
                        out.add((led_roots[j], roots[i]))
        return pa.table([[a for a, _ in out], [b for _, b in out]], schema=_LINKS)

    return compare


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [
            probability_jaccard(*(np.frombuffer(x, dtype=t) for x, t in ((a, np.uint64), (m, np.int32), (b, np.uint64), (n, np.int32))))
            for a, m, b, n in zip(batch.runs_a, batch.weights_a, batch.runs_b, batch.weights_b, strict=True)
        ]
        yield pd.DataFrame({"a": batch.a, "b": batch.b, "ca": batch.ca, "cb": batch.cb, "near": near})


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, mark, digest, class): one row per row with a text; ``mark`` is the hash of the text.

    ``class`` is the same number for rows whose texts are linked, directly or by others, by a probability Jaccard of
    ``least`` or more over runs of five words (shorter texts are one run). Texts with the same words are equal;
    those without words only if they are the same. Rows with a null text are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")
    )
    read = written(rows.mapInPandas(_read, "doc_id long, mark long, digest binary, bands array<long>, packed binary, registers binary"), "near_rows")
    texts = written(
        read.groupBy("digest")
        .agg(F.min("mark").alias("mark"), *[F.any_value(c).alias(c) for c in ("bands", "packed", "registers")])
        .withColumn("id", F.monotonically_increasing_id()),
        "near_texts",
    )
    members = texts.select("id", F.posexplode("bands").alias("band", "hash"))
    members = members.select("id", "band", F.xxhash64("hash", "band").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = written(members.join(shared, "bucket"), "near_buckets")
    roots = _linked(rows, texts, buckets, least)
    named = texts.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class"))
    return read.select("doc_id", "mark", "digest").join(named, "digest")


def _linked(rows: DataFrame, texts: DataFrame, buckets: DataFrame, least: float) -> DataFrame:
    """(id, root) of the texts that share a bucket."""
    ids = buckets.select("id").distinct()
    wanted = texts.join(ids, "id").select("id", "digest", "mark")
    arrays = joined_small(rows.select("mark", "text"), wanted, "mark").select("id", "digest", "text")
    shingled = arrays.mapInPandas(_shingles, "id long, runs binary, weights binary")
    shingled = written(shingled.dropDuplicates(["id"]), "near_shingles")
    roots = written(ids.select("id", F.col("id").alias("root")), "near_roots")
    active, tested, leaders = buckets, None, 1
    for _ in range(ROUNDS):
        placed = _active(active, roots)
        if placed.limit(1).count() == 0:
            return roots
        lead = Window.partitionBy("bucket").orderBy(F.xxhash64("id"), "id")
        heads = placed.where(F.lit(leaders == 1) | (F.col("root") != F.col("main")))
        heads = heads.withColumn("nth", F.row_number().over(lead)).where(F.col("nth") <= leaders)
        heads = heads.select(F.col("bucket").alias("of"), F.col("id").alias("other"), F.col("root").alias("other_root"))
        met = placed.join(heads, (F.col("bucket") == F.col("of")) & (F.col("root") != F.col("other_root")))
        low = F.col("id") < F.col("other")
        pairs = met.select(
            F.when(low, F.col("id")).otherwise(F.col("other")).alias("a"),
            F.when(low, F.col("other")).otherwise(F.col("id")).alias("b"),
            F.when(low, F.col("root")).otherwise(F.col("other_root")).alias("ca"),
            F.when(low, F.col("other_root")).otherwise(F.col("root")).alias("cb"),
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # a text is compared with few others at once, since a link saves the rest of its component
        nth = Window.partitionBy("b").orderBy(F.xxhash64("a"), "a")
        now = pairs.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= leaders).drop("nth")
        one = shingled.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"), F.col("weights").alias("weights_a"))
        two = shingled.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"), F.col("weights").alias("weights_b"))
        checked = now.join(one, "a").join(two, "b").mapInPandas(_verify, "a long, b long, ca long, cb long, near double")
        checked = written(checked, "near_checked")
        roots = _merged(roots, checked.where(F.col("near") >= least).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        failed = checked.where(F.col("near") < least).select("a", "b")
        tested = failed if tested is None else tested.unionByName(failed)
        active, leaders = placed.select("bucket", "band", "id"), leaders * GROWTH
    placed = _active(active, roots)
    known = texts.select("id", "registers", F.col("packed").alias("bands")).join(shingled, "id")
    full = written(placed.join(known, "id"), "near_left")
    chunks, blocks = (F.ceil(F.col(n) / size).cast("int") for n, size in (("n", MEMBERS), ("others", LEADERS)))
    dealt = F.xxhash64("id")
    members = full.withColumn("chunk", F.pmod(dealt, chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    heads = full.where("root != main").withColumn("block", F.pmod(dealt, blocks).cast("int"))
    heads = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keys, columns = ["bucket", "chunk", "block"], ["band", "root", "registers", "bands", "runs", "weights"]
    links = members.select(*keys, *columns).groupBy(*keys).cogroup(heads.select(*keys, *columns).groupBy(*keys))
    return _merged(roots, written(links.applyInArrow(_compare(least), "a long, b long"), "near_links"))


def _active(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: with their root, the bucket's largest component
    ``main``, its members ``n`` and those outside it ``others``."""
    placed = buckets.join(roots, "id")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("largest"))
    kinds = kinds.where("kinds > 1").select("bucket", F.col("largest.root").alias("main"), "n", (F.col("n") - F.col("largest.n")).alias("others"))
    return written(placed.join(kinds, "bucket"), "near_active")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after linking components."""
    merged = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(merged, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "near_roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: ``doc_id, class_id, kept``.

    ``class_id`` is the least key in the row's class, ``kept`` marks the rows with that key. A null text is a
    class of its own: its key, or null. A null key takes part by its text; a class of null keys has the class null.
    Repeated rows are repeated. An empty table gives no rows. Other columns are ignored.
    """
    found = written(classes(docs, key, text, least), "near_classes")
    least_key = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = found.join(least_key, "class").select("doc_id", "class_id")
    without = docs.where(F.col(text).isNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(key).cast("long").alias("class_id"))
    return named.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each class: the least key, ties by the hash of the text; all columns stay.

    Rows with a null text all stay.
    """
    found = written(classes(docs, key, text, least), "near_classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    each = found.groupBy("class", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = each.groupBy("class").agg(first.alias("row")).select("class", "row.doc_id", "row.mark")
    best = best.select("class", F.col("doc_id").alias("__key"), F.col("mark").alias("__mark"))
    chosen = each.join(best, (each["class"] == best["class"]) & each["doc_id"].eqNullSafe(best["__key"]) & (each["mark"] == best["__mark"]))
    chosen = written(chosen.select(F.struct("__key", "__mark").alias("__row"), (F.col("n") > 1).alias("__repeated")), "near_kept")
    names = docs.columns
    marked = docs.where(F.col(text).isNotNull()).withColumn(
        "__row", F.struct(F.col(key).cast("long").alias("__key"), F.xxhash64(F.col(text)).alias("__mark"))
    )
    kept = joined_small(marked, chosen, "__row", limit=1_000_000)
    once = kept.where(~F.col("__repeated"))
    repeated = kept.where("__repeated").dropDuplicates(["__row"])
    return once.unionByName(repeated).select(names).unionByName(docs.where(F.col(text).isNull()))
