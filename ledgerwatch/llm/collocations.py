"""Phrases whose words keep company: counts from a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import mixed, small_batches
from ledgerwatch.llm.pointer_sort import LOWER, byte_hashes, cut_runs, gathered, runs_of, slices, sort_pointers, text_buffer
from ledgerwatch.workspace import written

LONGEST = 3  # words of an edge
LEAST = 10
TOP = 2000
COVERED = 50  # percent of a phrase's occurrences inside one longer phrase that make it part of that phrase
UNKNOWN = "und"
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20  # of all texts' bytes that one bucket of edges stands for
PATH_EDGES = 1000  # longer paths are cut
HOT_SHARE = 1000  # words and nodes with more than one of so many places are dealt out further
SAMPLE_DOCS = 2000
_U = np.uint64
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*b" \t"]] = True
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PACKED = "bucket int, lang string, paths binary, n binary, ends binary"
COUNTS = "lang string, phrase string, words int, n long"
_PACKED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("paths", pa.binary()), ("n", pa.binary()), ("ends", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


@dataclass(frozen=True)
class Routes:
    """Where a node's edges meet: in the bucket of the rarest of its words, so neighbours on a path often share it.

    ``hot_words`` and ``hot_nodes`` (hashes, at most ``HOT_SHARE`` each) come from a bounded sample and only spread
    the load: a node of hot words alone has a bucket of its own, a hot node one per last word.
    """

    buckets: int
    hot_words: np.ndarray
    hot_nodes: np.ndarray

    def of(self, hashes: np.ndarray, lang: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes of ``size`` words at the given places: bucket, the node's hash, whether the node is hot."""
        rarest = np.full(len(at), np.iinfo(np.uint64).max, dtype=_U)
        node = lang[at].copy()
        for k in range(size):
            h = hashes[at + k]
            hot = np.isin(h ^ lang[at], self.hot_words)
            rarest = np.minimum(rarest, (h >> _U(1)) | (hot.astype(_U) << _U(63)))
            node = mixed(node * _U(3) + h)
        common = (rarest >> _U(63)) == 1
        bucket = mixed(np.where(common, node, rarest) ^ lang[at]) % _U(self.buckets)
        return bucket.astype(np.int64), node, np.isin(node, self.hot_nodes)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where in it each key's run begins."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    return order, np.flatnonzero(new)


def _longer(shorter: np.ndarray, word: np.ndarray, words: int, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From numbers of the runs of k - 1 words at every place, those of k words (-1 where the piece has fewer left).

    Also the places in an order that puts equal runs together, and where in it each begins.
    """
    at = np.flatnonzero(left >= k)
    order, begin = _grouped(shorter[at] * words + word[at + k - 1])
    code = np.full(len(left), -1, dtype=np.int64)
    order = at[order]
    code[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    return code, order, begin


def _left(first: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece, given where pieces begin."""
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(first))
    return np.repeat(tails, tails - heads) - np.arange(len(first))


def _numbered(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number among the different ones, and its 64-bit hash."""
    order, run = sort_pointers(raw, starts, lengths)
    word = np.empty(len(order), dtype=np.int64)
    word[order] = run
    shown = order[np.flatnonzero(np.diff(run, prepend=-1))]
    return word, byte_hashes(raw, starts[shown], lengths[shown])[word]


def _lang_hashes(names: list[str]) -> np.ndarray:
    data = [x.encode("utf-8", "replace") for x in names]
    lengths = np.array([len(x) for x in data], dtype=np.int64)
    raw = np.frombuffer(b"".join(data) + bytes(8), dtype=np.uint8)
    return byte_hashes(raw, np.cumsum(lengths) - lengths, lengths)


def _shard(batches: Iterator[pa.RecordBatch], longest: int, routes: Routes) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE_BYTES):
        yield _paths(part.column("text").combine_chunks(), part.column("lang").to_pylist(), longest, routes)


def _paths(texts: pa.Array, langs: list[str], longest: int, routes: Routes) -> pa.RecordBatch:
    """The graph of one slice of texts: its nodes are runs of ``longest - 1`` words, its edges of ``longest``.

    A node with one edge in, one out, and no piece that begins or ends there only passes its weight on: such
    nodes are compacted, and a path is its words with the weight of its edges, cut where the bucket changes.
    ``ends`` marks paths whose last node, of the same bucket, ends as many pieces as the path weighs and has no
    other edge; the last words of all other pieces are paths of fewer than ``longest`` words, also marked. A row
    packs the paths of a bucket and language: words with a space between, a line end between paths.
    """
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    apart = _ENDS[raw]
    inside = ~(apart | _BLANK[raw])
    inside[-8:] = False
    cuts = offsets[1:-1]
    starts, lengths = cut_runs(*runs_of(inside), cuts[cuts < len(raw) - 8])
    if not len(starts):
        return pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in _PACKED], schema=_PACKED)
    names = sorted(set(langs))
    place_of = {x: i for i, x in enumerate(names)}
    doc = np.searchsorted(offsets, starts, side="right") - 1
    lang = np.array([place_of[x] for x in langs], dtype=np.int64)[doc]
    first = np.ones(len(starts), dtype=bool)  # of a piece
    breaks = np.cumsum(apart, dtype=np.int32)[starts]
    first[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    del breaks, apart, inside, doc
    heads = np.flatnonzero(first)
    left = _left(first)
    word, hashes = _numbered(raw, starts, lengths)
    words = int(word.max()) + 1
    codes = [word * len(names) + lang]
    for k in range(2, longest + 1):
        code, order, of_edge = _longer(codes[-1], word, words, left, k)
        codes.append(code)
    node = codes[longest - 2]
    nodes = max(int(node.max()) + 1, 1)
    weight = np.diff(np.append(of_edge, len(order)))
    firsts = np.minimum.reduceat(order, of_edge) if len(of_edge) else order
    del code, order, of_edge
    by_place = np.argsort(firsts)
    firsts, weight = firsts[by_place], weight[by_place]
    out_edges = np.bincount(node[firsts], minlength=nodes)
    in_edges = np.bincount(node[firsts + 1], minlength=nodes)
    begun = np.bincount(node[heads[left[heads] >= longest - 1]], minlength=nodes)
    last = np.flatnonzero(left == longest - 1)
    ended = np.bincount(node[last], minlength=nodes)
    passes = (out_edges == 1) & (in_edges == 1) & (begun == 0) & (ended == 0)
    lang_hash = _lang_hashes(names)[lang]
    # the bucket of every node where it stands; that of a hot node's edge also hangs on its last word
    full = np.flatnonzero(left >= longest - 1)
    route = np.full(len(left), -1, dtype=np.int64)
    hot = np.zeros(len(left), dtype=bool)
    route[full], node_hash, hot[full] = routes.of(hashes, lang_hash, full, longest - 1)
    spread = full[hot[full] & (left[full] >= longest)]
    salted = mixed(node_hash[np.searchsorted(full, spread)] ^ hashes[spread + longest - 1])
    route[spread] = (salted % _U(routes.buckets)).astype(np.int64)
    # what follows a passing node's only edge stands right after it where it first stands
    joined = np.zeros(len(firsts), dtype=bool)
    joined[1:] = (firsts[1:] == firsts[:-1] + 1) & passes[node[firsts[1:]]] & (route[firsts[1:]] == route[firsts[:-1]])
    begin = np.flatnonzero(~joined)
    nth = np.arange(len(firsts)) - np.repeat(begin, np.diff(np.append(begin, len(firsts))))
    begin = np.flatnonzero(~joined | (nth % PATH_EDGES == 0))
    stop = np.append(begin[1:], len(firsts)) - 1 if len(begin) else begin
    then = firsts[stop] + 1
    final = node[then]
    closes = (in_edges[final] == 1) & (out_edges[final] == 0) & (begun[final] == 0) & (ended[final] == weight[begin])
    closes &= route[then] == route[firsts[begin]]
    closed = np.zeros(nodes, dtype=bool)
    closed[final[closes]] = True
    spans = [(firsts[begin], firsts[stop] + longest, weight[begin], closes)]
    for k in range(1, longest):
        at = last[~closed[node[last]]] if k == longest - 1 else heads[left[heads] == k]
        _, shown, n = np.unique(codes[k - 1][at], return_index=True, return_counts=True)
        spans.append((at[shown], at[shown] + k, n, np.ones(len(n), dtype=bool)))
    low, high, n, ends = (np.concatenate(x) for x in zip(*spans))
    bucket = np.where(route[low] < 0, hashes[low] % _U(routes.buckets), route[low].astype(_U)).astype(np.int64)
    group = bucket * len(names) + lang[low]
    by_group = np.lexsort((word[low], group))  # like words together
    low, high, n, ends, group = low[by_group], high[by_group], n[by_group], ends[by_group], group[by_group]
    # all words with one space between them; a path is a stretch of that
    after = np.cumsum(lengths + 1)
    line = raw[np.arange(after[-1]) + np.repeat(starts - after + lengths + 1, lengths + 1)]
    line[after - 1] = 32
    at = after[low] - lengths[low] - 1
    size = after[high - 1] - at
    upto = np.cumsum(size)
    packed = line[np.arange(upto[-1]) + np.repeat(at - upto + size, size)]
    packed[upto - 1] = 10
    of_group = np.flatnonzero(np.diff(group, prepend=-1))
    edges = np.append(of_group, len(group))
    cuts = np.append(0, upto)[edges]
    columns = [
        pa.array((group[of_group] // len(names)).astype(np.int32)),
        pa.array(names, type=pa.string()).take(pa.array(group[of_group] % len(names))),
        _binary(packed, cuts),
        _binary(n.astype("<i4").view(np.uint8), edges * 4),
        _binary(ends.astype(np.uint8), edges),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PACKED)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    )


def _bucket_counts(table: pa.Table, longest: int, least: int, routes: Routes) -> pa.Table:
    """Edge weights of a bucket summed over all slices, and from what leaves them the weights of nodes and prefixes.

    A node's flow is whole here unless it is hot, so rarer ones are left out; shorter prefixes are parts of sums.
    """
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs))
    place_of = {x: i for i, x in enumerate(names)}
    counts = [np.frombuffer(x.as_py(), dtype="<i4") for x in table.column("n")]
    ends = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("ends")]).astype(bool)
    line_lang = np.repeat([place_of[x] for x in langs], [len(x) for x in counts])
    counts = np.concatenate(counts).astype(np.int64)
    raw = np.frombuffer(b"".join(x.as_py() for x in table.column("paths")) + bytes(8), dtype=np.uint8)
    inside = (raw != 32) & (raw != 10)
    inside[-8:] = False
    starts, lengths = runs_of(inside)
    line = np.cumsum(raw == 10, dtype=np.int32)[starts].astype(np.int64)
    del inside
    left = _left(np.diff(line, prepend=-1) != 0)
    word, hashes = _numbered(raw, starts, lengths)
    lang = line_lang[line]
    # a place counts for its first k words unless an unmarked path just ends there
    weight = np.where((left >= longest) | ends[line], counts[line], 0)
    words = int(word.max()) + 1
    code = word * len(names) + lang
    order, new = _grouped(code)
    out = []
    for k in range(1, longest + 1):
        if k > 1:
            code, order, new = _longer(code, word, words, left, k)
        total = np.add.reduceat(weight[order], new) if len(new) else weight[:0]
        shown = order[new]
        if k == longest:
            kept = total >= least
        elif k == longest - 1 and k > 1:
            kept = (total >= least) | routes.of(hashes, _lang_hashes(names)[lang], shown, k)[2]
        else:
            kept = total > 0
        shown, total = shown[kept], total[kept]
        stop = shown + k - 1
        out.append(
            pa.Table.from_arrays(
                [
                    pa.array(names, type=pa.string()).take(pa.array(lang[shown])),
                    gathered(raw, starts[shown], starts[stop] + lengths[stop] - starts[shown]),
                    pa.array(np.full(len(shown), k, dtype=np.int32)),
                    pa.array(total),
                ],
                schema=_COUNTS,
            )
        )
    return pa.concat_tables(out)


def _hot(rows: DataFrame, share: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and nodes with more than one of ``HOT_SHARE`` places in a sample of whole texts."""
    pieces = rows.sample(share, seed=13).select("lang", F.explode(F.split(F.translate("text", _A_Z, _A_Z.lower()), r"[.,;:!?\n\x0B\f\r]")).alias("piece"))
    ws = F.filter(F.split("piece", "[ \t]+"), lambda w: w != "")
    shifted = F.arrays_zip(*[(F.slice(ws, i + 1, F.size(ws)) if i else ws).alias(f"w{i}") for i in range(longest - 1)])
    names = [f"w{i}" for i in range(longest - 1)]
    seen = pieces.select("lang", F.inline(shifted).alias(*names)).groupBy("lang", *names).agg(F.count("*").alias("times"))
    seen = written(seen, "node_sample")
    whole = seen.agg(F.sum("times")).first()[0] or 0
    found = []
    for keys in (names[:1], names):
        often = seen.groupBy("lang", *keys).agg(F.sum("times").alias("times")).where(F.col("times") * HOT_SHARE > whole)
        found.append([(r["lang"], [r[c] for c in keys]) for r in often.collect() if r[keys[-1]] is not None])
    words = [h[0] ^ lang for h, lang in map(_hashes_of, found[0])]
    nodes = []
    for h, lang in map(_hashes_of, found[1]):
        node = np.array([lang], dtype=_U)
        for x in h:
            node = mixed(node * _U(3) + x)
        nodes.append(node[0])
    return np.array(words, dtype=_U), np.array(nodes, dtype=_U)


def _hashes_of(row: tuple[str, list[str]]) -> tuple[np.ndarray, np.uint64]:
    return _lang_hashes(row[1]), _lang_hashes([row[0]])[0]


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): occurrences of every word, and of phrases up to ``longest`` words seen ``least`` times.

    Only the longest runs are counted in texts. They are edges of a graph whose nodes are the runs one word
    shorter; what leaves a node, with the pieces that end there, is how often the node occurs, and likewise for
    every shorter prefix. Slices of texts give compacted paths, packed by bucket; a bucket holds whole nodes, so
    one shuffle serves edges and flows, and rare nodes go no further than into their prefixes' sums. The number
    of buckets follows the bytes of all texts. ``phrases`` says what nulls, repeats and empty tables give.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
    )
    n_docs, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    routes = Routes(1 + n_bytes // BUCKET_BYTES, *_hot(rows, min(1.0, SAMPLE_DOCS / max(n_docs, 1)), longest))
    paths = rows.mapInArrow(partial(_shard, longest=longest, routes=routes), PACKED)

    def sums(table: pa.Table) -> pa.Table:
        return _bucket_counts(table, longest, least, routes)

    parts = paths.groupBy("bucket").applyInArrow(sums, COUNTS)
    counts = parts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where((F.col("words") == 1) | (F.col("n") >= least))


def _exact(count: Column) -> Column:
    return count.cast("decimal(14,0)")  # a count of words below 10^14; the products below stay under 38 digits


def phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and
    tabs into words. Phrases of 2 to ``longest`` words seen at least ``least`` times are candidates; the cut in
    two with the lowest floor(10^6 a^2 / (l r)) counts, equal ones by the shorter first part. A candidate goes
    if a longer one with ``covered`` percent of its occurrences holds it. Ranks by score and a descending, then
    by the phrase's UTF-8 bytes. Null texts are empty, null languages ``und``; repeated rows count again; texts
    without a phrase and empty tables give no rows.
    """
    counts = written(phrase_counts(docs, text, lang, longest, least), "phrase_counts")
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= least)
    found = often.where("words > 1").withColumnRenamed("n", "a")
    left = often.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cut = cut.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    above = F.lit(1_000_000).cast("decimal(7,0)") * (_exact(F.col("a")) * _exact(F.col("a")))
    cut = cut.withColumn("score", F.call_function("div", above, _exact(F.col("l")) * _exact(F.col("r"))))
    lowest = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ws = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(ws, i, k), " "))))
    holding = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rest = lowest.join(holding, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = rest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within 16 parts of a language, so that no task ranks one of them whole
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
