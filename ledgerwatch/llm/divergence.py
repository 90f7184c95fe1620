"""Which sources of a language use other words than the rest: exact divergences of smoothed term shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import small_batches
from ledgerwatch.llm.pointer_sort import LOWER, cut_runs, gathered, runs_of, slices, sort_pointers, text_buffer
from ledgerwatch.workspace import written

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
_FIELDS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of whole texts: one row per term and group with its occurrences and documents.

    A row with an empty term says that the group occurs, and in how many documents.
    """
    for part in slices(batches, "text"):
        groups, group_of = _groups(part.column("lang").to_pylist(), part.column("source").to_pylist())
        by_group = np.argsort(group_of, kind="stable")  # then a word's pointers come group by group, text by text
        group_of = group_of[by_group]
        raw, offsets = text_buffer(part.column("text").combine_chunks().take(pa.array(by_group)))
        raw = LOWER[raw]
        cuts = offsets[1:-1]
        starts, lengths = cut_runs(*runs_of(_LETTER[raw]), cuts[cuts < len(raw) - 8])
        order, run = sort_pointers(raw, starts, lengths)
        doc = np.searchsorted(offsets, starts[order], side="right") - 1
        group = group_of[doc]
        new_cell = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
        new_doc = (np.diff(run, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
        n = np.diff(np.append(new_cell, len(run)))
        docs = np.add.reduceat(new_doc.astype(np.int64), new_cell) if len(new_cell) else n
        first = order[new_cell]
        yield _rows(groups, group[new_cell], gathered(raw, starts[first], lengths[first]), n, docs)
        sizes = np.bincount(group_of, minlength=len(groups))
        yield _rows(groups, np.arange(len(groups)), pa.array([""] * len(groups)), np.zeros(len(groups), dtype=np.int64), sizes)


def _groups(langs: list[str], sources: list[str]) -> tuple[list[tuple[str, str]], np.ndarray]:
    number: dict[tuple[str, str], int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in zip(langs, sources)], dtype=np.int64)
    return list(number), which


def _rows(groups: list, which: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    lang, source = (pa.array([g[i] for g in groups], type=pa.string()).take(pa.array(which)) for i in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(docs)], schema=_FIELDS)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group of documents, and documents with it.

    Terms are runs of ASCII letters and characters beyond ASCII; A-Z are lower-cased, nothing else. Null text,
    lang and source are ''. Each row of ``docs`` is a document, repeated rows too. A group's row with the empty
    term has n 0 and its number of documents, so groups without any term are there. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    parts = rows.mapInArrow(_count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), exact; null if nothing is kept."""
    above = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + size.cast("decimal(18,0)") * 2
    return 1 + F.call_function("div", above, F.when(below > 0, below))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which terms.

    Each language keeps the terms in at least ``least_docs`` of its documents. Part ``pair``: the summed gap of
    all kept terms' smoothed shares between a source and each other one of its language (0 if nothing is kept).
    Part ``term``: the first ``top_terms`` terms whose share in the source is above that in the language, by
    their gap. Ranks from 1 by value descending, item by UTF-8 bytes ascending. See ``term_counts`` for nulls,
    repeated rows and empty tables; a language with one source has no pairs.

    Sums over all terms are not made term by term for every pair: terms missing from a source share one value,
    so a pair needs the terms both have, a histogram of counts per source, and one number for all the rest. The
    terms both have come from a join on the term, which has at most one row per source.
    """
    counts = written(term_counts(docs, text, lang, source), "term_counts")
    kept = (
        counts.where(F.col("term") != "")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    here = written(counts.where(F.col("term") != "").join(kept, ["lang", "term"]), "kept_terms")
    used = here.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    whole = here.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.sum("n_lang").alias("lang_total"), F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    sources = (
        counts.where(F.col("term") == "")
        .select("lang", "source")
        .join(used, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .na.fill(0, ["total", "terms", "lang_total", "size"])
        .withColumn("rest", _share(zero, F.col("total"), F.col("size")))
    )
    sources = written(sources, "source_totals")
    shares = here.join(sources.drop("terms"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("size")))
    return _terms(shares, top_terms).unionByName(_pairs(shares, sources))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    q = _share(F.col("n_lang"), F.col("lang_total"), F.col("size"))
    rows = shares.withColumn("q", q).where(F.col("p") > F.col("q"))
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(shares: DataFrame, sources: DataFrame) -> DataFrame:
    one = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("rest").alias("ra"))
    two = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("rest").alias("rb"))
    pa_, pb, ra, rb = (F.col(c) for c in ("pa", "pb", "ra", "rb"))
    both = one.join(two, ["lang", "term"]).where(F.col("a") < F.col("b"))
    both = both.select("lang", "a", "b", (_gap(pa_, pb) - _gap(pa_, rb) - _gap(ra, pb) + _gap(ra, rb)).alias("value"))
    # terms of one source against the share that the other gives to what it lacks
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = sources.select("lang", F.col("source").alias("other"), "rest")
    single = levels.join(other, "lang").where(F.col("source") != F.col("other"))
    single = single.select(
        "lang",
        F.least("source", "other").alias("a"),
        F.greatest("source", "other").alias("b"),
        (F.col("times") * _gap(F.col("p"), F.col("rest"))).alias("value"),
    )
    left = sources.select("lang", "size", F.col("source").alias("a"), F.col("rest").alias("ra"), F.col("terms").alias("ta"))
    right = sources.select("lang", F.col("source").alias("b"), F.col("rest").alias("rb"), F.col("terms").alias("tb"))
    neither = left.join(right, "lang").where(F.col("a") < F.col("b"))
    missing = F.col("size") - F.col("ta") - F.col("tb")
    neither = neither.select("lang", "a", "b", F.coalesce(missing * _gap(ra, rb), F.lit(0)).alias("value"))
    sums = both.unionByName(single).unionByName(neither).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]))
    return _ranked(sums.select("lang", "value", ways).withColumn("part", F.lit("pair")))
