"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is read as its words (lower-cased runs of letters and digits, other letters one by one where a
script has no spaces). A run of ``K`` words is an anchor if, of the runs of ``S`` words in it, the one with the
least hash is the first or the last. Whether a run is an anchor depends on its words alone, so an edit
changes anchors only around it.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 8
S = 2
INNER = K - S + 1  # runs of S words in an anchor

BREAKS = r"[^\p{L}\p{N}\p{M}]+"
NO_SPACES = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"


def words_of(text: Column) -> Column:
    apart = F.when(text.rlike(NO_SPACES), F.regexp_replace(text, f"({NO_SPACES})", "$1 ")).otherwise(text)
    return F.filter(F.split(F.lower(apart), BREAKS), lambda w: w != "")


def anchors(text: Column) -> Column:
    """Hashes of the anchors in order; without any, of all words, and without words of the text itself."""
    words = words_of(text)
    return F.transform(F.array(words), lambda w: _anchors(w, text))[0]


def _anchors(words: Column, text: Column) -> Column:
    size = F.size(words)
    short = F.array(F.hash(F.when(size == 0, F.array(text)).otherwise(words)))

    def chosen(pairs: Column) -> Column:
        def edge(least_two: Column) -> Column:
            # least over runs of 2, then 4, then INNER by overlapping runs
            def with_four(least_four: Column) -> Column:
                def is_anchor(i: Column) -> Column:
                    least = F.least(F.get(least_four, i), F.get(least_four, i + (INNER - 4)))
                    return (F.get(pairs, i) == least) | (F.get(pairs, i + (INNER - 1)) == least)

                return F.transform(
                    F.filter(F.sequence(F.lit(0), size - K), is_anchor), lambda i: F.hash(F.slice(words, i + 1, K))
                )

            return _let(F.zip_with(least_two, F.slice(least_two, 3, size), lambda a, b: F.least(a, b)), with_four)

        return _let(F.zip_with(pairs, F.slice(pairs, 2, size), lambda a, b: F.least(a, b)), edge)

    pairs = F.zip_with(words, F.slice(words, 2, size), lambda a, b: F.hash(a, b))
    found = F.when(size < K, short).otherwise(_let(pairs, chosen))
    return _let(found, lambda a: F.when(F.size(a) == 0, short).otherwise(a))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(found: Column) -> Column:
    """The anchors as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Different anchors in both over those in either."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both, F.lit(1))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning.

    Rows are ordered by descending key, ties by a hash of the text, null keys last; after the last comes the
    first. Null texts count as empty; empty texts are equal to each other. Repeated rows are neighbours. One
    row: it is its own next. Texts move once, dealt out by ranges of the key; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = _ranges(rows)
    ranged_keys = ranged.select("part", "doc_id")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    # the first row of each range, to stand after the last of the range before it
    heads = F.broadcast(ranged_keys.groupBy("part").agg(F.max("doc_id").alias("head")))
    at_head = ranged.join(heads, "part").where(F.col("doc_id").eqNullSafe(F.col("head"))).drop("head")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("text")))
    firsts = at_head.withColumn("nth", nth).where(F.col("nth") == 1).select("part", F.struct("doc_id", "text").alias("row"))
    around = Window.orderBy(F.col("part").desc())
    everything = Window.partitionBy()
    previous = F.coalesce(F.lag("part").over(around), F.min("part").over(everything))
    ghosts = firsts.select(previous.alias("part"), "row.*", F.lit(True).alias("ghost"))
    spread = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts).withColumn("anchors", anchors(F.col("text")))
    within = Window.partitionBy("part").orderBy("ghost", *order)
    paired = spread.select(
        "doc_id", "text", "anchors", "ghost", F.lead("text").over(within).alias("next"), F.lead("anchors").over(within).alias("next_anchors")
    ).where(~F.col("ghost"))
    n = F.length("text")
    kept = (n - F.floor(n / 2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next"), F.lit(1), n - kept))
    shown = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")
    shown = shown.withColumn("edited_anchors", anchors(F.col("edited")))
    return shown.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def _ranges(rows: DataFrame) -> DataFrame:
    """Rows with the number of their range of keys; the ranges hold about as many rows each, null keys are below all."""
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).first()["cuts"] or []
    inner = sorted({float(c) for c in cuts})
    splits = [-float("inf"), *inner, float("inf")]
    if len(splits) < 3:
        splits = [-float("inf"), 0.0, float("inf")]
    cast = rows.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
    ranged = Bucketizer(splits=splits, inputCol="at", outputCol="part", handleInvalid="keep").transform(cast)
    return ranged.drop("at").withColumn("part", F.col("part").cast("int"))
