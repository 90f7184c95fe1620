"""Fingerprints against a plain reading of the definition."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerwatch.llm import syncmers

SCHEMA = "doc_id long, text string, fingerprint string, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


def run(spark, rows):
    return syncmers.fingerprint_documents(table(spark, rows)).collect()


def plain_anchors(spark, words):
    """Runs whose least inner hash is at an edge, hashes by Spark's own function."""
    if len(words) < syncmers.K:
        return [tuple(words)]
    pairs = [list(words[i : i + 2]) for i in range(len(words) - 1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    h = [r.h for r in df.orderBy("i").select(F.hash("a", "b").alias("h")).collect()]
    out = []
    for i in range(len(words) - syncmers.K + 1):
        inner = h[i : i + syncmers.INNER]
        if min(inner) in (inner[0], inner[-1]):
            out.append(tuple(words[i : i + syncmers.K]))
    return out or [tuple(words)]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(2)
    for size in (7, 8, 9, 40, 300):
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(size)]
        want = plain_anchors(spark, words)
        hashes = spark.createDataFrame([(list(w),) for w in want], "w array<string>").select(F.hash("w").alias("h")).collect()
        got = spark.createDataFrame([(" ".join(words),)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first().a
        assert got == [r.h for r in hashes]


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_edits_follow_the_descending_order(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 501, " ".join(rng.choices(["ein", "Wort", "né", "😀x", "und", "z"], k=rng.randrange(0, 60)))) for i in range(501)]
    got = {r.doc_id: r for r in run(spark, rows)}
    order = sorted(rows, reverse=True)
    assert len(got) == 501
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        assert got[i].edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert got[i].n_chars == len(text)
        assert re.fullmatch("([0-9A-F]{8})+", got[i].fingerprint)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_likeness(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(800)]
    got = {r.doc_id: r for r in run(spark, [(3, " ".join(words)), (2, " ".join(words)), (1, " ".join(other))])}
    assert got[3].fingerprint == got[2].fingerprint and got[3].near_next == 1 and got[3].near_edited > 0.3
    assert got[2].near_next == 0 and 0.2 < got[2].near_edited < 0.5


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, "n"), (None, None), (5, ""), (5, "b"), (5, "b"), (4, "x" * 150_000), (4, None), (3, "汉字没有空格" * 40)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert sum(r.n_chars == 0 for r in got) == 3
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows[::-1])))


def test_one_row_and_none(spark):
    (only,) = run(spark, [(1, "a b c d")])
    assert only.near_next == 1
    assert run(spark, []) == []
