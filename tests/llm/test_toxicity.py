"""Toxicity: held-out accuracy on made-up word families and the given documents, odd rows."""

import os
import pickle
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ledgerwatch.llm import toxicity
from ledgerwatch.llm.common import LEAN, held_out, lean_workers, table
from ledgerwatch.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score double, toxic string"
LABELS = "doc_id long, toxic int, text string"


def made(seed, count=900):
    """A fifth of the texts has words that begin like no other words do."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "sur", "pa", "vel", "do", "ri", "nus", "hem", "bol"]
    rows, labels = [], []
    for i in range(count):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = "gruz" + "".join(rng.choices(syllables, k=2))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0.1, "x") for r in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], LABELS)


def scores(spark, docs, model):
    return [r.s for r in docs.select(toxicity.toxicity(spark, model, "text").alias("s")).collect()]


def test_rare_words_of_a_family_are_found(spark):
    rows, labels = made(1)
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, labels_of(spark, labels))
    got = scores(spark, docs, model)
    right = [(s >= 0.7) == bool(y) for s, (i, y) in zip(got, labels, strict=True)]
    assert np.mean(right) > 0.97
    fresh = scores(spark, docs_of(spark, [(1, "ka lo mi gruztenpa sur gruzmimi ten"), (2, "ka lo mi ten sur pa")]), model)
    assert fresh[0] > 0.7 > fresh[1]


def test_held_out_rows_teach_nothing(spark):
    rows, labels = made(2, 200)
    docs = docs_of(spark, rows)
    flipped = labels_of(spark, labels).withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels_of(spark, labels)), toxicity.fit(docs, flipped)
    assert (a.words == b.words).all() and (a.grams == b.grams).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_plain_counts(spark):
    """The distributed counts are what a loop over the texts gives."""
    rows, labels = made(3, 120)
    pairs = [set(), set()]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, labels_of(spark, labels))
    marks = {r.doc_id: (r.fold, r.h) for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", held_out("doc_id").alias("fold"), F.xxhash64(F.lit(6), "doc_id").alias("h")).collect()}
    learn = [(i, t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if not marks[i][0]]
    n = [sum(y == c for *_, y in learn) for c in (0, 1)]
    for i, text, y in learn:
        h = marks[i][1]
        if h % 5 and ((h >> 20) % (1 << 20)) < min(1.0, n[1 - y] / n[y]) * (1 << 20):
            words = text.split()
            pairs[y].update(zip(["", *words[:-1]], words, strict=True))
    assert model.totals.tolist() == [len(pairs[0]), len(pairs[1])]
    cells = toxicity.word_cells([w for _, w in pairs[1]])
    assert (model.words[1] == np.bincount(cells, minlength=1 << toxicity.BITS)).all()


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out")
    clean, false = got.where("toxic = 0").agg(F.count("*"), F.sum("predicted")).first()
    assert false <= 0.005 * clean
    low, high = (got.where(f"toxic = {y}").agg(F.avg("score")).first()[0] for y in (0, 1))
    assert high > 5 * low


def test_odd_rows(spark):
    rows, labels = made(4, 150)
    rows += [(None, "gruzka"), (900, None), (901, ""), (902, "?!"), (903, "ka " * 60_000), (904, "a" * 100_000), (5, "ka lo"), (5, "ka lo")]
    labels += [(None, 1), (900, 1), (901, None), (902, 7), (5, 1), (5, 0), (4000, 1)]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, labels_of(spark, labels))
    got = scores(spark, docs, model)
    assert all(0 <= s <= 1 for s in got)
    base = got[151]
    assert got[152] == base and got[153] == base and got[-1] == got[-2]


def test_without_two_classes(spark):
    docs = docs_of(spark, [(i, "a b c") for i in range(10)])
    for labels in ([], [(i, 0) for i in range(10)], [(i, 1) for i in range(10)]):
        assert set(scores(spark, docs, toxicity.fit(docs, labels_of(spark, labels)))) == {0.5}
    empty = docs_of(spark, [])
    assert scores(spark, empty, toxicity.fit(empty, labels_of(spark, []))) == []


def plain(seed, count):
    rng = random.Random(seed)
    return [rng.choices("abcdefghijklmnopqrstuvwxyz", k=30) for _ in range(count)]


def fitted(spark, rows):
    docs = docs_of(spark, [(i, " ".join(words)) for i, words in enumerate(rows)])
    return toxicity.fit(docs, labels_of(spark, [(i, i % 2) for i in range(len(rows))]))


def test_a_rare_word_of_toxic_rows_counts(spark):
    """In fewer contexts than the 39 that a gate of three standard deviations asks for."""
    rows = plain(5, 300)
    for words in rows[1:80:2]:
        words[7] = "9"
    model = fitted(spark, rows)
    with_word, without = model.raw_scores(["c d 9 e f", "c d g e f"])
    assert with_word > without + 0.1


def test_a_word_that_always_follows_the_same_word_counts(spark):
    rows = plain(6, 300)
    for i, words in enumerate(rows):
        words[7:9] = ["8", "9"] if i % 2 else ["8", "7"]
    model = fitted(spark, rows)
    toxic, plain_text = model.raw_scores(["c d 8 9 e f", "c d 8 7 e f"])
    assert toxic > plain_text + 1


def test_all_ordinary_rows_are_counted(spark):
    rows, labels = made(7, 400)
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, labels_of(spark, labels))
    folds = docs.select("doc_id", (~held_out("doc_id") & (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(5)) != 0)).alias("used")).collect()
    used = {r.doc_id for r in folds if r.used}
    pairs = [{p for (i, t), (_, y) in zip(rows, labels, strict=True) if i in used and y == c for p in zip(["", *t.split()[:-1]], t.split())} for c in (0, 1)]
    for word in ("ka", "lo", "mi"):
        at = np.searchsorted(model.vocabulary.keys, toxicity.word_hashes([word]))
        assert model.vocabulary.counts[:, at].ravel().tolist() == [sum(w == word for _, w in p) for p in pairs]


def test_held_out_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out and toxic = 1")
    assert got.agg(F.avg("predicted")).first()[0] > 0.5


def test_scoring_new_words_takes_little_memory():
    cells = (2, toxicity.ORDERS, 1 << toxicity.BITS)
    none = toxicity.Counts(np.empty(0, dtype=np.uint64), np.empty((2, 0)), np.empty((2, 0)))
    model = toxicity.ToxicityModel(
        np.zeros(cells, dtype=np.float32), np.zeros(cells, dtype=np.float32), np.empty((2, 0)), np.ones(2), none, toxicity.NO_RATIOS, 3.0, 0.3
    )
    texts = [" ".join(f"word{i}x{j}" for j in range(300)) for i in range(200)]
    tracemalloc.start()
    scores = model.raw_scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 200 and np.isfinite(scores).all()
    assert peak < 35e6, peak


def test_lean_workers(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "environment", {**spark.sparkContext.environment, "MALLOC_ARENA_MAX": "3"})
    lean_workers(spark)
    seen = spark.range(1).select(F.udf(lambda _: ",".join(os.environ.get(k, "") for k in LEAN))("id")).first()[0]
    assert seen == ",".join({**LEAN, "MALLOC_ARENA_MAX": "3"}.values())


def test_tasks_get_used_cells_only():
    rng = np.random.default_rng(3)
    cells = (2, toxicity.ORDERS, 1 << toxicity.BITS)
    grams, contexts = np.zeros(cells, dtype=np.float32), np.zeros(cells, dtype=np.float32)
    words = [f"w{i}x{i % 7}" for i in range(500)]
    found, _ = toxicity.letter_cells(words[:400])
    for order, (gram, context) in enumerate(found):
        np.add.at(grams, (rng.integers(0, 2, len(gram)), order, gram), 1)
        np.add.at(contexts, (rng.integers(0, 2, len(context)), order, context), 1)
    grams[:, 3] += 1  # a full table stays as it is
    grams[0, 0, -1] = contexts[1, 2, 0] = 5  # the first and the last cell
    none = toxicity.Counts(np.empty(0, dtype=np.uint64), np.empty((2, 0)), np.empty((2, 0)))
    model = toxicity.ToxicityModel(grams, contexts, np.empty((2, 0)), np.ones(2), none, toxicity.NO_RATIOS, 3.0, 0.3)
    sent = toxicity._for_scores(model)
    every = np.arange(1 << toxicity.BITS)
    for order in range(toxicity.ORDERS):
        assert (toxicity._counts_at(sent.grams, order, every) == grams[:, order]).all()
        assert (toxicity._counts_at(sent.contexts, order, every) == contexts[:, order]).all()
    assert (sent.letter_ratios(words) == model.letter_ratios(words)).all()
    assert len(pickle.dumps(sent)) < 6e6 < len(pickle.dumps(model))  # 4 MB are the full table
    empty = toxicity.UsedCells.of(np.zeros(cells, dtype=np.float32))
    assert not empty.at(0, every).any()
