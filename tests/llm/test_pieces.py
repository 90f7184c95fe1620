"""Pieces: equal to the model library's own ids, best paths by brute force, chunks, round trips."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerwatch.llm import pieces
from ledgerwatch.llm.common import table

SCHEMA = "doc_id long, text string, ids string, decoded string"
PARTS = ["a", "the", " ", "  ", "é", "日本", "\n", "\t", "ing", "tion", "http", "://", "😀", "\0", "x", "12", "()", "{", "    ", "er"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "i", "d") for r in rows], SCHEMA)


def numbers(data):
    return np.frombuffer(data, dtype="<i4").tolist()


def test_same_ids_as_the_library(model, library):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(14)))
        assert numbers(model.encode(text)) == library.encode(text)
        assert model.decode(np.array(numbers(model.encode(text)), dtype=np.int32)) == text


def test_borders_by_their_edges(model):
    """The quick test of two pieces says what merging their letters says."""
    rng = random.Random(5)
    ids = sorted(model.ids.values())
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        merged = model._merged(model.texts[a] + model.texts[b]) == [model.texts[a], model.texts[b]]
        assert model._stay_apart(a, b) in (merged, None) and model.allowed(a, b) == merged


def scanned(model, text, chunk):
    normal, side = model.normal(text), model.longest
    parts = [(normal[max(0, i - side) : i], normal[i : i + chunk], normal[i + chunk : i + chunk + side]) for i in range(0, len(normal), chunk)]
    matrices = [model.transfer(*p) for p in parts]
    # the product is associative
    left = matrices[0]
    for m in matrices[1:]:
        left = pieces.product(left, m)
    right = matrices[-1]
    for m in reversed(matrices[:-1]):
        right = pieces.product(m, right)
    assert left.keys() >= right.keys() and all(left[k] == pytest.approx(right[k]) for k in right)
    ends = {k: w for row in left.values() for k, w in row.items() if k[0] == 0}
    states = pieces.states_between(matrices, (0, pieces.START), max(ends, key=lambda k: (ends[k], k)))
    return numbers(b"".join(model.trace(*p, a, b) for p, a, b in zip(parts, states, states[1:], strict=False)))


def test_chunks_give_the_same(model, library):
    rng = random.Random(8)
    for i in range(300):
        text = "".join(rng.choices(PARTS if i % 2 else ["aaab", "ing", "tion", "represent", "er", "an"], k=rng.randrange(20, 120)))
        assert scanned(model, text, rng.choice([17, 33, 57])) == library.encode(text)


TOY = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "bab", "▁ab"]


def toy(seed):
    rng = random.Random(seed)
    scores = [0.0, *[round(-rng.random() * 5, 3) for _ in TOY[1:]]]
    return pieces.Pieces(TOY, scores, kind="unigram", special=frozenset([0]), prefix_space=True)


def best_score(model, text):
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = model.ids.get(text[start:end])
            if piece is not None:
                best[end] = max(best[end], best[start] + model.scores[piece])
    return best[-1]


def test_unigram_best_paths_and_chunks():
    rng = random.Random(4)
    for seed in range(30):
        model = toy(seed)
        text = "".join(rng.choices("aab b", k=rng.randrange(1, 60)))
        want = best_score(model, model.normal(text))
        for ids in (numbers(model.encode(text)), scanned(model, text, 7)):
            assert "".join(TOY[i] for i in ids) == model.normal(text)
            assert sum(model.scores[i] for i in ids) == pytest.approx(want)


def test_giant_texts_through_spark(spark, model, library):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=2500)), "aab" * 3000, " ".join(["tion"] * 900), "short", "", None, " " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    out = pieces.encode(rows_of(spark, rows), model, chunk=64, decoded="decoded")
    apart = pieces.decode(pieces.encode(rows_of(spark, rows), model, chunk=64), model)
    assert sorted(map(str, out.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, apart.select("doc_id", "ids", "decoded").collect()))
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    for r in got:
        assert r.ids == (None if r.text is None else library.encode(r.text)) and r.decoded == r.text


def test_given_documents(spark, model, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    for r in pieces.encode(docs, model).collect():
        assert r.ids == library.encode(r.text)


def test_odd_rows_and_empty_tables(spark, model):
    rows = [(1, None), (None, ""), (3, "▁ a"), (3, "▁ a"), (4, "\ufffd\0")]
    got = pieces.decode(pieces.encode(rows_of(spark, rows), model), model).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.decoded for r in got] == ["", None, "  a", "  a", "\ufffd\0"]  # the model writes spaces as that letter
    assert [r.ids for r in got][:2] == [[], None]
    assert pieces.encode(rows_of(spark, []), model).count() == 0


def test_bytes_that_are_no_text(model):
    half = model.byte_ids["é".encode()[0]]
    assert model.decode(np.array([half, model.ids["a"]], dtype=np.int32)) == "\ufffda"
