"""Near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerwatch.llm import probminhash
from ledgerwatch.llm.common import word_hashes
from ledgerwatch.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class int, mark string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "m") for i, t in rows], SCHEMA)


def runs(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def expected(rows):
    """Least doc_id of each component of texts with a likeness of 0.8 or more."""
    known = [(i, t, runs(t)) for i, t in rows if t is not None]
    parent = list(range(len(known)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, t, a) in enumerate(known):
        for y in range(x):
            _, u, b = known[y]
            if t == u or (a and b and jaccard(a, b) >= 0.8):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _, _) in enumerate(known):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, least.get(root(x))) for x, (i, _, _) in enumerate(known)]


def documents(rng):
    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    rows = []
    for _ in range(25):
        base = text(rng.randrange(30, 120))
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    repeated = "echo " * 60 + " ".join(text(30))
    rows += [repeated, repeated + " tail", "echo " * 30 + repeated, "a b c", "a b c", "a b d", "one", "", ""]
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = documents(random.Random(1))
    rng = random.Random(2)
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.class_id) for r in probminhash.near_duplicates(table(spark, rows)).collect())
    assert got == sorted(expected(rows))


def test_chains_through_large_near_groups(spark):
    """Versions of one text, each a few words from the last: linked by steps though the ends differ."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(80):
        rows.append((i, " ".join(words)))
        words[rng.randrange(120)] = f"z{i}"
        words[rng.randrange(120)] = f"y{i}"
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(table(spark, rows)).collect()}
    assert sorted(got.items()) == sorted(expected(rows))


def test_registers_agree_as_the_likeness_says():
    rng = np.random.default_rng(3)
    runs_ = rng.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = np.sort(runs_[:240]), np.sort(runs_[60:])
    m, n = rng.integers(1, 9, 240), rng.integers(1, 9, 240)
    want = probminhash.probability_jaccard(a, m, b, n)
    x = probminhash.signature(a, m, 6000)
    y = probminhash.signature(b, n, 6000)
    assert want == pytest.approx((x == y).mean(), abs=0.03)


def test_weighted_likeness_is_the_definition():
    a, b = Counter({1: 3, 2: 1, 5: 2}), Counter({1: 1, 2: 4, 7: 1})
    got = probminhash.probability_jaccard(*(np.array(x, dtype=t) for c in (a, b) for x, t in ((sorted(c), np.uint64), ([c[k] for k in sorted(c)], int))))
    assert got == pytest.approx(jaccard(a, b))


def test_one_run_gives_one_holder():
    assert set(probminhash.signature(np.array([5], dtype=np.uint64), np.array([1])).tolist()) == {5}


def test_keep_one(spark):
    rows = [(7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (None, None), (8, "other words here"), (None, "none")]
    df = table(spark, rows)
    out = probminhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(3, "a b c d e f"), (9, None), (None, None), (8, "other words here"), (None, "none")], key=str
    )


def test_nulls_long_texts_and_empty_tables(spark):
    long = " ".join(f"q{i}" for i in range(40_000))
    rows = [(None, "x y"), (2, "x y"), (4, None), (None, None), (5, long), (6, long + " end"), (7, "?!"), (8, "?!"), (9, "!?")]
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in probminhash.near_duplicates(table(spark, rows)).collect()), key=str)
    want = [(None, 2, False), (2, 2, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert got == sorted(want, key=str)
    assert probminhash.near_duplicates(table(spark, [])).count() == 0
    assert probminhash.keep_one(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_word_hashes_of_long_words():
    text = "a" * 3_000_000 + " b"
    assert len(word_hashes(text)) >= 2 and (word_hashes(text) == word_hashes(text)).all()
    assert (word_hashes("Ab, cd") == word_hashes("ab CD!")).all() and not len(word_hashes(None))


def test_a_block_is_compared_in_arrow():
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(3)]
    texts += [t[:-1] + ["other"] for t in texts] + [list(texts[0])]
    rows = []
    for i, words in enumerate(texts):
        held, weights = probminhash.weighted_shingles(word_hashes(" ".join(words)))
        holder = probminhash.signature(held, weights)
        bands = probminhash.band_hashes(holder)
        bands[0] = 7  # all share the first bucket
        rows.append((0, i, probminhash.marks_of(holder), bands.tobytes(), held.tobytes(), weights.astype(np.int32).tobytes()))
    names = ["band", "root", "registers", "bands", "runs", "weights"]
    block = pa.table(dict(zip(names, zip(*rows, strict=True), strict=True)))
    found = probminhash._compare(0.8)(block, block).to_pylist()
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and jaccard(runs(" ".join(a)), runs(" ".join(b))) >= 0.8}
    assert {(0, 3), (1, 4), (2, 5), (0, 6), (3, 6)} <= near
    assert {(r["a"], r["b"]) for r in found} == near and len(found) == len(near)
    assert probminhash._compare(0.8)(block, block.slice(0, 0)).num_rows == 0
