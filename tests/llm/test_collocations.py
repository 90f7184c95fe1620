"""Phrases against counting every run of words, graphs of slices, hot words and nodes."""

import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest

from ledgerwatch.llm import collocations
from ledgerwatch.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r, "p", 7) for i, r in enumerate(rows)], SCHEMA)


def plain_counts(rows, longest):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def plain(rows, longest=3, least=10, top=2000):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in often.items():
            inside = [o for o in often if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o)))]
            if any(100 * often[o] >= 50 * a for o in inside):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, x[3], -x[1], x[4], x[5], n, -x[0]) for i, x in enumerate(found[:top])]
    return sorted(out)


def drawn(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "city", "the", "the", "the", "cat", "ÄB", "b\x00", "b", "x" * 150, "x" * 151]
    ends = [" ", " ", " ", " \t ", ". ", ",", "\n", "\x0b", " ?"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.integers(0, 40))) for _ in range(n)]
    return [(t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_plain_counts(spark, longest):
    rows = drawn(120) + [(None, "en"), ("", "zz"), (" . ", "en"), ("one", "en"), ("lone pair", "de"), ("same words again", "en")]
    rows += [("same words again and again", "en")] * 50 + [("k " * 30_000, "long")]
    got = collocations.phrases(rows_of(spark, rows), longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest)


def test_small_slices_and_many_buckets(spark, monkeypatch):
    rows = drawn(90, seed=5)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 200)
    got = collocations.phrase_counts(rows_of(spark, rows), least=2).collect()
    want = {(lang, " ".join(p), len(p), n) for lang, f in plain_counts(rows, 3).items() for p, n in f.items() if len(p) == 1 or n >= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hot_words_and_nodes_only_spread_the_load(spark, monkeypatch):
    rows = drawn(90, seed=6)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 200)
    docs = rows_of(spark, rows)
    hot_words, hot_nodes = collocations._hot(docs.select("text", "lang").na.fill("und"), 1.0, 3)
    assert len(hot_words) and len(hot_nodes)
    spread = {tuple(r) for r in collocations.phrase_counts(docs, least=2).collect()}
    monkeypatch.setattr(collocations, "_hot", lambda *_: (np.array([], dtype=np.uint64),) * 2)
    assert {tuple(r) for r in collocations.phrase_counts(docs, least=2).collect()} == spread


def test_unary_paths_are_compacted(spark):
    none = np.array([], dtype=np.uint64)
    routes = collocations.Routes(1, none, none)
    docs = rows_of(spark, [("a b c d e f", "en"), ("a b c d e f", "en"), ("x c d y", "en")]).select("text", "lang").coalesce(1)
    got = docs.mapInArrow(partial(collocations._shard, longest=3, routes=routes), collocations.PACKED).collect()
    paths = bytes(got[0]["paths"]).decode().split("\n")[:-1]
    weights = dict(zip(paths, np.frombuffer(got[0]["n"], dtype="<i4").tolist()))
    ends = dict(zip(paths, got[0]["ends"]))
    # node "c d" has two ways in and out; before and after it nothing branches
    assert weights == {"a b c d": 2, "c d e f": 2, "x c d": 1, "c d y": 1}
    assert ends == {"a b c d": 0, "c d e f": 1, "x c d": 0, "c d y": 1}


def test_empty_table_and_rank_limit(spark):
    assert collocations.phrases(rows_of(spark, [])).count() == 0
    rows = drawn(120)
    got = collocations.phrases(rows_of(spark, rows), top=3, least=2)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least=2, top=3)


def test_query_types(spark, sf_dir):
    got = QUERIES["op13_collocations"](spark, sf_dir)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}
