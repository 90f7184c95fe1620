"""Divergence audit against plain Python, the pointer sort against sorted()."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerwatch.llm import divergence, pointer_sort

SCHEMA = "doc_id long, text string, lang string, source string, n long, docs long, term string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r, 7, 7, "x") for i, r in enumerate(rows)], SCHEMA)


def plain(rows, least=10, top=10):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = Counter(x.translate(lower) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        n[lang, source].update(terms)
        df[lang].update(terms.keys())
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, d in df[lang].items() if d >= least)
        size = len(kept)

        def share(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * size)

        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        p = {s: {t: share(n[lang, s][t], sum(n[lang, s][x] for x in kept)) for t in kept} for s in sources}

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            found = [(-gap(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(items[:most])}
    return out


def test_equals_plain_counts(spark):
    rng = np.random.default_rng(1)
    words = ["Über", "a", "A", "b9c", "straßenbahnhaltestelle", "straßenbahnhaltestellen", "日本語", "z-z", "ñ" * 300, "ñ" * 301, "longerthanseven", "longerthanseventoo"]
    rows = [
        (" ".join(rng.choice(words, size=rng.integers(0, 30))), ["en", "de", None][i % 3], [None, "s", "t", "ü", "w"][int(rng.integers(0, 5))])
        for i in range(150)
    ]
    rows += [(None, "en", "silent"), ("", "xx", None), ("1 2 3", "yy", "a"), ("b", "yy", "b"), ("x" * 200_000, "de", "s")]
    rows += [("the same row", "en", "s")] * 40
    got = divergence.audit(rows_of(spark, rows))
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert got.count() == len(plain(rows))


def test_empty_table(spark):
    got = divergence.audit(rows_of(spark, []))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got.count() == 0


def test_slices_do_not_change_counts(spark, monkeypatch):
    rows = [(f"alpha beta{i % 7} gamma", "en", f"s{i % 3}") for i in range(60)]
    batches = [pa.RecordBatch.from_pylist([{"text": t, "lang": x, "source": s} for t, x, s in rows[i : i + 7]]) for i in range(0, 60, 7)]

    def summed():
        total = Counter()
        for b in divergence._count(iter(batches)):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return total

    whole = summed()
    monkeypatch.setattr(pointer_sort.slices, "__defaults__", (1,))
    assert summed() == whole
    assert whole["en", "s0", "", "docs"] == 20


@pytest.mark.parametrize("seed", range(4))
def test_pointers_sort_like_bytes(seed):
    rng = np.random.default_rng(seed)
    letters = [b"a", b"b", b"\x00", b"abcdefg", b"\xff"]
    words = [b"".join(rng.choice(letters, size=rng.integers(1, 40))) for _ in range(500)] + [b"q" * 400, b"q" * 400, b"q" * 401]
    raw = np.frombuffer(b"".join(words) + bytes(8), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    order, run = pointer_sort.sort_pointers(raw, np.cumsum(lengths) - lengths, lengths)
    assert [words[i] for i in order] == sorted(words)
    assert [i for i in order] == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert len(set(run)) == len(set(words))
    assert all((words[a] == words[b]) == (x == y) for a, b, x, y in zip(order, order[1:], run, run[1:]))
