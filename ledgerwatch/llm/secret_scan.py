"""Secrets in texts: a trigram index names the texts a rule's pattern can match, and only those are searched.

All of it is column expressions; the rules are compiled on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.workspace import written

BLOCK_DOCS = 8192  # texts whose posting lists are intersected together
MAX_CLASS = 8  # characters of a class that is followed character by character
MAX_STRINGS = 64  # alternatives of a stretch of a pattern that are followed together
BROADCAST_DOCS = 200_000  # candidates that may travel to the texts; more are joined by a shuffle


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, group=2, least=6, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of 24 and more are the runs [0-9a-f]+ of that length
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.~-]{16,}", ignore_case=True),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[^\x00-\x20/@:]{3,}@[A-Za-z0-9]"),
)

Clause = frozenset[frozenset[str]]  # one of these sets of trigrams is in the text


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Clause | None:
    """One of ``strings`` is in the text; nothing is known if one has no trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {_grams(s) for s in strings}
    return frozenset(s for s in sets if not any(other < s for other in sets))


def _class_strings(items) -> set[str] | None:
    """The lower-cased characters of a class of a few, else None."""
    found = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < MAX_CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MAX_CLASS else None


def _strings(parsed) -> set[str] | None:
    """All strings that a part of a pattern can match, lower-cased, if they are few; else None."""
    found = {""}
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = {chr(value).lower()}
        elif name == "IN":
            more = _class_strings(value)
        elif name == "SUBPATTERN":
            more = _strings(value[3])
        elif name == "BRANCH":
            branches = [_strings(b) for b in value[1]]
            more = None if any(b is None for b in branches) else set().union(*branches)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
            more = _strings(value[2])
            more = more if more is None or value[0] else more | {""}
        else:
            more = None
        if more is None or len(found) * len(more) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _walk(parsed, clauses: list[Clause]) -> None:
    """Add what every match of a sequence of pattern parts must contain."""
    ends = {""}  # what may stand right before the present part

    def settle() -> None:
        clause = _clause(ends)
        if clause:
            clauses.append(clause)

    for part in parsed:
        more = _strings([part])
        if more is not None and len(ends) * len(more) <= MAX_STRINGS:
            ends = {a + b for a in ends for b in more}
            continue
        settle()
        ends = {""}
        op, value = part
        name = str(op)
        if name == "SUBPATTERN":
            _walk(value[3], clauses)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            _walk(value[2], clauses)
        elif name == "BRANCH":
            branches = []
            for branch in value[1]:
                inner: list[Clause] = []
                _walk(branch, inner)
                branches.append(min(inner, key=len, default=None))
            if all(branches):
                clauses.append(frozenset().union(*branches))
    settle()


def trigram_query(rule: Rule) -> list[Clause]:
    """What the lower-cased text of every match contains: all clauses hold, a clause if all trigrams of one of its
    sets are there. Empty if the pattern has no mandatory trigram; such a rule searches every text.

    Patterns may hold literals, classes, groups, alternatives and repeats; anything else adds no clause. Only
    ASCII letters are folded, so characters beyond ASCII match themselves.
    """
    clauses: list[Clause] = []
    _walk(re._parser.parse(rule.pattern), clauses)
    return [c for c in dict.fromkeys(clauses) if all(g.isascii() for s in c for g in s)]


def trigrams_of(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for c in trigram_query(r) for s in c for g in s})


def _any_of(grams: Sequence[str]) -> str:
    """A pattern that finds each of the trigrams wherever it stands, overlaps included: branches by first two letters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(grams):
        tree.setdefault(a, {}).setdefault(b, []).append(re.escape(c))
    seconds = {a: "|".join(f"{re.escape(b)}[{''.join(cs)}]" for b, cs in some.items()) for a, some in tree.items()}
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{some})" for a, some in seconds.items()) + "))"


def postings(docs: DataFrame, grams: Sequence[str], text: str = "text", key: Column | None = None) -> DataFrame:
    """(block, gram, ids): which texts hold each trigram in lower case, by blocks of about ``BLOCK_DOCS`` texts.

    The inverted index for the trigrams that some rule asks for. ``key`` is a 64-bit number per row, the hash of
    the text by default: rows with one key share an entry, so copies are indexed once, and a collision only adds
    a text to search. Null and empty texts have no postings, empty tables none at all.
    """
    key = F.xxhash64(text) if key is None else key
    if not grams:
        return docs.sparkSession.createDataFrame([], "block bigint, gram string, ids array<bigint>")
    low = docs.where(F.length(text) > 2).select(key.alias("id"), F.lower(F.col(text)).alias("low"))
    held = F.array_distinct(F.regexp_extract_all("low", F.lit(_any_of(grams)), F.lit(1)))
    rows = low.select("id", held.alias("grams")).where(F.size("grams") > 0)
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode("grams").alias("gram"), "id")
    return rows.groupBy("block", "gram").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _matching(query: Sequence[Clause]) -> Column:
    """The ids of a block, of column ``lists`` (trigram to ids), that satisfy a query."""
    def ids(gram: str) -> Column:
        return F.coalesce(F.col("lists").getItem(gram), F.array().cast("array<long>"))

    def fold(columns: list[Column], combine) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = combine(out, c)
        return out

    sets = [fold([fold([ids(g) for g in sorted(s)], F.array_intersect) for s in sorted(c, key=sorted)], F.array_union) for c in query]
    return fold(sets, F.array_intersect)


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, kinds): the texts that each rule's trigrams leave, from posting lists intersected block by block."""
    asked = [(r.kind, trigram_query(r)) for r in rules]
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    found = [F.struct(F.lit(kind).alias("kind"), _matching(query).alias("ids")) for kind, query in asked if query]
    rows = lists.select(F.inline(F.array(*found))).select("kind", F.explode("ids").alias("id"))
    return rows.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(sizes: Column) -> Column:
    """Running sums of an array, in about n * sqrt(n) steps: within stretches of sqrt(n), then over them."""

    def sums(stretches: Column, totals: Column) -> Column:
        def within(s: Column, k: Column) -> Column:
            before = _total(F.slice(totals, F.lit(1), k))
            return _bound(before, lambda b: F.transform(s, lambda x, i: b + _total(F.slice(s, F.lit(1), i + 1))))

        return F.flatten(F.transform(stretches, within))

    def cut(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        steps = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), width)
        return F.transform(steps, lambda i: F.slice(xs, i, width))

    return _bound(sizes, lambda xs: _bound(cut(xs), lambda st: _bound(F.transform(st, _total), lambda t: sums(st, t))))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind_no, end>> of a rule's matches in a text, in code points, ``end`` exclusive.

    Each match is taken with the gap before it, from where the last one ended, so lengths give the places.
    """
    flags = "(?i:" if rule.ignore_case else "(?:"
    pattern = F.lit(rf"\G((?s:.*?))({flags}{rule.pattern}))")
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    gaps = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(2 + rule.group)), lambda x: F.length(x))
    rows = _bound(whole, lambda w: F.arrays_zip(w.alias("w"), gaps.alias("g"), kept.alias("k"), _running(w).alias("e")))
    rows = F.filter(rows, lambda m: m["k"] >= rule.least)
    return F.transform(
        rows,
        lambda m: F.struct(
            (m["e"] - m["w"] + m["g"]).alias("start"), F.lit(number).alias("kind_no"), m["e"].alias("end")
        ),
    )


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + ADDED, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: array<struct<start, kind_no, end, kind>>, by start, then by the rules' order.

    Rules with mandatory trigrams search only the texts that their index leaves; the others search all. Null
    texts are empty and have no secrets; repeated rows are searched each for itself; a text of any length is
    searched whole. Columns of ``docs`` stay as they are, whatever their names, but ``out`` is replaced.
    """
    names = [c for c in docs.columns if c != out]
    index = written(postings(docs, trigrams_of(rules), text), "trigram_postings")
    found = written(candidates(index, rules), "secret_candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_DOCS else found
    key, kinds = "__secret_id", "__secret_kinds"
    found = found.withColumnsRenamed({"id": key, "kinds": kinds})
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text).alias(key)).join(found, key, "left")
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    each = []
    for number, rule in enumerate(rules):
        flags = "(?i)" if rule.ignore_case else ""
        asked = F.array_contains(kinds, rule.kind) if trigram_query(rule) else F.lit(True)
        each.append(F.when(asked & F.col(text).rlike(flags + rule.pattern), spans(F.col(text), rule, number)).otherwise(none))
    labels = F.array(*[F.lit(r.kind) for r in rules])
    sorted_spans = F.array_sort(F.flatten(F.array(*each)))
    labelled = F.transform(sorted_spans, lambda s: F.struct(s["start"], s["kind_no"], s["end"], F.get(labels, s["kind_no"]).alias("kind")))
    return rows.select(*[F.col(f"`{c}`") for c in names], labelled.alias(out))


def counted(found: Column, number: int) -> Column:
    """How many spans a rule has."""
    return F.size(F.filter(found, lambda s: s["kind_no"] == number)).cast("long")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
