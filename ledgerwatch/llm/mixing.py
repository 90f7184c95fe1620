"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow routes each pattern's
words to its sources' quotas; a pattern's second and third use cost more than its first, so repetition is
spread as evenly as the quotas allow. Within a pattern a seeded hash says which documents get one use more.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.workspace import written

WEIGHTS = (5, 2, 1)
MAX_USES = 3
BUCKETS = 1 << 16
LOW_BITS = 44  # of the seeded place within a bucket


def word_count(text: str | Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MAX_USES) -> dict[str | None, float]:
    """Targets that share the total by weight, in code point order, null last; none above ``most`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(names)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = float(most * sizes[s])
        left = max(0.0, left - sum(out[s] for s in above))
        free = [s for s in free if s not in out]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(
    patterns: dict[str, tuple[int, list[str | None]]], quotas: dict[str | None, float], most: int = MAX_USES
) -> dict[str, int]:
    """Words to take of each pattern.

    ``patterns``: key to (words, sources); ``quotas``: words per source. As much of the quotas is met as the
    patterns allow with ``most`` uses; the n-th use of a word costs n - 1.
    """
    graph: list[list[_Arc]] = [[], []]  # 0: start, 1: end

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    out = dict.fromkeys(patterns, 0)
    shared: dict[str | None, list[str]] = {}
    for key, (_, sources) in patterns.items():
        for s in sources:
            shared.setdefault(s, []).append(key)
    seen: set[str] = set()
    for first in patterns:
        if first in seen:
            continue
        group, todo = [], [first]
        seen.add(first)
        while todo:  # patterns that share sources, directly or by others
            key = todo.pop()
            group.append(key)
            for s in patterns[key][1]:
                for other in shared[s]:
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
        graph = [[], []]
        place: dict[str | None, int] = {}
        start_arcs: dict[str, list[int]] = {}
        for key in sorted(group):
            words, sources = patterns[key]
            node = len(graph)
            graph.append([])
            start_arcs[key] = []
            for use in range(most):
                start_arcs[key].append(len(graph[0]))
                arc(0, node, words, use)
            for s in sources:
                if s not in place:
                    place[s] = len(graph)
                    graph.append([])
                    arc(place[s], 1, max(0, round(quotas.get(s, 0.0))), 0)
                arc(node, place[s], most * words, 0)
        _augment(graph)
        for key, arcs in start_arcs.items():
            out[key] = sum(patterns[key][0] - graph[0][i].room for i in arcs)
    return out


def _augment(graph: list[list[_Arc]]) -> None:
    """Push flow from node 0 to node 1 along cheapest paths until there is none."""
    while True:
        cost = [math.inf] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        cost[0] = 0
        todo, waiting = deque([0]), {0}
        while todo:
            node = todo.popleft()
            waiting.discard(node)
            for i, a in enumerate(graph[node]):
                if a.room and cost[node] + a.cost < cost[a.to]:
                    cost[a.to] = cost[node] + a.cost
                    came[a.to] = (node, i)
                    if a.to not in waiting:
                        waiting.add(a.to)
                        todo.append(a.to)
        if cost[1] == math.inf:
            return
        room, node = math.inf, 1
        while node:
            node, i = came[node]
            room = min(room, graph[node][i].room)
        node = 1
        while node:
            before, i = came[node]
            graph[before][i].room -= room
            graph[node][graph[before][i].back].room += room
            node = before


def place_of(key: str | Column, seed: int) -> Column:
    """A seeded place of the key among all: 60 bits of a digest, which SQL engines agree on. Null keys have one place."""
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def pattern_of(members: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))), {"ignoreNullFields": "false"})


@dataclass
class Mix:
    """What a mix takes: per pattern whole uses of all documents, and one more up to a place."""

    uses: dict[str, tuple[int, int]]

    def uses_of(self, members: Column, place: Column) -> Column:
        rows = [(p, whole, last) for p, (whole, last) in sorted(self.uses.items())]
        if not rows:
            return F.lit(0)
        plan = F.create_map(*[x for p, whole, last in rows for x in (F.lit(p), F.struct(F.lit(whole), F.lit(last).cast("long")))])
        found = plan[pattern_of(members)]
        return F.coalesce(found["col1"] + (place <= found["col2"]).cast("int"), F.lit(0))


def plan_mix(rows: DataFrame, quotas: dict[str | None, float], most: int = MAX_USES) -> Mix:
    """Plan from rows ``(members array<string>, size long, place long)``.

    The driver receives one row per membership pattern, twice; the sums that find the last place are at most
    ``BUCKETS`` rows a pattern, and the rows of one bucket. Rows without size or members are not taken.
    """
    slim = written(
        rows.where((F.col("size") > 0) & F.col("members").isNotNull()).select(pattern_of(F.col("members")).alias("pattern"), "members", "size", "place"),
        "mix_rows",
    )
    summed = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.first("members").alias("members")).collect()
    patterns = {r["pattern"]: (r["words"], list(dict.fromkeys(r["members"]))) for r in summed}
    flow = min_cost_flow(patterns, quotas, most)
    whole = {p: flow[p] // words for p, (words, _) in patterns.items()}
    rest = {p: flow[p] - whole[p] * words for p, (words, _) in patterns.items()}
    partial = {p: r for p, r in rest.items() if r}
    uses = {p: (whole[p], -1) for p in patterns}
    if not partial:
        return Mix(uses)
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted(partial.items()), "pattern string, rest long"))
    bucketed = slim.join(wanted, "pattern").withColumn("bucket", F.shiftright("place", LOW_BITS).cast("int"))
    running = Window.partitionBy("pattern").orderBy("bucket")
    sums = bucketed.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running))
    cut = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    cuts = F.broadcast(cut.select("pattern", "bucket", (F.col("upto") - F.col("words")).alias("before")))
    within = Window.partitionBy("pattern").orderBy("place")
    places = (
        bucketed.join(cuts, ["pattern", "bucket"])
        .groupBy("pattern", "bucket", "rest", "before", "place")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(within))
    )
    nearest = F.col("upto") - F.col("words") / 2 <= F.col("rest")
    last = places.groupBy("pattern").agg(
        F.coalesce(F.max(F.when(nearest, F.col("place"))), F.shiftleft(F.min("bucket").cast("long"), LOW_BITS) - 1).alias("last")
    )
    for r in last.collect():
        uses[r["pattern"]] = (whole[r["pattern"]], r["last"])
    return Mix(uses)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 2) -> tuple[Mix, dict]:
    """The mix of documents that belong to one source each, and (words, target) per source.

    Sources get targets by ``source_targets``. Null texts have no words and are not taken; a null source is a
    source. Rows with one key have one place, so all rows of a key are taken alike. An empty table gives an
    empty mix.
    """
    rows = docs.select(
        F.array(F.col(source).cast("string")).alias("members"), word_count(text).alias("size"), place_of(key, seed).alias("place")
    )
    slim = written(rows, "mix_sizes")
    sizes = {r["s"]: r["n"] for r in slim.groupBy(F.col("members")[0].alias("s")).agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(sizes)
    return plan_mix(slim, targets), {s: (n, targets[s]) for s, n in sizes.items()}


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 2) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    mix, _ = mix_sources(docs, key, text, source, seed)
    uses = mix.uses_of(F.array(F.col(source).cast("string")), place_of(key, seed))
    uses = F.when(word_count(text) > 0, uses).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(True), uses.cast("int")))
    names = docs.columns
    return docs.select(*[F.col(f"`{c}`") for c in names], copies.alias("__copy")).select(*[F.col(f"`{c}`") for c in names])
