"""Connected components of a graph of links, each named by its least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.workspace import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``links``.

    Each round a node takes the least root among its own and its neighbours', then that root's root. Every
    round is written, so a lost executor costs a re-read; a node's links combine before they shuffle.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        links.select(F.col(b).alias("node"), F.col(a).alias("other"))
    )
    both = written(both.where(F.col("node") != F.col("other")).distinct(), "links")
    roots = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        reached = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("far")), "other")
        least = reached.groupBy("node").agg(F.min("far").alias("far"))
        near = roots.join(least, "node").select("node", "root", F.least("root", "far").alias("next"))
        jumps = roots.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        after = near.join(jumps, "next", "left").select("node", "root", F.least("next", F.coalesce("jump", "next")).alias("next"))
        after = written(after, "roots")
        if after.where(F.col("root") != F.col("next")).limit(1).count() == 0:
            return after.select("node", F.col("next").alias("root"))
        roots = after.select("node", F.col("next").alias("root"))
