"""URL filter: rules first, then a ratio of character models of accepted and rejected URLs.

Both models are variable-order Markov models over the bytes of host and path: the estimate after the
longest context leans on the one after the next shorter context, down to equal shares. A URL's score is the
log-likelihood difference divided by its length, put through a logistic curve fitted to URLs no count has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import mixed, seeded

ORDERS = 6
BITS = 18
WEIGHT = 2.0  # counts that the shorter context stands for
SLICE = 65_536  # bytes of a URL scored at once
_CELLS_AT_ONCE = 500_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def host_of(url: str | Column) -> Column:
    """Lower-cased A-Z after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    rest = _after_scheme(url)
    return F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: dict[str, list[str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does.

    ``rules``: verdict to rules, each a host and a path. Of rules as long as each other a block wins, then the
    first in order.
    """
    ordered = sorted(((rule, verdict) for verdict, own in rules.items() for rule in own), key=lambda x: (-len(x[0]), x[1] != "block", x[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in reversed(ordered):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _cells(data: bytes, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order, cells of the bytes from ``start`` on with their context, and of the context."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + _U(1)
    at = np.arange(start, len(codes))
    gram, context, power = codes[at].copy(), np.zeros(len(at), dtype=np.uint64), np.ones(1, dtype=np.uint64)
    out = []
    for order in range(ORDERS):
        salt = _U(2 * order + 3)
        out.append(
            tuple((mixed(h * _U(64) + s) >> _U(64 - BITS)).astype(np.int64) for h, s in ((gram, salt), (context, salt + _U(1))))
        )
        before = codes[at - 1 - order]
        context = context + before * power
        power = power * _STEP
        gram = gram + before * power
    return out


def _slices(url: str) -> Iterator[tuple[bytes, int]]:
    data = b"\0" * ORDERS + url.encode("utf-8", "replace") + b"\1"
    for i in range(ORDERS, len(data), SLICE):
        yield data[i - ORDERS : i + SLICE], ORDERS


@dataclass
class UrlModel:
    """Counts [class, order, cell] of bytes in context and of contexts; class 1 is rejected."""

    grams: np.ndarray = field(repr=False)
    contexts: np.ndarray = field(repr=False)
    slope: float = 0.0
    offset: float = -1.0  # without examples of both classes all is allowed

    def raw(self, url: str) -> float:
        """Log-likelihood of the rejected model less the accepted one's, per byte."""
        total, length = 0.0, 0
        for data, start in _slices(url):
            rate = np.full((2, len(data) - start), 1 / 256)
            for order, (gram, context) in enumerate(_cells(data, start)):
                rate = (self.grams[:, order][:, gram] + WEIGHT * rate) / (self.contexts[:, order][:, context] + WEIGHT)
            total += float(np.log(rate[1] / rate[0]).sum())
            length += rate.shape[1]
        return total / length

    def score(self, url: str) -> float:
        """The probability of a rejected URL."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(url) + self.offset, -50, 50))))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cell, n) once per task."""
    sums = np.zeros((2, 2, ORDERS, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for url, rejected in zip(batch.url, batch.rejected, strict=True):
            for data, start in _slices(url):
                for order, (gram, context) in enumerate(_cells(data, start)):
                    np.add.at(sums[rejected, 0, order], gram, 1)
                    np.add.at(sums[rejected, 1, order], context, 1)
    at = np.flatnonzero(sums)
    for i in range(0, len(at), _CELLS_AT_ONCE):
        some = at[i : i + _CELLS_AT_ONCE]
        yield pd.DataFrame({"cell": some, "n": sums.reshape(-1)[some]})


def fit(urls: DataFrame) -> UrlModel:
    """Learn from all different rows (url, rejected 0 or 1).

    A fifth of them, by a seeded hash, calibrates, the others are counted. The driver receives counts by cell, at most
    ``4 * ORDERS * 2**BITS``, and the calibrating scores. Null URLs are left out; without both classes all is allowed.
    """
    distinct = urls.where(F.col("url").isNotNull()).select("url", F.col("rejected").cast("int").alias("rejected")).distinct()
    sizes = {r["rejected"]: r["n"] for r in distinct.groupBy("rejected").agg(F.count("*").alias("n")).collect()}
    ruled = distinct.withColumn("fifth", F.pmod(seeded(7, F.col("url")), F.lit(5)) == 0)
    if set(sizes) != {0, 1}:
        empty = np.zeros((2, ORDERS, 1 << BITS), dtype=np.float32)
        return UrlModel(empty, empty)
    counts = (
        ruled.where(~F.col("fifth")).select("url", "rejected").mapInPandas(_count, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
        .withColumn("cell", F.col("cell").cast("int")).toArrow()
    )
    sums = np.zeros(4 * ORDERS << BITS, dtype=np.float32)
    sums[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    sums = sums.reshape(2, 2, ORDERS, 1 << BITS)
    model = UrlModel(sums[:, 0], sums[:, 1], 1.0, 0.0)
    shared = urls.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.raw).astype(float)

    rows = ruled.where("fifth").select("rejected", F.round(raw("url"), 3).alias("raw"))
    curve = rows.groupBy("raw").agg(F.sum("rejected").alias("bad"), F.count("*").alias("n")).toPandas().astype(float)
    model.slope, model.offset = balanced_logistic(curve.raw.to_numpy(), curve.bad.to_numpy(), (curve.n - curve.bad).to_numpy())
    return model


def balanced_logistic(score: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighing the same; 1 and 0 if one has no rows."""
    if bad.sum() == 0 or good.sum() == 0:
        return 1.0, 0.0
    bad, good = bad / bad.sum(), good / good.sum()
    design, theta = np.stack([score, np.ones(len(score))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (bad * (1 - p) - good * p) - 1e-4 * theta
        hessian = (design * ((bad + good) * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, gradient)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def judge(pages: DataFrame, rules: dict[str, list[str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    The rules' URLs train the models. A URL that no rule fits is blocked where the model's probability of a
    rejected one is at least 0.5. Null URLs and those without ``://`` have an empty host and path; an empty pair
    is judged like any other text. Repeated rows are repeated; other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("url"))
    model = fit(ruled.where(F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "block").cast("int").alias("rejected")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(shared.value.score).astype(float)

    scored = ruled.withColumn("score", rejected("url"))
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
