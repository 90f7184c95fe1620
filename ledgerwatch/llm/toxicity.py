"""Toxicity by class-conditional Kneser-Ney models: how much likelier the toxic model finds a text.

Three levels, each discounted towards what the next one expects:

* a word after the word before it, by the number of rows that say so;
* the word alone, by the number of different words before it;
* letters: bytes of a word after up to three bytes before them, by the same number.

Words and their pairs are kept by 64-bit hash, counted in all rows that are learned from, and discounted by
``DISCOUNT`` and ``slack`` of the expectation; what occurs ``DISCOUNT`` times at most says what the next level says.
Letters are counted in like amounts of text of both classes and have a discount of ``spread`` standard
deviations besides. The score is the sum of the log ratios over the words, divided by the root of their number
and calibrated on rows no count has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm.common import joined_small, learned_from, mixed, seeded, small_batches
from ledgerwatch.workspace import written

WORD = re.compile(r"[^\W_]{1,64}")
ORDERS = 4
BITS = 19  # of the index into each table of counts, which bounds the model
PRIOR = 5.0
DISCOUNT = 3
CACHE = 150_000  # words whose log ratio a worker remembers
NEW_WORDS = 4_000  # words whose letters are looked up at once
AT_ONCE = 50_000  # words that are scored at once, or those of one text

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_cells(words: list[str]) -> np.ndarray:
    return (word_hashes(words) >> _U(64 - BITS)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits for each word after another, from the hashes of both."""
    return mixed(before * _STEP + word)


def letter_cells(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the table cells of every byte with its context and of the context; the word of each byte."""
    pad = b"\0" * ORDERS
    raw = np.frombuffer(pad + pad.join(w.encode("utf-8", "replace") + b"\1" for w in words), dtype=np.uint8)
    codes = raw.astype(np.uint64) + _U(1)
    at = np.flatnonzero(raw)
    ends = raw[at] == 1
    owner = np.cumsum(ends) - ends
    gram, context, power = codes[at].copy(), np.zeros(len(at), dtype=np.uint64), np.ones(1, dtype=np.uint64)
    cells = []
    for order in range(ORDERS):
        salt = _U(2 * order + 3)
        cells.append(
            tuple((mixed(h * _U(64) + s) >> _U(64 - BITS)).astype(np.int64) for h, s in ((gram, salt), (context, salt + _U(1))))
        )
        before = codes[at - 1 - order] * power
        context = context + before
        power = power * _STEP
        gram = gram + codes[at - 1 - order] * power
    return cells, owner


def _moved(count: np.ndarray, expected: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The count moved towards what is expected, at most as far as that."""
    return np.where(count > expected + room, count - room, np.where(count < expected - room, count + room, expected))


def _log_ratios(counts: np.ndarray, shares: np.ndarray, lower: np.ndarray, slack: float) -> np.ndarray:
    """Log ratios from counts [class, n]: the ``lower`` ones where the counts say no more.

    ``shares`` [class, n]: how the classes would share the counts of an ordinary expression.
    """
    chance = shares * np.stack([np.exp(-lower / 2), np.exp(lower / 2)])
    expected = counts.sum(0) * chance / chance.sum(0)
    kept = (_moved(counts, expected, DISCOUNT + slack * expected) + chance) / shares
    return np.log(kept[1] / kept[0])


@dataclass
class Counts:
    """Counts [class, n] and the classes' shares [class, n] of expressions with sorted 64-bit hashes."""

    keys: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    shares: np.ndarray = field(repr=False)

    def refine(self, hashes: np.ndarray, lower: np.ndarray, slack: float) -> np.ndarray:
        """``lower`` with the log ratios of the hashes that are known."""
        if not len(self.keys):
            return lower
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == hashes)
        out, at = lower.copy(), at[known]
        out[known] = _log_ratios(self.counts[:, at], self.shares[:, at], lower[known], slack)
        return out


@dataclass
class Ratios:
    """Log ratios of expressions with sorted 64-bit hashes."""

    keys: np.ndarray = field(repr=False)
    ratios: np.ndarray = field(repr=False)

    def refine(self, hashes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """``lower`` with the log ratios of the hashes that are known."""
        if not len(self.keys):
            return lower
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ratios[at], lower)


NO_RATIOS = Ratios(np.empty(0, dtype=np.uint64), np.empty(0))


@dataclass
class UsedCells:
    """Tables of counts [class, cell] with those cells only that have any: (sorted cells, counts [class, n + 1], the last 0).

    A table more than half full is kept as it is, without a list of cells.
    """

    tables: list[tuple[np.ndarray | None, np.ndarray]] = field(repr=False)

    @classmethod
    def of(cls, counts: np.ndarray) -> UsedCells:
        """From counts [class, order, cell]."""
        tables: list[tuple[np.ndarray | None, np.ndarray]] = []
        for table in np.moveaxis(counts, 1, 0):
            used = np.flatnonzero(table.any(axis=0)).astype(np.int32)
            if 2 * len(used) > table.shape[1]:
                tables.append((None, table))
            else:
                tables.append((used, np.pad(table[:, used], ((0, 0), (0, 1)))))
        return cls(tables)

    def at(self, order: int, cells: np.ndarray) -> np.ndarray:
        used, counts = self.tables[order]
        if used is None:
            return counts[:, cells]
        cells = cells.astype(np.int32)
        at = np.searchsorted(used, cells)  # beyond the last cell: the place of the 0
        known = np.append(used, -1)[at] == cells
        return counts[:, np.where(known, at, len(used))]


def _counts_at(tables: np.ndarray | UsedCells, order: int, cells: np.ndarray) -> np.ndarray:
    found = tables.at(order, cells) if isinstance(tables, UsedCells) else tables[:, order][:, cells]
    return found.astype(float)


@dataclass
class ToxicityModel:
    """Class 1 is toxic. ``vocabulary`` holds the words that occur more than ``DISCOUNT`` times in all learned rows.

    ``pairs`` holds the log ratios of those pairs that say something else than their second word alone; to leave
    out the others changes no score. Counts by cell in like amounts of both classes: ``grams`` and ``contexts`` [class, order, cell] for the letters,
    without the empty cells in the tasks, ``words`` [class, cell] and their ``totals`` for comparison.
    """

    grams: np.ndarray | UsedCells = field(repr=False)
    contexts: np.ndarray | UsedCells = field(repr=False)
    words: np.ndarray = field(repr=False)
    totals: np.ndarray
    vocabulary: Counts
    pairs: Ratios
    spread: float
    slack: float
    slope: float = 1.0
    offset: float = 0.0

    def letter_ratios(self, words: list[str]) -> np.ndarray:
        cells, owner = letter_cells(words)
        shared = np.full(len(owner), 1 / 256)
        rates = np.stack([shared, shared])
        for order, (gram, context) in enumerate(cells):
            counts = _counts_at(self.grams, order, gram)
            totals = _counts_at(self.contexts, order, context)
            pooled = (counts.sum(0) + 2 * shared) / (totals.sum(0) + 2)
            base = rates * (pooled / shared)
            expected = totals * base
            room = self.spread * np.sqrt(expected + 1) + self.slack * expected
            rates = (_moved(counts, expected, room) + PRIOR * base) / (totals + PRIOR)
            shared = pooled
        return np.bincount(owner, weights=np.log(rates[1] / rates[0]), minlength=len(words))

    def known_words(self) -> KnownWords:
        """The words that this process has seen with this model, kept as long as the model is."""
        if not hasattr(self, "_known"):
            self._known = KnownWords(self)
        return self._known

    def raw_scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        found: list[tuple[int, list[str]]] = []
        waiting = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                found.append((i, words))
                waiting += len(words)
            if waiting > AT_ONCE:
                self._score(found, out)
                found, waiting = [], 0
        if found:
            self._score(found, out)
        return out

    def _score(self, found: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        sizes = np.array([len(words) for _, words in found])
        starts = np.cumsum(sizes) - sizes
        hashes, ratios = self.known_words().of([w for _, words in found for w in words])
        before = np.concatenate([NO_WORD, hashes[:-1]])
        before[starts] = NO_WORD
        sums = np.add.reduceat(self.pairs.refine(pair_hashes(before, hashes), ratios), starts)
        out[[i for i, _ in found]] = sums / np.sqrt(sizes)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -50, 50)))


class KnownWords:
    """Hashes and log ratios of the words seen lately."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.hashes = np.empty(1024, dtype=np.uint64)
        self.ratios = np.empty(1024)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > CACHE:
            self._clear()
        new = list(set(words).difference(self.places))
        if new:
            n, end = len(self.places), len(self.places) + len(new)
            if end > len(self.hashes):
                self.hashes, self.ratios = (np.concatenate([x[:n], np.empty(2 * end - n, dtype=x.dtype)]) for x in (self.hashes, self.ratios))
            hashes = word_hashes(new)
            self.hashes[n:end] = hashes
            letters = np.concatenate([self.model.letter_ratios(new[i : i + NEW_WORDS]) for i in range(0, len(new), NEW_WORDS)])
            self.ratios[n:end] = self.model.vocabulary.refine(hashes, letters, self.model.slack)
            self.places.update(zip(new, range(n, end), strict=True))
        at = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        return self.hashes[at], self.ratios[at]


NO_WORD = word_hashes([""])
FREQUENT = f"ordinary + toxic > {DISCOUNT}"
SAME = 1e-9  # log ratios that differ by rounding only


def _pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, toxic, hash of the word before, rows, whether in a row that balances the classes) once per batch."""
    for batch in batches:
        for toxic in (0, 1):
            own = batch[batch.toxic == toxic]
            found = [(words, used) for words, used in zip(map(words_of, own.text), own.balanced, strict=True) if words]
            if found:
                yield _pair_rows([words for words, _ in found], np.array([bool(used) for _, used in found])).assign(toxic=toxic)


def _pair_rows(texts: list[list[str]], used: np.ndarray) -> pd.DataFrame:
    places = {"": 0}
    sizes = np.array([len(words) for words in texts])
    word = np.fromiter((places.setdefault(w, len(places)) for words in texts for w in words), dtype=np.int64, count=sizes.sum())
    before = np.concatenate([[0], word[:-1]])
    before[np.cumsum(sizes) - sizes] = 0
    row = np.repeat(np.arange(len(texts)), sizes)
    uses = np.unique((before * len(places) + word) * len(texts) + row)  # a pair once a row
    pair, row = np.divmod(uses, len(texts))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    before, word = np.divmod(pair[first], len(places))
    names = np.array(list(places), dtype=object)
    return pd.DataFrame(
        {
            "word": names[word],
            "before": word_hashes(names.tolist()).view(np.int64)[before],
            "n": np.diff(first, append=len(pair)),
            "balanced": np.logical_or.reduceat(used[row], first),
        }
    )


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ordinary, toxic) by the key of the word."""
    for batch in batches:
        keys = word_hashes(batch.word.tolist())
        yield pd.DataFrame({"key": keys.view(np.int64), "ordinary": batch.ordinary, "toxic": batch.toxic})


def _vocabulary(words: DataFrame) -> Counts:
    """The words that occur more than ``DISCOUNT`` times; the shares are those of all words."""
    found = words.where(FREQUENT).select("word", "ordinary", "toxic").mapInPandas(_hashed, "key long, ordinary long, toxic long").toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = np.stack([found[c].to_numpy()[order].astype(np.float32) for c in ("ordinary", "toxic")])
    return Counts(keys[order], counts, np.broadcast_to(_all_shares(words).astype(np.float32), counts.shape))


def _all_shares(rows: DataFrame) -> np.ndarray:
    """How the classes share all counts, [class, 1]."""
    sums = np.array([x or 0 for x in rows.agg(F.sum("ordinary"), F.sum("toxic")).first()], dtype=float)
    return ((sums + 1) / (sums + 1).sum())[:, None]


def _pair_ratios(model: ToxicityModel, uses: DataFrame) -> Ratios:
    """What a word says after another, where that is not what it says alone.

    Worked out in the tasks from the pairs that occur more than ``DISCOUNT`` times. A pair's shares are those of its
    first word, and lean on those of all pairs where that word is rare.
    """
    starts = uses.groupBy("before").agg(F.sum("ordinary").alias("from_ordinary"), F.sum("toxic").alias("from_toxic"))
    rows = uses.where(FREQUENT).select("word", "before", "ordinary", "toxic").join(starts, "before")
    prior = PRIOR * _all_shares(uses)
    shared = uses.sparkSession.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, slack = shared.value.known_words(), shared.value.slack
        for batch in batches:
            hashes, alone = known.of(batch.word.tolist())
            shares = np.stack([batch.from_ordinary, batch.from_toxic]).astype(float) + prior
            counts = np.stack([batch.ordinary, batch.toxic]).astype(float)
            said = _log_ratios(counts, shares / shares.sum(0), alone, slack)
            keys = pair_hashes(batch.before.to_numpy().view(np.uint64), hashes)
            yield pd.DataFrame({"key": keys.view(np.int64), "ratio": said})[np.abs(said - alone) > SAME]

    found = rows.mapInPandas(ratios, "key long, ratio double").toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Ratios(keys[order], found["ratio"].to_numpy()[order])


def _cell_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by cell: table 0 to 3 grams by order, 4 to 7 contexts, 8 words."""
    for batch in batches:
        words = batch.word.tolist()
        cells, owner = letter_cells(words)
        plain, toxic = batch.ordinary.to_numpy(float), batch.toxic.to_numpy(float)
        parts = [(i, g, plain[owner], toxic[owner]) for i, (g, _) in enumerate(cells)]
        parts += [(ORDERS + i, c, plain[owner], toxic[owner]) for i, (_, c) in enumerate(cells)]
        parts.append((2 * ORDERS, word_cells(words), plain, toxic))
        for which, cell, a, b in parts:
            found, inverse = np.unique(cell, return_inverse=True)
            yield pd.DataFrame(
                {
                    "which": which,
                    "cell": found,
                    "ordinary": np.bincount(inverse, weights=a),
                    "toxic": np.bincount(inverse, weights=b),
                }
            )


def _platt(scores: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts by score; (1, 0) without two classes."""
    if not len(scores) or positives.sum() <= 0 or positives.sum() >= totals.sum():
        return 1.0, 0.0
    design = np.stack([scores, np.ones(len(scores))], axis=1)
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (positives - totals * p) - 1e-3 * theta
        hessian = (design * (totals * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(key, text, toxic) of the rows a model may learn from; several labels of a key: toxic if one says so."""
    marks = (
        labels.where(learned_from(key) & F.col(toxic).isin(0, 1))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(toxic).cast("int").alias("toxic"))
    )
    rows = docs.where(learned_from(key) & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return joined_small(rows, marks, "key")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    spread: float = 3.0,
    slack: float = 0.3,
) -> ToxicityModel:
    """Learn from all labelled rows, less a fifth of both classes for the calibration.

    Words and pairs are counted in all of them and compared with the classes' shares. For the letters the larger
    class is thinned by a seeded hash of the key, so that both have their counts from like amounts of text. Null
    texts and labels other than 0 and 1 are left out; repeated rows count as often as they occur, several labels of
    a key as toxic if one says so. The driver receives counts by cell, at most nine tables of ``2**BITS`` cells, the
    counts of all words that occur more than ``DISCOUNT`` times and the log ratios of those pairs that say something
    else than their second word, which both grow with the learned text, and scores rounded to a hundredth.
    Without rows of both classes, as in empty tables, every ratio is 1 and every score 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = (
        labels.where(learned_from(key) & F.col(toxic).isin(0, 1))
        .groupBy(F.col(key).alias(key))
        .agg(F.max(toxic).cast("int").alias(toxic))
    )
    h = seeded(6, F.col(key))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy(F.col(toxic).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    keep = min(1.0, sizes.get(1, 0) / sizes[0]) if sizes.get(0) else 0.0
    kept_toxic = min(1.0, sizes.get(0, 0) / sizes[1]) if sizes.get(1) else 0.0
    shares = F.when(F.col("toxic") == 1, F.lit(kept_toxic)).otherwise(F.lit(keep))
    used = F.pmod(F.shiftright(seeded(6, F.col("key")), 20), F.lit(1 << 20)) < shares * (1 << 20)
    fifth = F.pmod(h, F.lit(5)) == 0
    rows = labelled(docs, marks.where(~fifth), key, text, toxic).select("text", "toxic", used.alias("balanced"))
    uses = written(
        rows.mapInPandas(_pairs_of, "word string, toxic int, before long, n long, balanced boolean")
        .groupBy("before", "word")
        .agg(*(F.sum(F.when(F.col("toxic") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(("ordinary", "toxic"))),
             *(F.max((F.col("toxic") == i) & F.col("balanced")).alias(name) for i, name in enumerate(("like_ordinary", "like_toxic")))),
        "toxic_pairs",
    )
    words = written(
        uses.groupBy("word").agg(
            F.count_if(F.col("ordinary") > 0).alias("ordinary"), F.count_if(F.col("toxic") > 0).alias("toxic"),
            F.count_if("like_ordinary").alias("like_ordinary"), F.count_if("like_toxic").alias("like_toxic"),
        ),
        "toxic_words",
    )
    like = words.select("word", F.col("like_ordinary").alias("ordinary"), F.col("like_toxic").alias("toxic"))
    cells = (
        like.where(F.col("ordinary") + F.col("toxic") > 0).mapInPandas(_cell_sums, "which int, cell long, ordinary double, toxic double")
        .groupBy("which", "cell")
        .agg(F.sum("ordinary").cast("float").alias("ordinary"), F.sum("toxic").cast("float").alias("toxic"))
        .withColumn("cell", F.col("cell").cast("int"))
        .toArrow()
    )
    which, cell = cells["which"].to_numpy(), cells["cell"].to_numpy()
    tables = np.zeros((2, 2 * ORDERS + 1, 1 << BITS), dtype=np.float32)
    tables[0, which, cell] = cells["ordinary"].to_numpy()
    tables[1, which, cell] = cells["toxic"].to_numpy()
    counts = tables[:, 2 * ORDERS]
    totals = counts.sum(axis=1, dtype=np.float64)
    model = ToxicityModel(tables[:, :ORDERS], tables[:, ORDERS : 2 * ORDERS], counts, totals, _vocabulary(words), NO_RATIOS, spread, slack)
    if not totals.all():
        model.slope = 0.0
        return model
    model.pairs = _pair_ratios(_for_scores(model), uses)
    curve = (
        labelled(docs, marks.where(fifth), key, text, toxic)
        .select("toxic", F.round(raw_score(spark, model, "text"), 2).alias("raw"))
        .groupBy("raw")
        .agg(F.sum("toxic").alias("positives"), F.count("*").alias("n"))
        .toArrow()
    )
    model.slope, model.offset = _platt(
        curve["raw"].to_numpy().astype(float), curve["positives"].to_numpy().astype(float), curve["n"].to_numpy().astype(float)
    )
    return model


def _for_scores(model: ToxicityModel) -> ToxicityModel:
    """What the tasks need of a model: each worker holds one, so without the cells that have no counts."""
    grams, contexts = (UsedCells.of(x) if isinstance(x, np.ndarray) else x for x in (model.grams, model.contexts))
    return replace(model, grams=grams, contexts=contexts, words=np.empty((2, 0)))


def raw_score(spark: SparkSession, model: ToxicityModel, text: str | Column) -> Column:
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_for_scores(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.raw_scores(texts.tolist()))

    return score(F.col(text) if isinstance(text, str) else text)


def toxicity(spark: SparkSession, model: ToxicityModel, text: str | Column) -> Column:
    """The probability that each whole text is toxic; null, empty and wordless texts score as one without evidence.

    Equal texts score alike; a table without rows has no scores.
    """
    raw = raw_score(spark, model, text)
    line = F.least(F.greatest(raw * model.slope + model.offset, F.lit(-50.0)), F.lit(50.0))
    return 1 / (1 + F.exp(-line))
