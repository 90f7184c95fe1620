"""What the operators of this subpackage share: folds, seeded hashes, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 20  # longest stretch of a text that is hashed at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.concatenate([[_U(1)], np.full(65535, _BASE, dtype=np.uint64)]), dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


BATCH_ROWS = 500  # whole texts that a Python worker gets at once
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows here are whole texts: unless the session says otherwise, hand workers 500 and not 10,000 at once."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


# of the C library: arrays of a megabyte go back to the system when freed, and threads share two arenas; Arrow uses it too
LEAN = {
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(4 << 20),
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def lean_workers(spark: SparkSession) -> None:
    """Python workers that keep little of what they have freed, for jobs of many stages; settings made elsewhere stay."""
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str | Column) -> Column:
    """Rows no model learns from: crc32 of the key as text leaves 1 when divided by 3. Null keys: false."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_from(key: str | Column) -> Column:
    """Rows a model may learn from: those with a key outside the held-out fold."""
    key = F.col(key) if isinstance(key, str) else key
    return key.isNotNull() & ~held_out(key)


def seeded(seed: int, *columns: Column) -> Column:
    """A 64-bit hash that a rerun repeats."""
    return F.xxhash64(F.lit(seed), *columns)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _segments(data: bytes) -> Iterator[bytes]:
    """Cut at the last space of each megabyte; a word longer than that counts as several."""
    at = 0
    while len(data) - at > SEGMENT:
        cut = data.rfind(b" ", at + SEGMENT // 2, at + SEGMENT)
        cut = at + SEGMENT if cut < 0 else cut
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the lower-cased text, in order.

    A word is a run of ASCII letters, digits and characters beyond ASCII.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    data = text.lower().encode("utf-8", "replace")
    if len(data) <= SEGMENT:
        return _hash_words(data)
    return np.concatenate([_hash_words(part) for part in _segments(data)])


def _hash_words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = _WORD[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    lengths = edges[1::2] - edges[::2]
    starts = np.cumsum(lengths) - lengths
    letters = raw[inside].astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((letters + _U(1)) * POWERS[place & 0xFFFF], starts)
    return mixed(sums + lengths.astype(np.uint64) * _BASE)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash per run of ``width`` words; a shorter text is one run, a text without words none."""
    if len(words) < width:
        return mixed(_fold(words[:, None].T)) if len(words) else words
    runs = len(words) - width + 1
    return mixed(_fold(np.stack([words[i : i + runs] for i in range(width)], axis=1)))


def _fold(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for i in range(rows.shape[1]):
        out = out * _U(0xD6E8FEB86659FD93) + rows[:, i]
    return out


def joined_small(rows: DataFrame, small: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """Inner join on ``key``; ``small`` is broadcast if it has at most ``limit`` rows (counted), else both shuffle."""
    small = F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
    return rows.join(small, key)
