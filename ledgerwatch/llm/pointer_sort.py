"""Words as pointers into Arrow buffers, ordered by multikey quicksort; equal words are runs of pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerwatch.llm.common import POWERS, mixed

SLICE_BYTES = 16 << 20  # text that is sorted at once; a longer single text is one slice
_PAD = 8
_DEEP = 16  # steps of 7 bytes after which the rest of a word is compared as a whole

_U = np.uint64
_MASKS = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(1, 8)], dtype=_U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, padded, and the offsets of its values; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[at : at + len(column) + 1]
    data = column.buffers()[2]
    raw = np.zeros(int(offsets[-1] - offsets[0]) + _PAD if len(offsets) else _PAD, dtype=np.uint8)
    if data is not None and len(offsets):
        raw[: -_PAD] = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, (offsets - offsets[0]) if len(offsets) else np.zeros(1, dtype=np.int64)


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2]


def cut_runs(starts: np.ndarray, lengths: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that go on over the end of a text are cut there."""
    if not len(starts):
        return starts, lengths
    ends = starts + lengths
    at = np.searchsorted(starts, cuts, side="right") - 1
    within = np.unique(cuts[(at >= 0) & (cuts > starts[at]) & (cuts < ends[at])])
    starts, ends = np.sort(np.concatenate([starts, within])), np.sort(np.concatenate([ends, within]))
    return starts, ends - starts


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Batches put together until they hold ``size`` bytes of text; the rest comes last. Empty batches give nothing."""
    held, held_bytes = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            held_bytes += batch.column(text).nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _characters(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Seven bytes of each word from 7 * depth on, and below them how many bytes remain (8: more than seven)."""
    left = np.minimum(lengths - 7 * depth, 8)
    words = np.ndarray(shape=(len(raw) - _PAD + 1,), dtype=">u8", buffer=raw, strides=(1,))
    return (words[starts + 7 * depth].astype(_U) & _MASKS[np.minimum(left, 7)]) | left.astype(_U)


def sort_pointers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by their bytes, and in that order the number of each word's run of equal words.

    Equal words keep the order they have.

    Multikey quicksort whose characters are seven bytes: a slice is put in order by one character; only
    stretches that agree in it and go on move to the next. Words that agree for 112 bytes are compared whole.
    """
    n = len(starts)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.arange(n)
    fresh = np.zeros(n, dtype=bool)  # where a run of equal words begins
    fresh[0] = True
    open_at = np.arange(n)  # places in the order that are not yet settled, in stretches
    stretch = np.zeros(n, dtype=np.int64)
    for depth in range(_DEEP + 1):
        who = order[open_at]
        if depth < _DEEP:
            key = _characters(raw, starts[who], lengths[who], depth)
        else:
            key = _whole(raw, starts[who] + 7 * depth, lengths[who] - 7 * depth)
        by = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, stretch))
        order[open_at], key = who[by], key[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])  # stretches are in order already
        fresh[open_at[new]] = True
        if depth == _DEEP:
            break
        run = np.cumsum(new) - 1
        go_on = ((key & _U(0xFF)) == 8) & (np.bincount(run)[run] > 1)
        open_at, stretch = open_at[go_on], run[go_on]
        if not len(open_at):
            break
    return order, np.cumsum(fresh) - 1


def _whole(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of byte strings among the different ones in order."""
    found = [raw[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
    place = {x: i for i, x in enumerate(sorted(set(found)))}
    return np.array([place[x] for x in found], dtype=_U)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    upto = np.cumsum(lengths)
    out = np.zeros(len(starts), dtype=_U)
    some = lengths > 0
    if some.any():
        place = np.arange(upto[-1]) - np.repeat(upto - lengths, lengths)
        data = raw[place + np.repeat(starts, lengths)].astype(_U) + _U(1)
        out[some] = np.add.reduceat(data * POWERS[place & 0xFFFF], (upto - lengths)[some])
    return mixed(out + lengths.astype(_U) * POWERS[1])


def gathered(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column of the given stretches of bytes."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[place].tobytes()))
    return found.cast(pa.string())
