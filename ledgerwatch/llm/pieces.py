"""SentencePiece encoding and decoding with a given model; giant texts by a parallel max-plus scan.

An encoding is a best path over piece ends. A state is where a piece ends and which piece it is; a step adds
a weight. Unigram models weigh a piece by its score. Pair-merging models allow a step where merging the two
pieces' letters gives just these two (weight 0, else minus infinity): such a path is unique and is the
merged encoding of every beginning of the text.

A giant text is cut into chunks. Each chunk gives a transfer matrix from the pieces that may cross its start
to those that may cross its end; matrices are combined by the max-plus product, first within blocks of
chunks, then over blocks; that fixes the states at every cut, and each chunk is traced back by itself.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import small_batches
from ledgerwatch.workspace import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
START = -1  # the piece before the first, and one that nothing can depend on any more
CHUNK = 65_536
SLICE = 100  # texts whose ids leave a worker at once
BLOCK = 64  # chunks whose matrices are combined at once
CACHE = 350_000  # units whose ids a worker remembers, and pairs of pieces

_LETTER = re.compile(r"[^\W\d_]")

Matrix = dict[tuple[int, int], dict[tuple[int, int], float]]  # entry state to exit state to weight


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """Pieces with scores. ``kind``: ``bpe`` or ``unigram``."""

    texts: list[str]
    scores: list[float] = field(repr=False)
    kind: str = "bpe"
    special: frozenset[int] = frozenset()  # ids that no text gives
    byte_ids: tuple[int, ...] = ()  # of the 256 bytes, for letters without a piece; empty: none
    unknown: int = 0
    prefix_space: bool = True
    trim_spaces: bool = False

    @classmethod
    def read(cls, path: str = MODEL) -> Pieces:
        """From a model file; its normalisation must be the identity but for spaces."""
        texts, scores, types, made = [], [], [], {"kind": "unigram"}
        for key, value in _fields(Path(path).read_bytes()):
            if key == 1:
                piece = dict(_fields(value))
                texts.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                types.append(piece.get(3, 1))
            elif key == 2:
                made["kind"] = {1: "unigram", 2: "bpe"}[dict(_fields(value)).get(3, 1)]
            elif key == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("a model with character rules is not supported")
                made |= {"prefix_space": bool(rules.get(3, 1)), "trim_spaces": bool(rules.get(4, 1))}
        if set(types) - {1, 2, 3, 6}:
            raise ValueError("a model with pieces of the user's own or unused ones is not supported")
        special = frozenset(i for i, kind in enumerate(types) if kind != 1)
        byte_ids = {int(texts[i][1:-1], 16): i for i, kind in enumerate(types) if kind == 6}
        made["byte_ids"] = tuple(byte_ids[i] for i in range(256)) if len(byte_ids) == 256 else ()
        return cls(texts, scores, special=special, unknown=types.index(2), **made)

    @cached_property
    def ids(self) -> dict[str, int]:
        """Usable pieces: for a pair-merging model those that merging their own letters gives."""
        found = {x: i for i, x in enumerate(self.texts) if i not in self.special}
        if self.kind == "bpe":
            self.__dict__["_all"] = found
            found = {x: i for x, i in found.items() if self._merged(x) == [x]}
        return found

    @cached_property
    def prefixes(self) -> frozenset[str]:
        return frozenset(x[:n] for x in self.ids for n in range(1, len(x) + 1))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def units(self) -> re.Pattern[str]:
        """Stretches that no piece crosses.

        They end before spaces, and before marks that no piece holds right after a letter but for few letters;
        if a piece crosses spaces, the whole text is one.
        """
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            return re.compile(".+", re.DOTALL)
        before: dict[str, set[str]] = {}
        for text in self.ids:
            for a, b in zip(text, text[1:], strict=False):
                if not b.isalnum() and b not in (SPACE, "_"):
                    before.setdefault(b, set()).update(_LETTER.findall(a))
        joined = set().union(*[found for found in before.values() if len(found) <= 3])
        marks = sorted(b for b, found in before.items() if found <= joined)
        if not marks:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        own = re.escape("".join(marks))
        follows = r"(?<![^\W\d_])" + "".join(f"|(?<={re.escape(c)})" for c in sorted(joined))
        return re.compile(f"{SPACE}*[^{SPACE}][^{SPACE}{own}]*(?:(?:{follows})[{own}][^{SPACE}{own}]*)*|{SPACE}+")

    @cached_property
    def _pairs(self) -> dict[int, bool]:
        return {}

    @cached_property
    def _edges(self) -> dict[tuple[int, bool], list[tuple[str, float]]]:
        return {}

    @cached_property
    def _cache(self) -> _Units:
        return _Units(self)

    def _merged(self, text: str) -> list[str]:
        """Letters merged pair by pair, best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(
                ((-self.scores[self._all[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self._all),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def weight(self, before: int, piece: int) -> float | None:
        """Of a step to ``piece`` after ``before``; None: not allowed. Negative numbers are letters without a piece."""
        if self.kind == "unigram":
            return self.scores[piece] if piece >= 0 else min(self.scores) - 10.0
        if before < 0 or piece < 0:
            return 0.0
        return 0.0 if self.allowed(before, piece) else None

    def allowed(self, before: int, piece: int) -> bool:
        """Whether merging the letters of both pieces gives just these two."""
        known = self._pairs.get(before * len(self.texts) + piece)
        if known is None:
            known = self._stay_apart(before, piece)
            if known is None:
                a, b = self.texts[before], self.texts[piece]
                known = self._merged(a + b) == [a, b]
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            self._pairs[before * len(self.texts) + piece] = known
        return known

    def _edge(self, piece: int, right: bool) -> list[tuple[str, float]]:
        """The parts that stand at one end of the piece while its letters merge, each with when it is formed.

        A part is formed at the worst rank among the merges that lead to it.
        """
        known = self._edges.get((piece, right))
        if known is None:
            parts: list[tuple[str, float]] = [(c, -1.0) for c in self.texts[piece]]
            known = [parts[-1] if right else parts[0]]
            while len(parts) > 1:
                rank, i = min(
                    (-self.scores[self._all[a + b]], i)
                    for i, ((a, _), (b, _)) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self._all
                )
                (a, t), (b, u) = parts[i : i + 2]
                parts[i : i + 2] = [(a + b, max(rank, t, u))]
                at_end = parts[-1] if right else parts[0]
                if at_end[0] != known[-1][0]:
                    known.append(at_end)
            self._edges[piece, right] = known
        return known

    def _stay_apart(self, before: int, piece: int) -> bool | None:
        """Whether no merge crosses the border of two pieces; None where two merges are due at once."""
        left, right = self._edge(before, True), self._edge(piece, False)
        i = j = 0
        while True:
            (a, formed), (b, formed2) = left[i], right[j]
            grows = left[i + 1][1] if i + 1 < len(left) else np.inf
            grows2 = right[j + 1][1] if j + 1 < len(right) else np.inf
            crossing = self._all.get(a + b)
            if crossing is not None:
                due = max(-self.scores[crossing], formed, formed2)
                if due < grows and due < grows2:
                    return False
                if due in (grows, grows2):
                    return None
            if grows == grows2:
                return True if grows == np.inf else None
            if grows < grows2:
                i += 1
            else:
                j += 1

    def matches(self, text: str, at: int) -> Iterator[int]:
        """Pieces that begin at ``at``; a letter without a piece counts as one, numbered below ``START``."""
        ids, prefixes = self.ids, self.prefixes
        if text[at] not in ids:
            yield -2 - ord(text[at])
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in prefixes:
                return
            if part in ids:
                yield ids[part]

    def size(self, piece: int) -> int:
        return len(self.texts[piece]) if piece >= 0 else 1

    def walk(self, text: str, at: int, before: int, stop: int) -> dict[tuple[int, int], tuple[float, tuple[int, int] | None]]:
        """Best weight and state before of every state reached from (at, before) by pieces that begin before ``stop``."""
        reached: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {(at, before): (0.0, None)}
        best: dict[int, tuple[int, int]] = {at: (at, before)}
        for here in range(at, stop):
            state = best.get(here)
            if state is None:
                continue
            so_far = reached[state][0]
            for piece in self.matches(text, here):
                step = self.weight(state[1], piece)
                if step is None:
                    continue
                end, total = here + self.size(piece), so_far + step
                found = (end, piece)
                if found not in reached or total > reached[found][0]:
                    reached[found] = (total, state)
                if end not in best or reached[found][0] > reached[best[end]][0]:
                    best[end] = found
        return reached

    def path(self, reached: dict, end: tuple[int, int]) -> list[int]:
        out, state = [], end
        while reached[state][1] is not None:
            out.append(state[1])
            state = reached[state][1]
        return out[::-1]

    def unit_pieces(self, unit: str) -> list[int]:
        if self.kind == "bpe":
            return self._only_path(unit)
        reached = self.walk(unit, 0, START, len(unit))
        best = max((v[0], k) for k, v in reached.items() if k[0] == len(unit))
        return self.path(reached, best[1])

    def _only_path(self, unit: str) -> list[int]:
        """The path of ``walk`` over a whole unit where all weights are 0: longest pieces first, back from dead ends.

        At most one path reaches a place, so no place is reached twice.
        """
        trie, known, many, size = self.trie, self._pairs.get, len(self.texts), len(unit)
        out: list[int] = []
        came: list[int] = []
        here, before, limit = 0, START, size
        while here < size:
            children, at, piece, end = trie, here, None, here
            while at < limit:
                node = children.get(unit[at])
                if node is None:
                    break
                found, children = node
                at += 1
                if found is not None:
                    piece, end = found, at
            if piece is None:
                if limit > here and unit[here] not in self.ids:
                    piece, end = -2 - ord(unit[here]), here + 1
                else:  # nothing shorter is left: the piece before ends elsewhere
                    limit = here - 1
                    here = came.pop()
                    out.pop()
                    before = out[-1] if out else START
                    continue
            if before >= 0 and piece >= 0:
                allowed = known(before * many + piece)
                if allowed is None:
                    allowed = self.allowed(before, piece)
                if not allowed:
                    limit = end - 1
                    continue
            came.append(here)
            out.append(piece)
            here, before, limit = end, piece, size
        return out

    @cached_property
    def trie(self) -> dict:
        """Pieces letter by letter: the id of the piece that ends there, or None, and what follows."""
        pieces: dict[str, int] = self.ids
        children: dict[str, dict] = {"": {}}
        for text in sorted(self.prefixes, key=len):
            children[text] = {}
            children[text[:-1]][text[-1]] = (pieces.get(text), children[text])
        return children[""]

    def ready(self) -> Pieces:
        """With its tables made and nothing remembered, so that workers get just them with the model."""
        self.__dict__.pop("_cache", None)
        self.__dict__.pop("_pairs", None)
        _ = self.trie, self.prefixes, self.longest, self.units, self._shown
        return self

    def numbers(self, pieces: list[int]) -> bytes:
        """Ids as 32-bit integers; a letter without a piece gives its bytes, or the unknown id."""
        if not pieces or min(pieces) >= 0:
            return array("i", pieces).tobytes()
        out: list[int] = []
        for piece in pieces:
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(-2 - piece).encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def unit_ids(self, text: str) -> list[bytes]:
        """The ids of each unit of a text that begins and ends with units."""
        return [*map(self._cache.__getitem__, self.units.findall(text))]

    def normal(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        if self.trim_spaces:
            text = re.sub(f"{SPACE}+", SPACE, text).strip(SPACE)
        return SPACE + text if self.prefix_space and text else text

    def encode(self, text: str) -> bytes:
        return b"".join(self.unit_ids(self.normal(text)))

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD; special ids say nothing."""
        shown = self._shown
        if len(ids) and self._is_byte[ids].any():
            data = b"".join(
                bytes([self._byte_of[i]]) if i in self._byte_of else shown[i].encode("utf-8", "replace") for i in ids.tolist()
            )
            text = data.decode("utf-8", "replace")
        else:
            text = "".join(map(shown.__getitem__, ids.tolist()))
        return text[1:] if self.prefix_space and text.startswith(" ") else text

    @cached_property
    def _shown(self) -> list[str]:
        return ["" if i in self.special and i != self.unknown else x.replace(SPACE, " ") for i, x in enumerate(self.texts)]

    @cached_property
    def _byte_of(self) -> dict[int, int]:
        return {i: b for b, i in enumerate(self.byte_ids)}

    @cached_property
    def _is_byte(self) -> np.ndarray:
        out = np.zeros(len(self.texts), dtype=bool)
        out[list(self.byte_ids)] = True
        return out

    # chunks

    def _cut(self, text: str, size: int, before: int) -> tuple[int, int]:
        """First and last place in a chunk where a unit begins; -1, -1 without one."""
        starts = [m.start() for m in self.units.finditer(text) if before < m.start() <= size]
        inside = [s for s in starts if s < size]
        return (inside[0], inside[-1]) if inside else (-1, -1)

    def entries(self, text: str, start: int) -> list[tuple[int, int]]:
        """Pieces that may cross or end at ``start`` of ``text``: (letters beyond it, piece)."""
        found = set()
        for at in range(max(0, start - self.longest), start):
            for piece in self.matches(text, at):
                end = at + self.size(piece)
                if end >= start:
                    found.add((end - start, piece))
        return sorted(found)

    def transfer(self, left: str, body: str, right: str) -> Matrix:
        """Weights from each state at the start of ``body`` to each at its end; the neighbours are context."""
        base, size = len(left), len(left) + len(body)
        text = left + body + right
        entries = self.entries(text, base) if left else [(0, START)]
        first, last = self._cut(text, size, base)
        out: Matrix = {}
        if first < 0:
            for over, piece in entries:
                reached = self.walk(text, base + over, piece, size)
                out[over, piece] = self._exits(reached, size)
            return out
        ends = self._exits(self.walk(text, last, START, size), size)
        middle = 0.0
        if self.kind == "unigram":
            for unit in self.units.findall(text[first:last]):
                middle += sum(self.weight(START, p) for p in self.unit_pieces(unit))
        for over, piece in entries:
            head = [v[0] for k, v in self.walk(text, base + over, piece, first).items() if k[0] == first]
            if head:
                out[over, piece] = {k: max(head) + middle + v for k, v in ends.items()}
        return out

    @staticmethod
    def _exits(reached: dict, size: int) -> dict[tuple[int, int], float]:
        return {(k[0] - size, k[1]): v[0] for k, v in reached.items() if k[0] >= size}

    def trace(self, left: str, body: str, right: str, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """Ids of the pieces that begin in ``body`` on the best path between the two states."""
        base, size = len(left), len(left) + len(body)
        text = left + body + right
        end = (size + leave[0], leave[1])
        first, last = self._cut(text, size, base)
        if first < 0:
            return self.numbers(self.path(self.walk(text, base + entry[0], entry[1], size), end))
        head = self.walk(text, base + entry[0], entry[1], first)
        best = max((v[0], k) for k, v in head.items() if k[0] == first)
        parts = [self.numbers(self.path(head, best[1]))]
        parts += self.unit_ids(text[first:last])
        parts.append(self.numbers(self.path(self.walk(text, last, START, size), end)))
        return b"".join(parts)


class _Units(dict):
    """Ids of units met before."""

    def __init__(self, model: Pieces) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        found = self.model.numbers(self.model.unit_pieces(unit))
        if len(unit) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = found
        return found

    def __reduce__(self):
        return _Units, (self.model,)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for entry, row in a.items():
        sums: dict[tuple[int, int], float] = {}
        for middle, weight in row.items():
            for leave, more in b.get(middle, {}).items():
                if weight + more > sums.get(leave, -np.inf):
                    sums[leave] = weight + more
        if sums:
            out[entry] = sums
    return out


def states_between(matrices: list[Matrix], entry: tuple[int, int], leave: tuple[int, int]) -> list[tuple[int, int]]:
    """The states at every cut of the best path through ``matrices``: one more than there are matrices."""
    ahead: list[dict[tuple[int, int], float]] = [{leave: 0.0}]
    for matrix in reversed(matrices):
        best = {}
        for state, row in matrix.items():
            sums = [w + ahead[-1][k] for k, w in row.items() if k in ahead[-1]]
            if sums:
                best[state] = max(sums)
        ahead.append(best)
    ahead.reverse()
    out = [entry]
    for matrix, after in zip(matrices, ahead[1:], strict=True):
        row = matrix[out[-1]]
        out.append(max((w + after[k], k) for k, w in row.items() if k in after)[1])
    return out


def _pack(matrix: Matrix) -> list[list[float]]:
    return [[*entry, *leave, weight] for entry, row in matrix.items() for leave, weight in row.items()]


def _unpack(cells) -> Matrix:
    out: Matrix = {}
    for over, piece, over2, piece2, weight in cells:
        out.setdefault((int(over), int(piece)), {})[int(over2), int(piece2)] = float(weight)
    return out


STATES = "entry_over int, entry_piece int, leave_over int, leave_piece int"


def _sliced(texts: pd.Series) -> Iterator[list[str | None]]:
    """Texts in order, a few at a time, so that results do not pile up in a worker."""
    listed = texts.tolist()
    for i in range(0, len(listed), SLICE):
        yield listed[i : i + SLICE]


def encode(
    docs: DataFrame, model: Pieces, text: str = "text", out: str = "ids", chunk: int = CHUNK, decoded: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each whole text as array<int> in column ``out``.

    With ``decoded`` the ids are decoded into a column of that name in the same pass. Null texts give null, empty texts an empty array. All rows and columns stay, repeated rows too; a column
    of the name ``out`` is replaced. Texts of more than ``chunk`` characters go through the parallel scan.
    Meeting in one task: the ids of one text, and the matrices of its blocks (a text of 2 GB has 512).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.ready())
    docs = docs.drop(out, *([decoded] if decoded else []))
    names = docs.columns

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            for some in _sliced(texts):
                yield pd.Series([None if t is None else np.frombuffer(known.encode(t), dtype="<i4") for t in some], dtype=object)

    @F.pandas_udf("ids array<int>, back string")
    def there_and_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            for some in _sliced(texts):
                ids = [None if t is None else np.frombuffer(known.encode(t), dtype="<i4") for t in some]
                yield pd.DataFrame({"ids": ids, "back": [None if i is None else known.decode(i) for i in ids]}, dtype=object)

    def whole(rows: DataFrame) -> DataFrame:
        if not decoded:
            return rows.withColumn(out, ids_of(text))
        coded = rows.withColumn("__coded", there_and_back(text))
        return coded.select(*[F.col(f"`{c}`") for c in names], F.col("__coded.ids").alias(out), F.col("__coded.back").alias(decoded))

    fits = F.coalesce(F.length(text) <= chunk, F.lit(True))
    if model.trim_spaces:
        raise ValueError("chunks need a model that keeps spaces")
    small = whole(docs.where(fits))
    if docs.where(~fits).limit(1).count() == 0:
        return small
    row = F.struct(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__of"), F.col(f"`{text}`").alias("__text"))
    giant = written(docs.where(~fits).select(F.inline(F.array(row))), "giant_texts")
    normal = F.concat(F.lit(SPACE if model.prefix_space else ""), F.translate("__text", " ", SPACE))
    side = model.longest

    def piece_of(n):
        start = n * chunk
        return F.struct(
            n.alias("no"),
            F.substring("normal", F.greatest(start - side, F.lit(0)) + 1, F.least(start, F.lit(side))).alias("before"),
            F.substring("normal", start + 1, F.lit(chunk)).alias("body"),
            F.substring("normal", start + chunk + 1, F.lit(side)).alias("after"),
        )

    count = F.ceil(F.length("normal") / chunk).cast("int")
    cut = giant.select("__row", normal.alias("normal")).select("__row", F.inline(F.transform(F.sequence(F.lit(0), count - 1), piece_of)))
    chunks = written(cut.repartition("__row", "no"), "text_chunks")

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = [_pack(shared.value.transfer(x, y, z)) for x, y, z in zip(b.before, b.body, b.after, strict=True)]
            yield pd.DataFrame({"__row": b["__row"], "no": b.no, "block": b.no // BLOCK, "cells": cells})

    matrices = written(
        chunks.mapInPandas(transfers, "__row long, no int, block int, cells array<array<double>>"), "transfer_matrices"
    )

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for cells in group.sort_values("no").cells:
            total = _unpack(cells) if total is None else product(total, _unpack(cells))
        return pd.DataFrame({"__row": [group["__row"].iloc[0]], "block": [group.block.iloc[0]], "cells": [_pack(total)]})

    def over_blocks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        parts = [_unpack(c) for c in group.cells]
        ends = {k: max(row.get(k, -np.inf) for row in parts[-1].values()) for row in parts[-1].values() for k in row if k[0] == 0}
        best = max(ends, key=lambda k: (_reach(parts, k), k))
        return _spans(group["__row"], group.block, "block", states_between(parts, (0, START), best))

    def over_chunks(key, group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        group, given = group.sort_values("no"), given.iloc[0]
        states = states_between(
            [_unpack(c) for c in group.cells],
            (int(given.entry_over), int(given.entry_piece)),
            (int(given.leave_over), int(given.leave_piece)),
        )
        return _spans(group["__row"], group.no, "no", states)

    blocks = matrices.groupBy("__row", "block").applyInPandas(combine, "__row long, block int, cells array<array<double>>")
    fixed = blocks.groupBy("__row").applyInPandas(over_blocks, f"__row long, block int, {STATES}")
    states = (
        matrices.groupBy("__row", "block").cogroup(fixed.groupBy("__row", "block")).applyInPandas(over_chunks, f"__row long, no int, {STATES}")
    )

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [
                np.frombuffer(shared.value.trace(r.before, r.body, r.after, (r.entry_over, r.entry_piece), (r.leave_over, r.leave_piece)), dtype="<i4")
                for r in b.itertuples(index=False)
            ]
            yield pd.DataFrame({"__row": b["__row"], "no": b.no, "ids": ids})

    ids = chunks.join(states, ["__row", "no"]).mapInPandas(traced, "__row long, no int, ids array<int>")
    parts = ids.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    joined = parts.select("__row", F.flatten("parts.ids").alias(out))
    large = giant.join(joined, "__row").select("__of.*", F.col(out))
    return small.unionByName(decode(large, model, out, decoded) if decoded else large)


def _reach(parts: list[Matrix], leave: tuple[int, int]) -> float:
    total = {(0, START): 0.0}
    for part in parts:
        after: dict[tuple[int, int], float] = {}
        for state, weight in total.items():
            for k, w in part.get(state, {}).items():
                after[k] = max(after.get(k, -np.inf), weight + w)
        total = after
    return total.get(leave, -np.inf)


def _spans(rows, numbers, name: str, states: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "__row": rows.to_numpy(), name: numbers.to_numpy(),
            "entry_over": [s[0] for s in states[:-1]], "entry_piece": [s[1] for s in states[:-1]],
            "leave_over": [s[0] for s in states[1:]], "leave_piece": [s[1] for s in states[1:]],
        }
    )


def decode(rows: DataFrame, model: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids in column ``out``; null gives null, none the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.ready())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield pd.Series([None if a is None else shared.value.decode(np.asarray(a)) for a in arrays], dtype=object)

    return rows.withColumn(out, text(ids))
