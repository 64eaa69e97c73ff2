"""Encoding to SentencePiece BPE pieces with seeded merge-dropout, and decoding.

The vocabulary file gives pieces and scores; nothing is trained.  A text is cut into units that no
piece crosses.  In each unit the candidate merges wait on an agenda, best score first and then from
the left; each one taken from it is skipped if a hash keyed by the seed, the document, the unit's
place in it, the symbol's place and the piece says so.  A skipped merge returns only if a neighbour
changes.  So every occurrence of a unit has draws of its own, and a rerun has the same ones.

What the draws lead to is kept for short units: a node is a unit with the tests at which a merge was
skipped so far.  It has the pieces that come out if nothing more is skipped, and the tests on the way
there.  An occurrence makes its draws for these tests; the first one skipped leads to the next node,
which is segmented when the first occurrence comes to it.  Longer units are segmented at each
occurrence: in arrays, or with a heap.

Characters without a piece, and the blank's own mark, become byte pieces: decoding gives back every
text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole

MARK = "▁"
#: Units with more symbols are segmented at each of their occurrences.
LONGEST_KEPT = 10
#: Tests of a kept unit at most: a pair of neighbours at first and two new ones a merge.
MOST_TESTS = 3 * LONGEST_KEPT
#: Units with more symbols are segmented one by one.
LONGEST_IN_ARRAYS = 48
#: Units with more characters are first cut between those that stand side by side in no piece.
LONGEST_UNCUT = 48
#: Characters of the texts that are segmented together.
CHUNK = 500_000
#: Distinct units and nodes that a task keeps for its next texts; it begins anew beyond them.
KEPT_UNITS, KEPT_NODES = 150_000, 600_000
#: Bits of the table that finds merges.
_TABLE_BITS = 18
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_NEVER = np.int32(1 << 30)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Piece of each code point (-1: none) and byte, merges by a hash of (left, right), every piece's bytes."""

    chars: np.ndarray
    byte_of: list[int]
    pairs: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    content: list[bytes]
    #: (rank, piece) by left * size + right, and the pairs of characters that pieces hold, ascending.
    joins: dict[int, tuple[int, int]]
    within: np.ndarray

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of neighbours; rank is out of reach where no piece joins them."""
        rank, piece = np.full(left.shape, _NEVER, dtype="int32"), np.full(left.shape, -1, dtype="int32")
        there = (left >= 0) & (right >= 0)
        key = left[there].astype("int64") * len(self.content) + right[there]
        at = _slot(key)
        held = self.pairs[at]
        while len(open_ := np.flatnonzero((held != key) & (held >= 0))):
            at[open_] = (at[open_] + 1) & ((1 << _TABLE_BITS) - 1)
            held[open_] = self.pairs[at[open_]]
        known = held == key
        rank[there] = np.where(known, self.rank[at], _NEVER)
        piece[there] = np.where(known, self.merged[at], -1)
        return rank, piece


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype("uint64") * _STEP) >> np.uint64(64 - _TABLE_BITS)).astype("int64")


def load(model_path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece BPE model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    byte_of, normal, content = [-1] * 256, {}, []
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            byte_of[int(piece[3:5], 16)] = i
            content.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            content.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece spans blanks: units would not be independent")
            normal[piece] = i
            content.append(piece.replace(MARK, " ").encode())
    if min(byte_of) < 0:
        raise ValueError("the vocabulary has no byte pieces")
    order = {p: r for r, p in enumerate(sorted(normal, key=lambda p: (-model.get_score(normal[p]), normal[p])))}
    merges = [
        (normal[p[:k]] * size + normal[p[k:]], i, order[p])
        for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal
    ]
    if len(merges) > 1 << (_TABLE_BITS - 1):
        raise ValueError("more merges than the table has room for")
    pairs, merged, rank = np.full(1 << _TABLE_BITS, -1, dtype="int64"), *np.zeros((2, 1 << _TABLE_BITS), dtype="int32")
    for (key, i, r), at in zip(merges, _slot(np.array([m[0] for m in merges], dtype="int64")).tolist()):
        while pairs[at] >= 0:
            at = (at + 1) & ((1 << _TABLE_BITS) - 1)
        pairs[at], merged[at], rank[at] = key, i, r
    chars = np.full(0x110000, -1, dtype="int32")
    for piece, i in normal.items():
        if len(piece) == 1:
            chars[ord(" " if piece == MARK else piece)] = i
    within = {_pair(ord(" " if a == MARK else a), ord(" " if b == MARK else b)) for p in normal for a, b in zip(p, p[1:])}
    joins = {key: (r, i) for key, i, r in merges}
    return Vocabulary(chars, byte_of, pairs, merged, rank, content, joins, np.array(sorted(within), dtype="int64"))


def _pair(a, b):
    return a << 21 | b


def apart(unit: str, v: Vocabulary) -> list[str]:
    """The unit cut between neighbours that stand side by side in no piece: nothing merges across."""
    points = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("int64")
    pair = _pair(points[:-1], points[1:])
    at = np.minimum(np.searchsorted(v.within, pair), len(v.within) - 1)
    ends = np.flatnonzero(v.within[at] != pair) + 1
    return [unit[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(unit)])]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, most: np.uint64) -> np.ndarray:
    """Whether the merge into ``piece`` at symbol ``place`` is dropped for an occurrence with this key."""
    at = place.astype("uint64") * _STEP + piece.astype("uint64")
    return _mixed(key ^ _mixed(at)) < most


def _together(symbols: np.ndarray, v: Vocabulary, dropped: Callable[..., np.ndarray]) -> np.ndarray:
    """Segments many units at once; rows of ``symbols`` end in -1, and so do those returned.

    ``dropped`` gets rows, the number of the test (the same for all of them), symbol places and pieces.
    """
    done = np.empty_like(symbols)
    row = np.arange(len(symbols))
    place = np.tile(np.arange(symbols.shape[1], dtype="int32"), (len(symbols), 1))
    rank, piece = v.found(symbols[:, :-1], symbols[:, 1:])
    column = np.arange(symbols.shape[1])
    test = 0
    while len(row):
        best = rank.argmin(axis=1)
        line = np.arange(len(row))
        live = rank[line, best] < _NEVER
        if not live.all():
            done[row[~live]] = symbols[~live]
            row, symbols, place, rank, piece, best = (x[live] for x in (row, symbols, place, rank, piece, best))
            line = np.arange(len(row))
        joined = piece[line, best]
        drop = dropped(row, test, place[line, best], joined)
        test += 1
        rank[line[drop], best[drop]] = _NEVER
        at, b = line[~drop], best[~drop]
        if not len(at):
            continue
        symbols[at, b] = joined[~drop]
        # Close the gap to the right of each merge.
        source = np.minimum(column + (column > b[:, None]), symbols.shape[1] - 1)
        inner = np.minimum(source[:, : rank.shape[1]], rank.shape[1] - 1)
        moved = at[:, None]
        symbols[at] = symbols[moved, source]
        symbols[at, -1] = -1
        place[at] = place[moved, source]
        rank[at] = rank[moved, inner]
        piece[at] = piece[moved, inner]
        rank[at, -1] = _NEVER
        for left in (b - 1, b):
            ok = (left >= 0) & (left < rank.shape[1])
            x, y = at[ok], left[ok]
            rank[x, y], piece[x, y] = v.found(symbols[x, y], symbols[x, y + 1])
    return done


_WORD, _ODD, _M1, _M2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed_one(x: int) -> int:
    x = (x ^ (x >> 30)) * _M1 & _WORD
    x = (x ^ (x >> 27)) * _M2 & _WORD
    return x ^ (x >> 31)


def _alone(symbols: list[int], key: np.uint64, v: Vocabulary, most: np.uint64) -> np.ndarray:
    """Segments one unit with a heap, in plain numbers; the same merges as in arrays."""
    now, joins, size = list(symbols), v.joins, len(v.content)
    after = list(range(1, len(now))) + [-1]
    before = list(range(-1, len(now) - 1))
    own, limit, get = int(key), int(most), joins.get
    agenda = [(*found, i, now[i], now[i + 1]) for i in range(len(now) - 1) if now[i] >= 0 and (found := get(now[i] * size + now[i + 1]))]
    agenda = [(r, i, p, x, y) for r, p, i, x, y in agenda]
    heapq.heapify(agenda)
    push, pop = heapq.heappush, heapq.heappop
    while agenda:
        _, i, p, left, right = pop(agenda)
        j = after[i]
        if j < 0 or now[i] != left or now[j] != right:
            continue
        if _mixed_one(own ^ _mixed_one((i * _ODD + p) & _WORD)) < limit:
            continue
        now[i], now[j] = p, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := get(p * size + now[k]):
                push(agenda, (found[0], i, found[1], p, now[k]))
        h = before[i]
        if h >= 0 and (found := get(now[h] * size + p)):
            push(agenda, (found[0], h, found[1], now[h], p))
    return np.array([s for s in now if s >= 0], dtype="int64")


def _spelled(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of single characters and bytes, one unit after the other; their number per unit).

    A character without a piece, and the mark itself, is spelled in bytes.
    """
    text = "".join(units)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="uint32")
    pieces = np.where(points == ord(MARK), -1, v.chars[points]).astype("int32")
    size = np.fromiter(map(len, units), "int64", len(units))
    strange = np.flatnonzero(pieces < 0)
    if len(strange):
        spelled = [[v.byte_of[b] for b in chr(points[i]).encode("utf-8", "surrogatepass")] for i in strange]
        extra = np.array([len(x) for x in spelled], dtype="int64")
        unit = np.repeat(np.arange(len(units)), size)[strange]
        width = np.ones(len(points), dtype="int64")
        width[strange] = extra
        size = size + np.bincount(unit, extra - 1, len(units)).astype("int64")
        start = (np.cumsum(width) - width)[strange]
        pieces = np.repeat(pieces, width)
        for at, x in zip(start, spelled):
            pieces[at : at + len(x)] = x
    return pieces, size


def _tables(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their symbols as a table whose rows end in -1) for rows of up to ``longest`` symbols."""
    low = 0
    for high in sorted({min(h, longest) for h in (5, 8, LONGEST_KEPT, 12, 20, longest)}):
        rows = np.flatnonzero((size > low) & (size <= high))
        low = high
        if len(rows):
            column = np.arange(high + 1)
            inside = column < size[rows, None]
            yield rows, np.where(inside, flat[np.minimum(begin[rows, None] + column, len(flat) - 1)], -1)


def _keyed(
    flat: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, v: Vocabulary, most: np.uint64
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of each occurrence, by its key: one pool, and where each begins and how long it is."""
    pools, first, long = [np.zeros(0, dtype="int64")], np.zeros(len(key), dtype="int64"), np.zeros(len(key), dtype="int64")
    used = 0
    for rows, table in _tables(flat, begin, size, LONGEST_IN_ARRAYS):
        own = key[rows]
        table = _together(table, v, lambda row, _, place, piece: _skipped(own[row], place, piece, most))
        long[rows] = (table >= 0).sum(axis=1)
        first[rows] = used + np.cumsum(long[rows]) - long[rows]
        pools.append(table[table >= 0])
        used += len(pools[-1])
    for r in np.flatnonzero(size > LONGEST_IN_ARRAYS):
        pieces = _alone(flat[begin[r] : begin[r] + size[r]].tolist(), key[r], v, most)
        first[r], long[r] = used, len(pieces)
        pools.append(pieces)
        used += len(pieces)
    return np.concatenate(pools), first, long


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.data, self.used = np.zeros(1024, dtype=kind), 0

    def put(self, values: np.ndarray) -> int:
        """Writes values behind the end, where the next ones replace them; returns where they begin."""
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        return self.used

    def add(self, values: np.ndarray) -> int:
        """Appends values; returns where they begin."""
        at = self.put(values)
        self.used += len(values)
        return at


def _runs(first: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The numbers from each first one, so many each."""
    end = np.cumsum(long)
    return np.repeat(first - (end - long), long) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """Encodes texts one batch after another; keeps the segmentations of short units."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 1, numbered: bool = False):
        self.vocabulary, self.seed, self.numbered = vocabulary, seed, numbered
        self.last, self.repeat = None, 0
        self.most = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.symbols, self.begin, self.size, self.root = _Pool("int32"), _Pool("int64"), _Pool("int64"), _Pool("int64")
        # A node: its unit, the node it comes from and the test skipped there (-1: none), its pieces, its tests.
        self.unit, self.parent, self.skip = _Pool("int64"), _Pool("int64"), _Pool("int64")
        self.pieces, self.first, self.long = _Pool("int32"), _Pool("int64"), _Pool("int64")
        self.place, self.piece, self.first_test, self.tests = _Pool("int8"), _Pool("int32"), _Pool("int64"), _Pool("int64")
        self.after: dict[int, int] = {}

    def _learn(self, units: list[str]) -> None:
        """Spells new units and adds the nodes of the short ones."""
        if not units:
            return
        flat, size = _spelled(units, self.vocabulary)
        at = self.symbols.add(flat)
        self.begin.add(at + np.cumsum(size) - size)
        unit = self.size.add(size) + np.flatnonzero(size <= min(LONGEST_KEPT, LONGEST_IN_ARRAYS))
        self.root.add(np.full(len(units), -1, dtype="int64"))
        self.root.data[unit] = self._grow(unit, *np.full((2, len(unit)), -1, dtype="int64"))

    def _grow(self, unit: np.ndarray, parent: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Adds nodes; returns their numbers."""
        node = self.unit.add(unit) + np.arange(len(unit))
        self.parent.add(parent)
        self.skip.add(skip)
        skips, at = np.zeros((len(unit), MOST_TESTS), dtype=bool), node
        while len(line := np.flatnonzero(self.skip.data[at] >= 0)):
            skips[line, self.skip.data[at[line]]] = True
            at = np.where(self.skip.data[at] >= 0, self.parent.data[at], at)
        first, long, first_test, tests = np.zeros((4, len(unit)), dtype="int64")
        for rows, table in _tables(self.symbols.data, self.begin.data[unit], self.size.data[unit], LONGEST_KEPT):
            made = []

            def dropped(row, test, place, piece, rows=rows, made=made):
                later = test > skip[rows[row]]
                made.append((row[later], place[later], piece[later]))
                return skips[rows[row], test]

            table = _together(table, self.vocabulary, dropped)
            long[rows] = (table >= 0).sum(axis=1)
            first[rows] = self.pieces.add(table[table >= 0]) + np.cumsum(long[rows]) - long[rows]
            if made:
                row, place, piece = (np.concatenate(x) for x in zip(*made))
                order = np.argsort(row, kind="stable")
                tests[rows] = np.bincount(row, minlength=len(rows))
                self.place.add(place[order])
                first_test[rows] = self.piece.add(piece[order]) + np.cumsum(tests[rows]) - tests[rows]
        for pool, values in ((self.first, first), (self.long, long), (self.first_test, first_test), (self.tests, tests)):
            pool.add(values)
        return node

    def _next(self, node: np.ndarray, test: np.ndarray) -> np.ndarray:
        """The nodes that skipping a test, counted from a node's first one, leads to."""
        test = test + self.skip.data[node] + 1
        distinct, which = np.unique(node * MOST_TESTS + test, return_inverse=True)
        there = np.array([self.after.get(k, -1) for k in distinct.tolist()], dtype="int64")
        new = distinct[there < 0]
        if len(new):
            parent = new // MOST_TESTS
            there[there < 0] = made = self._grow(self.unit.data[parent], parent, new % MOST_TESTS)
            self.after.update(zip(new.tolist(), made.tolist()))
        return there[which]

    def _walked(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The node at which each occurrence ends, by its key."""
        left = np.arange(len(node))
        while len(left):
            at, own = node[left], key[left]
            long = self.tests.data[at]
            run = _runs(self.first_test.data[at], long)
            who = np.repeat(np.arange(len(left)), long)
            hit = np.flatnonzero(_skipped(own[who], self.place.data[run], self.piece.data[run], self.most))
            hit = hit[np.diff(who[hit], prepend=-1) > 0]  # the first of each
            who = who[hit]
            left = left[who]
            node[left] = self._next(at[who], hit - (np.cumsum(long) - long)[who])
        return node

    def encode(self, texts: list[str], names: list) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and where each text's begin, the end of the last included.

        ``names`` identify the texts in the hash, together with what they say.  With ``numbered``, the
        second and later of neighbours that agree in both count as others.
        """
        if self.size.used > KEPT_UNITS or self.unit.used > KEPT_NODES:
            self._forget()
        flat, sizes, number, units, named = [], [], self.number, [], []
        for text, name in zip(texts, names):
            own = _UNIT.findall(" " + text) if text else []
            if own and max(map(len, own)) > LONGEST_UNCUT:
                own = [x for unit in own for x in (apart(unit, self.vocabulary) if len(unit) > LONGEST_UNCUT else (unit,))]
            sizes.append(len(own))
            code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), xxhash.xxh3_64_intdigest(str(name).encode()))
            if self.numbered:
                self.repeat = self.repeat + 1 if self.last == (name, code) else 0
                self.last = (name, code)
                code ^= _mixed_one(self.repeat) if self.repeat else 0
            named.append(code)
            for unit in own:
                n = number.get(unit)
                if n is None:
                    number[unit] = n = len(number)
                    units.append(unit)
                flat.append(n)
        if not flat:
            return np.zeros(0, dtype="int32"), np.zeros(len(texts) + 1, dtype="int64")
        self._learn(units)
        unit, size = np.array(flat, dtype="int64"), np.array(sizes, dtype="int64")
        start = np.cumsum(size) - size
        place = (np.arange(len(flat)) - np.repeat(start, size)).astype("uint64")
        seed = np.array([self.seed], dtype="uint64") * _STEP
        key = _mixed(_mixed(np.repeat(np.array(named, dtype="uint64"), size) + seed) ^ (place * _STEP))
        first, long = np.zeros((2, len(flat)), dtype="int64")
        node = self.root.data[unit]
        kept, other = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        node = self._walked(node[kept], key[kept])
        first[kept], long[kept] = self.first.data[node], self.long.data[node]
        there = unit[other]
        pool, begin, long[other] = _keyed(
            self.symbols.data, self.begin.data[there], self.size.data[there], key[other], self.vocabulary, self.most
        )
        first[other] = begin + self.pieces.put(pool)
        ends = np.concatenate([[0], np.cumsum(long)])
        return self.pieces.data[_runs(first, long)], ends[np.concatenate([start, [len(flat)]])]


def encode(
    texts: list[str], names: list, v: Vocabulary, dropout: float = 0.1, seed: int = 1, numbered: bool = False
) -> list[np.ndarray]:
    """Piece ids of each text."""
    pieces, bounds = Encoder(v, dropout, seed, numbered).encode(texts, names)
    return np.split(pieces, bounds[1:-1]) if texts else []


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of piece ids."""
    if ids is None or not len(ids):
        return ""
    return b"".join(map(v.content.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _in_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts with about CHUNK characters together."""
    at, size = 0, pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    while at < len(size):
        end, room = at + 1, CHUNK - size[at]
        while end < len(size) and room > 0:
            room -= size[end]
            end += 1
        yield at, end - at
        at = end


def encoded(
    docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
    numbered: bool = False,
) -> DataFrame:
    """``row`` (struct of all input columns), ``pieces`` (array of ids) of each whole text and
    ``decoded``, the text those pieces give back.

    Null counts as empty, and an empty text has no pieces.  The vocabulary is read here and sent to
    the tasks: its size does not depend on the data.  Merges are dropped at each occurrence of a word
    by itself; the same identifier, text and seed give the same pieces, also in repeated rows.  With
    ``numbered``, repeated rows that follow one another have draws of their own, as when a mix takes a
    document several times.  An empty table gives an empty result; columns may have any names.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model_path))

    @F.arrow_udf("pieces array<int>, decoded string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary.value, dropout, seed, numbered)
        for names, texts in batches:
            for at, n in _in_chunks(texts):
                pieces, bounds = encoder.encode(texts.slice(at, n).to_pylist(), names.slice(at, n).to_pylist())
                back = [decode(pieces[a:b], vocabulary.value) for a, b in zip(bounds, bounds[1:])]
                listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pieces, pa.int32()))
                yield pa.StructArray.from_arrays([listed, pa.array(back, pa.string())], names=["pieces", "decoded"])

    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return docs.select(as_row(docs), run(name, whole(F.col(f"`{text_col}`"))).alias("coded")).select("row", "coded.*")


def decoded(coded: DataFrame, model_path: str, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of piece ids; null and empty arrays give an empty text."""
    vocabulary = coded.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([decode(ids, vocabulary.value) for ids in series], dtype="object")

    return coded.withColumn(out, run(F.col(f"`{pieces_col}`")))
