"""Periodic runs of words by recompression.

A text's words become numbers.  Recompression shortens that string level by level: block compression writes maximal
blocks of one symbol as (symbol, size), pair compression splits the symbols into left and right ones and writes every
left symbol with the right one behind it as one.  Equal parts of a text are rewritten alike but for a symbol at each
border, so two places are compared on the grammar: up the levels while both places start a symbol of the next one, one
step where they don't, down again from the first difference.  This answers "how many words are equal from here on" (and
"back from here") exactly, in steps that grow with the number of levels and not with the length.

A stretch with period q and a length of 4 q or more holds 3 q places in a row whose word comes again q words later, so
one of them is a multiple of 3 q.  These harmonic grids (n / 3 (1 + 1/2 + 1/3 + ...) places) give the candidates; both
extensions of a candidate give its run.

All texts of a group of rows share one grammar; symbols that stand between the texts occur once and are never merged.
One pass over the rows, no shuffle; memory grows with the group (`GROUP_BYTES`, or one longer text).

Defined results: words are what stands between ASCII white space; a null or empty text has no words and no runs, its
collapsed text is empty; the collapsed text has single spaces; repeated rows have equal results; words of any length
and texts of any length are whole; the other columns of the input don't matter, but for those named by `key` and `text`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import SPACES, column_bytes, mix, row_groups

GROUP_BYTES = 4 << 20
MIN_LENGTH, MIN_POWER = 6, 4  # a run has at least so many words, and so many periods
GRID = MIN_POWER - 1
CANDIDATES = 1 << 20  # grid places looked at together
FLAT = 8  # texts of so few symbols are compared symbol by symbol
OUT_DDL = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end bytes of all words, and the first word of every row (with the number of words at the end)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return first, end, np.searchsorted(first, offsets)


def numbered(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for every word, equal for equal words, and how many there are."""
    if not len(first):
        return np.zeros(0, np.int64), 0
    bounds = np.empty(2 * len(first), np.int64)  # words and the gaps between them, in turn
    bounds[::2], bounds[1::2] = first, end
    parts = pa.Array.from_buffers(pa.large_binary(), 2 * len(first) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), len(coded.dictionary)


@dataclass
class Level:
    symbols: np.ndarray
    starts: np.ndarray  # first symbol of every symbol of the next level, and the end
    parent: np.ndarray  # symbol of the next level that holds a symbol
    blocks: bool  # equal symbols were merged (else: pairs)


class Grammar:
    """Recompression levels over symbols; where `wall` is set, a symbol occurs once and is never merged."""

    def __init__(self, symbols: np.ndarray, wall: np.ndarray) -> None:
        self.levels: list[Level] = []
        rounds = 0
        while np.diff(np.flatnonzero(wall)).max(initial=0) > FLAT + 1:
            starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            if len(starts) < len(symbols):
                symbols, wall = self._merge(symbols, wall, starts, True)
            right = (mix(symbols.astype(np.uint64) + np.uint64(rounds << 33)) >> np.uint64(63)).astype(bool)
            pair = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:]
            starts = np.flatnonzero(np.concatenate(([True], ~pair)))
            if len(starts) < len(symbols):
                symbols, wall = self._merge(symbols, wall, starts, False)
            rounds += 1
        self.top = symbols

    def _merge(self, symbols: np.ndarray, wall: np.ndarray, starts: np.ndarray, blocks: bool) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.append(starts, len(symbols))
        size = np.diff(bounds)
        second = size if blocks else np.where(size == 2, symbols[np.minimum(starts + 1, len(symbols) - 1)] + 1, 0)
        self.levels.append(Level(symbols, bounds, np.repeat(np.arange(len(starts)), size), blocks))
        return pd.factorize(symbols[starts] << 32 | second)[0].astype(np.int64), wall[starts]

    @staticmethod
    def _left(level: Level, at: np.ndarray, step: int) -> np.ndarray:
        """Symbols from `at` on (itself included) of the next level's symbol there, in direction `step`."""
        holder = level.parent[at]
        return level.starts[holder + 1] - at if step > 0 else at - level.starts[holder] + 1

    def _advance(self, level: Level, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        return np.minimum(self._left(level, a, step), self._left(level, b, step)) if level.blocks else np.ones(len(a), np.int64)

    @staticmethod
    def _border(level: Level, at: np.ndarray, step: int) -> np.ndarray:
        holder = level.parent[at]
        return level.starts[holder] == at if step > 0 else level.starts[holder + 1] == at + 1

    def equal(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols are equal from a and b on (a itself and b included; a < b), forwards (1) or backwards (-1)."""
        a0, a, b = a, a.astype(np.int64), b.astype(np.int64)
        seen = np.full(len(a), len(self.levels))  # level of the first difference
        live = np.arange(len(a))
        for k, level in enumerate(self.levels):
            for last in (False, True):
                inner = live[~(self._border(level, a[live], step) & self._border(level, b[live], step))]
                same = level.symbols[a[inner]] == level.symbols[b[inner]] if not last else np.zeros(len(inner), bool)
                seen[inner[~same]] = k
                on = inner[same]
                by = self._advance(level, a[on], b[on], step) * step
                a[on] += by
                b[on] += by
                live = live[seen[live] > k]
            a[live], b[live] = level.parent[a[live]], level.parent[b[live]]
        while len(live):
            live = live[self.top[a[live]] == self.top[b[live]]]
            a[live] += step
            b[live] += step
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            live = np.flatnonzero(seen > k)
            for x in (a, b):
                x[live] = level.starts[x[live]] if step > 0 else level.starts[x[live] + 1] - 1
            live = live[level.symbols[a[live]] == level.symbols[b[live]]]
            while len(live):
                by = self._advance(level, a[live], b[live], step) * step
                a[live] += by
                b[live] += by
                live = live[level.symbols[a[live]] == level.symbols[b[live]]]
        return np.abs(a - a0)


def grid_places(code: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grids' places that may lie in a run: the word comes again one period later, and so do those
    half a period and a whole one further on, or before.  `text`: the text of every place, `size`: words of every text."""
    n, longest = len(code), int(size.max(initial=0))
    periods = np.arange(1, longest // MIN_POWER + 1)
    sizes = np.maximum(0, -(-(n - periods) // (GRID * periods)))
    ends = np.cumsum(sizes)
    places, found = [], []
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        q = np.repeat(periods[at:to], sizes[at:to])
        i = GRID * q * (np.arange(len(q)) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to]))
        hit = np.flatnonzero(code[i] == code[i + q])
        i, q = i[hit], q[hit]
        hit = (text[i] == text[i + q]) & (size[text[i]] >= MIN_POWER * q)
        i, q = i[hit], q[hit]
        again = lambda x: code[np.clip(x, 0, n - 1)] == code[np.clip(x + q, 0, n - 1)]  # noqa: B023, E731
        hit = np.flatnonzero((again(i + q) & again(i + q // 2)) | (again(i - q) & again(i - q // 2)))
        places.append(i[hit])
        found.append(q[hit])
        at = to
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *found])


def runs_of(code: np.ndarray, kinds: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of all rows, by row, start and period.  `code`: the rows' words as numbers
    below `kinds`, `starts`: the first word of every row and the end."""
    rows = len(starts) - 1
    size = np.diff(starts)
    row = np.repeat(np.arange(rows), size)
    place = np.arange(len(code)) + row + 1  # a wall before every row and one at the end
    walled = np.zeros(len(code) + rows + 1, np.int64)
    wall = np.ones(len(walled), bool)
    walled[place], wall[place] = code, False
    walled[wall] = kinds + np.arange(rows + 1)
    text_of = np.cumsum(wall) - 1
    i, q = grid_places(walled, text_of, np.append(size, 0))
    if not len(i):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    used = np.zeros(rows + 1, bool)  # texts with candidates have a grammar
    used[text_of[i]] = True
    keep = used[text_of] | wall
    grammar = Grammar(pd.factorize(walled[keep])[0].astype(np.int64), wall[keep])
    moved = np.cumsum(keep) - 1
    a, b = moved[i], moved[i + q]
    forth, back = grammar.equal(a, b, 1), grammar.equal(a - 1, b - 1, -1)
    start, length, text = i - back, back + forth + q, text_of[i]
    fits = length >= np.maximum(MIN_LENGTH, MIN_POWER * q)
    found = np.unique(np.stack([text[fits], start[fits], length[fits], q[fits]], axis=1), axis=0)
    smallest = np.ones(len(found), bool)  # of equal stretches: the first has the smallest period
    smallest[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[smallest]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return found[:, 0], found[:, 1] - found[:, 0] - 1 - starts[found[:, 0]], found[:, 2], found[:, 3]


def collapsed(data: np.ndarray, first: np.ndarray, end: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The rows' kept words, joined by single spaces."""
    which = np.flatnonzero(kept)
    size = end[which] - first[which] + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - size), size)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[ends - 1] = 0x20
    last = np.searchsorted(which, starts)  # kept words before each row
    bytes_to = np.concatenate(([0], ends))[last]
    # the space behind a row's last word stands between two rows: it is left out
    stays = np.ones(len(out), bool)
    stays[bytes_to[1:][np.diff(last) > 0] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(stays)))[bytes_to]
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[stays])])


def find_in(texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(n_words, runs, collapsed) of every text, group by group."""
    data, offsets = column_bytes(texts)
    for lo, hi in row_groups(offsets, GROUP_BYTES):
        own = offsets[lo:hi + 1] - offsets[lo]
        raw = data[offsets[lo]:offsets[hi]]
        first, end, starts = split(raw, own)
        code, kinds = numbered(raw, first, end)
        row, start, length, period = runs_of(code, kinds, starts)
        covered = np.zeros(len(code) + 1, np.int64)
        np.add.at(covered, starts[row] + start + period, 1)
        np.add.at(covered, starts[row] + start + length, -1)
        kept = np.cumsum(covered)[:-1] == 0
        ends = np.searchsorted(row, np.arange(hi - lo + 1))
        runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
        yield pa.record_batch(
            [pa.array(np.diff(starts).astype(np.int64)), runs, collapsed(raw, first, end, starts, kept).cast(pa.string())],
            names=["n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every row's number of words, its maximal periodic runs (start, length and
    smallest period in words, by start, then period) and its text without the words that repeat a run's first period."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = 0
            for part in find_in(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, part.num_rows), *part.columns], names=["doc_id", *part.schema.names])
                at += part.num_rows
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, f"doc_id long, {OUT_DDL}")
