"""Words of Arrow text columns as NumPy arrays of 64-bit hashes, without a Python object per word.

A column's UTF-8 bytes are read as one array.  A word's hash is a polynomial over its bytes, taken from running sums,
so the cost is a few array passes whatever the number of words.  Pieces of about `PIECE` bytes, cut at separators, keep
the arrays in cache and the memory bounded by the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.ones(256, bool)  # separators: every ASCII byte but letters and digits
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
LOWER = _lower
_values = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUES = _values[LOWER]  # A-Z as a-z

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n + 1:
        for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts that split no word: at row starts or separators, about every PIECE bytes."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + PIECE, n)
        while to < n:
            row = offsets[np.searchsorted(offsets, to, "right") - 1]
            if row > at:
                to = int(row)
                break
            stop = min(to + PIECE, n)
            hit = np.flatnonzero(separators[data[to:stop]])
            end = int(offsets[np.searchsorted(offsets, to, "right")])
            if len(hit) and to + hit[0] < end:
                to += int(hit[0])
                break
            if end <= stop:
                to = end
                break
            to = stop
        yield at, to
        at = to


def tokenize(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, values: np.ndarray = VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of all words, and the first word of every row (with the number of words at the end).

    `values` are the letters' values (equal values: letters that count as equal).
    """
    hashes, firsts, ends, starts = tokenize_prefixes(data, offsets, separators, (None,), values)
    return hashes[0], firsts, ends, starts


def tokenize_prefixes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, prefixes: tuple[int | None, ...], values: np.ndarray = VALUES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """As `tokenize`, with the hashes of the words' first so many bytes for each of `prefixes` (None: whole words)."""
    hashes: list[list[np.ndarray]] = [[] for _ in prefixes]
    firsts, ends = [], []
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    for at, to in _pieces(data, offsets, separators):
        piece = data[at:to]
        word = ~separators[piece]
        edge = row_start[at:to + 1].copy()
        edge[0] = edge[-1] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        close = word.copy()
        close[:-1] &= ~word[1:] | edge[1:-1]
        first, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        up, down = _power_tables(len(piece))
        running = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[:len(piece)], out=running[1:])
        for prefix, out in zip(prefixes, hashes, strict=True):
            stop = end if prefix is None else np.minimum(end, first + prefix)
            h = (running[stop] - running[first]) * down[first]
            out.append(mix(h ^ ((stop - first).astype(np.uint64) << np.uint64(48))))
        firsts.append(first + at)
        ends.append(end + at)
    if not firsts:
        none = np.zeros(0, np.int64)
        return [np.zeros(0, np.uint64) for _ in prefixes], none, none, np.zeros(len(offsets), np.int64)
    starts = np.concatenate(firsts)
    return [np.concatenate(h) for h in hashes], starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def row_groups(offsets: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of together about `size` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def shingles(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a row, and the rows' starts in them.  A row of fewer words has one
    shingle, its whole sequence; a row of none has none."""
    count = np.diff(starts)
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_starts = np.concatenate(([0], np.cumsum(sizes)))
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * MULTIPLIER + words[j:j + n]
    place = np.ones(n, bool)  # a run of k words that begins in one row and ends in another is none
    for j in range(1, k):
        inner = starts[1:-1] - j
        inner = inner[(inner >= 0) & (inner < n)]
        place[inner] = False
    # the same without rows of fewer words: each start of a row belongs to one of at least k words
    row = np.searchsorted(starts, np.arange(n), "right") - 1 if n else np.zeros(0, np.int64)
    place &= starts[row + 1] - np.arange(n) >= k if n else place
    out = np.zeros(int(out_starts[-1]), np.uint64)
    long = np.repeat(count >= k, sizes)
    out[long] = mix(rolled[place])
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for w in words[starts[r]:starts[r + 1]]:
                h = h * MULTIPLIER + w
        out[out_starts[r]] = mix(np.array([h ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))[0]
    return out, out_starts
