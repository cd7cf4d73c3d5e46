"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

The alphabet is words: runs of letters and digits, upper case as lower case; spaces and punctuation beyond ASCII separate,
too, and each character of a script without spaces (Han, kana, Thai, Lao, Khmer, Burmese and others) is a word.  A CGK random walk reads a word string
with steps j = 0, 1, ...; it copies the word at its place and moves on if the bit r_j(word) is set, so that strings at a
small edit distance become sequences at a small Hamming distance.

Edits add up along a walk, so an item is indexed by all its windows of one of the sizes `WINDOWS`, about two thirds of its words: a
long item has many of them, and some hold few edits at any rate up to `MAX_EDITS`.  Windows of equal length of a document
start at every `STRIDE`-th word, so each alignment is met.  Windows are embedded by `WALKS` walks; each of `SAMPLES` hashes
per walk takes the words at `POSITIONS` random places.  Equal hashes are candidates; an item is found where its edit distance
in words to its best place near the window is at most `MAX_EDITS` of its words.  Recall is measured in the tests by item
length and edit rate.  Items of fewer than `MIN_WORDS` words leave no room for edits: they are looked up as they are.

All documents are read in one pass per block of items (`BLOCK_ITEMS`, `BLOCK_CHARS`); only a block's index, of bounded
size, is sent to the tasks.  There is no shuffle of texts.

Defined results: a null or empty text has no matches; an item of fewer than `MIN_WORDS` words matches its exact words only;
one without words is ignored, as is a null one; of several places of an item in a document the one with the fewest edits, then the first,
is given.  Repeated documents and items each count; documents without an id can match, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import MULTIPLIER, PUNCTUATION, column_bytes, mix, row_groups, tokenize

WALKS, SAMPLES, POSITIONS = 2, 8, 4
STRIDE, MIN_WORDS, MAX_EDITS = 2, 5, 0.2
WINDOWS = (5, 7, 10, 13)  # words of an item's windows
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 2_000_000
FILTER_BITS, PLACE_BITS = 18, 32
MATCH_DDL = "doc_id long, item_id long, start long, end long, edits int"


def fold(data: np.ndarray) -> np.ndarray:
    """Latin-1 capitals (two bytes, the first 0xC3) as small letters; A-Z are folded by the word hashes."""
    second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    if not second.any():
        return data
    out = data.copy()
    out[1:][second] += 0x20
    return out


# scripts that write no spaces between words (first and last code points)
UNSPACED = (
    (0x0E01, 0x0E4E), (0x0E81, 0x0ECE), (0x0EDC, 0x0EDF), (0x1000, 0x103F), (0x104C, 0x108F), (0x109A, 0x109F), (0x1780, 0x17DD), (0x1950, 0x19CF),
    (0x1A20, 0x1A7F), (0x1B00, 0x1B4C), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9CF), (0xA9E0, 0xA9EF), (0xA9FA, 0xA9FE), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF),
)
LETTER, SEPARATOR, WORD = 0, 1, 2
KIND = np.zeros(0x20000, np.uint8)
for _a, _b in UNSPACED:
    KIND[_a:_b + 1] = WORD
KIND[[c for c in range(0x80, 0x20000) if category(chr(c))[0] in "ZP" or c < 0xA0 or c in (0x200B, 0xFEFF)]] = SEPARATOR


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `tokenize`, with separators beyond ASCII and the characters of unspaced scripts as words."""
    data = fold(data)
    at = np.flatnonzero((data == 0xC2) | (data >= 0xC4))  # after 0xC3 there are letters only
    if not len(at):
        return tokenize(data, offsets, PUNCTUATION)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    kind = np.where(code < len(KIND), KIND[np.minimum(code, len(KIND) - 1)], np.where(code < 0x40000, WORD, LETTER))
    data = data.copy()
    for k in range(4):
        data[at[(kind == SEPARATOR) & (size > k)] + k] = 0x20
    alone = kind == WORD
    edges = np.unique(np.concatenate((offsets, at[alone], at[alone] + size[alone])))
    h, first, end, _ = tokenize(data, edges, PUNCTUATION)
    return h, first, end, np.searchsorted(first, offsets)


def window_size(n: int) -> int:
    """Words of the windows of an item of `n` words."""
    return max([WINDOWS[0]] + [size for size in WINDOWS if size * 3 <= n * 2])


def sampled_steps(walk: int, size: int) -> np.ndarray:
    """SAMPLES x POSITIONS steps of a walk over `size` words (which takes about two steps a word)."""
    return np.sort(np.random.Generator(np.random.PCG64([walk, size])).integers(0, 2 * size, (SAMPLES, POSITIONS)), axis=1)


def padded(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one end mark (0, which no walk leaves) after every row, and the rows' new starts."""
    n = len(starts) - 1
    out = np.zeros(len(words) + n, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(starts))] = words | np.uint64(1)
    return out, starts + np.arange(n + 1)


def window_hashes(words: np.ndarray, at: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(walk, size, sample, hash per window) of the windows that start at `at` in padded words, for every size."""
    for walk in range(WALKS):
        uses: dict[int, list[tuple[int, int]]] = {}
        for size in sizes:
            for k, steps in enumerate(sampled_steps(walk, size)):
                for j in steps:
                    uses.setdefault(int(j), []).append((size, k))
        hashes = {(size, k): np.full(len(at), walk * 1009 + size * 31 + k, np.uint64) for size in sizes for k in range(SAMPLES)}
        place = at.astype(np.int64)
        for j in range(2 * max(sizes, default=0)):
            if j % 64 == 0:
                bits = mix(words * MULTIPLIER + np.uint64(walk * 4096 + j))
                bits[words == 0] = 0
            if j in uses:
                word = words[place]
                for size, k in uses[j]:
                    h = hashes[size, k]
                    h *= MULTIPLIER
                    h += word if j < size else np.where(place - at < size, word, np.uint64(0))
            place += ((bits[place] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        for (size, k), h in hashes.items():
            yield walk, size, k, mix(h)


def most_edits(item: np.ndarray) -> int:
    return int(MAX_EDITS * len(item))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive words; an end mark among them makes one that no item has."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= MULTIPLIER
        h += words[j:j + n]
    return mix(h)


@dataclass
class ItemIndex:
    ids: list[int]
    items: list[np.ndarray]  # the items' words
    sizes: list[int]
    tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted hashes, item numbers, offsets
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by words of a short item: sorted hashes, item numbers


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = column_bytes(texts)
    return split_words(data, offsets)


def build_index(ids: list[int], texts: list[str]) -> ItemIndex:
    h, _, _, starts = words_of(pa.array(texts, pa.large_string()))
    kept = [(i, h[a:b] | np.uint64(1)) for i, a, b in zip(ids, starts[:-1], starts[1:], strict=True) if b > a]
    index = ItemIndex([i for i, _ in kept], [w for _, w in kept], [], {}, {})
    windows = [(n, o, size) for n, w in enumerate(index.items) for size in [window_size(len(w))] for o in range(len(w) - size + 1)]
    if windows:
        index.sizes = sorted({size for _, _, size in windows})
        words, at = padded(np.concatenate([index.items[n][o:o + size] for n, o, size in windows]), np.cumsum([0] + [size for _, _, size in windows]))
        number, offset, size_of = (np.array(x) for x in zip(*windows, strict=True))
        for walk, size, k, hashes in window_hashes(words, at[:-1], index.sizes):
            own = size_of == size
            order = np.argsort(hashes[own], kind="stable")
            index.tables[walk, size, k] = (hashes[own][order], number[own][order], offset[own][order])
    for size in range(1, MIN_WORDS):
        number = np.array([n for n, w in enumerate(index.items) if len(w) == size], np.int64)
        if len(number):
            hashes = np.concatenate([run_hashes(index.items[n], size) for n in number])
            order = np.argsort(hashes, kind="stable")
            index.short[size] = (hashes[order], number[order])
    return index


def best_place(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of `text` nearest to `item` by edit distance in words, if within `most`.

    Bit-parallel over the item's words; the start is found by running the reversed strings back from the best end.
    """
    def ends(p: np.ndarray, t: np.ndarray, anywhere: bool) -> list[int]:
        m = len(p)
        masks: dict[int, int] = {}
        for i, w in enumerate(p.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, out = full, 0, m, [m]
        for w in t.tolist():
            eq = masks.get(w, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (~(xh | up) & full), up & xh
            score += 1 if ph & top else -1 if mh & top else 0
            ph, mh = (ph << 1 | (0 if anywhere else 1)) & full, mh << 1 & full
            up, down = mh | (~(xv | ph) & full), ph & xv
            out.append(score)
        return out

    scores = ends(item, text, True)
    end = int(np.argmin(scores))
    if scores[end] > most:
        return None
    back = ends(item[::-1], text[:end][::-1], False)
    return scores[end], end - int(np.argmin(back)), end


def word_marks(words: np.ndarray) -> list[np.ndarray]:
    """One of 128 bits for every word, in two arrays."""
    h = mix(words * MULTIPLIER)
    bit = np.uint64(1) << (h & np.uint64(63))
    upper = (h >> np.uint64(6) & np.uint64(1)).astype(bool)
    return [np.where(upper, np.uint64(0), bit), np.where(upper, bit, np.uint64(0))]


def joined_marks(marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The marks of all words in [left, right) together, by runs of doubling length."""
    out = np.zeros(len(left), np.uint64)
    span, length = right - left, 1
    while True:
        own = (span >= length) & (span < 2 * length)
        out[own] = marks[left[own]] | marks[right[own] - length]
        if not (span >= 2 * length).any():
            return out
        marks = marks[:-length] | marks[length:]
        length *= 2


def find_in(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, start, end, edits) of every item found in every text; places are in code points."""
    if not index.items:
        return
    data, offsets = column_bytes(texts)
    # an item with fewer windows than the stride is met only by windows at every word
    stride = STRIDE if all(len(w) - window_size(len(w)) + 1 >= STRIDE for w in index.items if len(w) >= MIN_WORDS) else 1
    listed = [w.tolist() for w in index.items]
    most_of, size_of = np.array([most_edits(w) for w in index.items]), np.array([len(w) for w in index.items])
    of_item = word_marks(np.concatenate(index.items))
    item_marks = [np.bitwise_or.reduceat(x, np.cumsum(size_of) - size_of) for x in of_item]
    bitmaps = {}
    for key, (hashes, *_) in (index.tables | index.short).items():
        bitmaps[key] = np.zeros(1 << FILTER_BITS, bool)
        bitmaps[key][hashes >> np.uint64(64 - FILTER_BITS)] = True
    for lo, hi in row_groups(offsets, 1 << 21):
        own = offsets[lo:hi + 1] - offsets[lo]
        raw = data[offsets[lo]:offsets[hi]]
        h, first, last, starts = split_words(raw, own)
        words, begins = padded(h, starts)
        if not len(words):
            continue
        counts = -(-np.diff(starts) // stride)
        at = np.repeat(begins[:-1], counts) + stride * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        met: list[np.ndarray] = []  # item number and place of the item's start

        def look_up(key, table, number, hashes, spot, offset) -> None:
            hit = np.flatnonzero(bitmaps[key][hashes >> np.uint64(64 - FILTER_BITS)])
            a, b = np.searchsorted(table, hashes[hit], "left"), np.searchsorted(table, hashes[hit], "right")
            n = b - a
            hit, e = np.repeat(hit, n), np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row_begin = begins[np.searchsorted(begins, spot[hit], "right") - 1]
            # an item whose first words are missing may begin before its row
            met.append(np.unique(number[e] << PLACE_BITS | np.maximum(row_begin, spot[hit] - (offset[e] if offset is not None else 0))))

        for walk, size, k, hashes in window_hashes(words, at, index.sizes):
            look_up((walk, size, k), *index.tables[walk, size, k][:2], hashes, at, index.tables[walk, size, k][2])
        for size, (table, number) in index.short.items():
            look_up(size, table, number, run_hashes(words, size), np.arange(len(words)), None)
        keys = np.unique(np.concatenate(met))
        number, place = keys >> PLACE_BITS, keys & ((1 << PLACE_BITS) - 1)
        row = np.searchsorted(begins, place, "right") - 1
        reach = most_of[number] + STRIDE
        left, right = np.maximum(begins[row], place - reach), np.minimum(begins[row + 1] - 1, place + size_of[number] + 2 * reach)
        missing = np.zeros(len(keys), np.int64)
        for marks, part in zip(item_marks, word_marks(words), strict=True):
            missing += np.bitwise_count(marks[number] & ~joined_marks(part, left, right)).astype(np.int64)
        likely = missing <= most_of[number]  # each missing mark is a missing word, and that an edit
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for n, row, place in zip(*(x[likely].tolist() for x in (number, row, place)), strict=True):
            item = index.items[n]
            most = most_edits(item)
            if done.get((n, row), -1) >= place:  # a little further on: the last look covered it
                continue
            reach = most + STRIDE
            a, b = max(int(begins[row]), place - reach), min(int(begins[row + 1]) - 1, place + len(item) + 2 * reach)
            done[n, row] = place + reach - STRIDE
            near = set(words[a:b].tolist())
            if sum(w not in near for w in listed[n]) > most:  # each missing word is an edit
                continue
            got = best_place(item, words[a:b], most)
            if got and got[2] > got[1]:
                old = found.get((n, row))
                new = (got[0], a + got[1] - int(begins[row]), a + got[2] - int(begins[row]))
                found[n, row] = min(old, new) if old else new
        for (n, row), (edits, a, b) in found.items():
            at_row, w = own[row], int(starts[row])
            points = lambda to: int(((raw[at_row:to] & 0xC0) != 0x80).sum())
            yield lo + row, index.ids[n], points(first[w + a]), points(last[w + b - 1]), edits


def item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The benchmark (item_id, text) in blocks of bounded size, read one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    ids: list[int] = []
    texts: list[str] = []
    for r in rows.toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or sum(map(len, texts)) + len(r["text"]) > BLOCK_CHARS):
            yield build_index(ids, texts)
            ids, texts = [], []
        ids.append(r["item_id"])
        texts.append(r["text"])
    yield build_index(ids, texts)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every benchmark item in every document of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(find_in(index, batch.column("text")))
                if hits:
                    row, item, a, b, edits = zip(*hits, strict=True)
                    yield pa.record_batch([
                        batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])
        found = rows.mapInArrow(run, MATCH_DDL)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, that hold no benchmark item; one pass, no shuffle."""
    for index in item_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[row for row, *_ in find_in(index, batch.column(text))]] = False
                yield batch.filter(pa.array(stays))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
