"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Every suffix of every text is ordered by its first `DEPTH` bytes only; suffixes that stay together to that depth are the
repeated windows.  The sort goes by digits, the most significant first; a digit is a stretch of bytes, each pass sends the
suffixes that are still together to the groups of the next digit, and a suffix alone in its group is finished (most are
after the first pass).

So that neighbouring suffixes share their digits, a window's digits are laid out from an anchor: the place of the least
hash among its runs of `GRAM` bytes, the first of equals.  Equal windows have equal anchors at equal places.

1. The `GRAM` bytes at the anchor.  There is one row per anchor (one in 170 bytes or so), not per suffix.
2. The bytes that `BLOCK` neighbouring windows of an anchor have in common.  One row per block of windows; its few bytes
   on the left and on the right go with it.
3. What a single window has of these, for blocks whose common bytes are repeated and which are not repeated as a whole.

Each pass is a grouped sum, so a passage that a third of all texts share is added up before the shuffle.  Only what is
*unique* is reported back, by anchor, block or window: a unique thing has one holder, so no report meets a hot key.
The texts are joined with the reports on a key of id and text.  Windows that nobody reports are repeated and removed.

The first digit is compared by 64 bits of hash (equal hashes of different bytes only leave more to the next pass), the
others as bytes or by 128 bits.  Defined results: a null or empty text has no bytes; matches lie
within texts and may overlap; the same place is never its own repetition; repeated rows, also those without an id, are
repetitions of each other; texts shorter than `DEPTH` stay whole; texts are read in pieces, so any length does; the
remaining bytes may cut characters in two, hence binary; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import written
from .words import MULTIPLIER, _power_tables, column_bytes, mix, row_groups

DEPTH, GRAM, BLOCK = 400, 64, 64
REACH = DEPTH - GRAM + 1  # grams of a window
CORE = DEPTH - BLOCK + 1  # bytes that all windows of a block share
PIECE, GROUP_BYTES = 1 << 20, 4 << 20
HOT = 4_000  # groups above a part of so many of all rows are joined by broadcast: there can be no more than this
ALL = -1  # mask of a block without repeated windows
ID = ["id1", "id2"]

VALUES = [np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (400, 401)]


def stretch_hashes(data: np.ndarray, at: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the `size` bytes from every place of `at`."""
    up, down = _power_tables(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=running[1:])
    return mix((running[at + size] - running[at]) * down[at])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(v) - width + 1
    held = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    held[:len(v)] = v
    rows = held.reshape(-1, width)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(back[:n], forth[width - 1:width - 1 + n])


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, hash of the anchor's gram) of every window within a row, by start."""
    out = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, max(0, len(data) - DEPTH + 1), PIECE):
        piece = data[at:at + PIECE + DEPTH - 1]
        n = len(piece) - DEPTH + 1
        start = np.arange(at, at + n)
        inside = ends[at:at + n] - start >= DEPTH
        if not inside.any():
            continue
        gram = stretch_hashes(piece, np.arange(len(piece) - GRAM + 1), GRAM, VALUES[0])
        placed = gram >> np.uint64(32) << np.uint64(32) | np.arange(len(gram), dtype=np.uint64)
        place = (sliding_least(placed, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out.append((start[inside], at + place[inside], gram[place[inside]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def heads(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of equal values."""
    first = np.flatnonzero(np.concatenate((np.ones(len(values[:1]), bool), values[1:] != values[:-1])))
    return first, np.diff(np.append(first, len(values)))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(texts)
    for lo, hi in row_groups(offsets, GROUP_BYTES):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(name).take(pa.array(rows)) for name in ID]


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, id, n): the rows' anchors, those of equal grams counted."""
    for batch in batches:
        for lo, _, data, offsets in _groups(batch.column("text")):
            _, anchor, gram = anchored(data, offsets)
            one = heads(anchor)[0]  # an anchor's windows stand together
            row = np.searchsorted(offsets, anchor[one], "right") - 1
            gram = gram[one].view(np.int64)
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            first = np.flatnonzero(np.concatenate((np.ones(len(gram[:1]), bool), (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))))
            n = np.diff(np.append(first, len(gram)))
            yield pa.record_batch([pa.array(gram[first]), *_ids(batch, row[first] + lo), pa.array(n)], names=["gram", *ID, "n"])


def _listed(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the rows lo to hi of a list column; null is an empty list."""
    part = column.slice(lo, hi - lo)
    size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(hi - lo), size), part.flatten().to_numpy(zero_copy_only=False)


def _repeated(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, anchor) of the windows whose anchor's gram is not reported as unique."""
    start, anchor, gram = anchored(data, offsets)
    one, size = heads(anchor)
    row = np.searchsorted(offsets, anchor[one], "right") - 1
    by_row, unique = _listed(batch.column("grams"), lo, hi)
    # both are marked by a number made of gram and row
    mark = lambda g, r: mix(g.astype(np.int64).view(np.uint64) * MULTIPLIER + r.astype(np.uint64))
    stays = ~np.isin(mark(gram[one].view(np.int64), row), mark(unique, by_row))
    on = np.repeat(stays, size)
    return np.repeat(row[stays], size[stays]), start[on], anchor[on]


def _second_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, before, behind, id, place): blocks of windows, by the hash of the bytes they share; `before` and `behind`
    are the bytes around these as far as the text goes, `place` is where the shared bytes begin in the text."""
    for batch in batches:
        for lo, hi, data, offsets in _groups(batch.column("text")):
            row, start, anchor = _repeated(batch, lo, hi, data, offsets)
            core = anchor - (anchor - start) // BLOCK * BLOCK
            one = heads(core)[0]
            core, first = np.unique(core[one], return_index=True)
            row = row[one[first]]
            if not len(core):
                continue
            first = np.maximum(core - BLOCK + 1, offsets[row])
            last = np.minimum(core + DEPTH, offsets[row + 1])
            cut = lambda a, b: pa.array([held[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
            held = data.tobytes()
            yield pa.record_batch([
                *(pa.array(stretch_hashes(data, core, CORE, v).view(np.int64)) for v in VALUES), cut(first, core), cut(core + CORE, last),
                *_ids(batch, row + lo), pa.array(core - offsets[row])], names=["h1", "h2", "before", "behind", *ID, "place"])


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, spans, kept): every row without its repeated windows."""
    for batch in batches:
        for lo, hi, data, offsets in _groups(batch.column("text")):
            row, start, anchor = _repeated(batch, lo, hi, data, offsets)
            by_row, reported = _listed(batch.column("places"), lo, hi)
            masks = _listed(batch.column("masks"), lo, hi)[1]
            core = anchor - (anchor - start) // BLOCK * BLOCK
            if len(reported):
                places = offsets[by_row] + reported
                order = np.argsort(places)
                places, masks = places[order], masks[order].astype(np.int64)
                one, size = heads(core)
                at = np.minimum(np.searchsorted(places, core[one]), len(places) - 1)
                mask = np.repeat(np.where(places[at] == core[one], masks[at], 0), size)
                start = start[(mask >> (start - core + BLOCK - 1) & 1) == 0]
            covered = np.zeros(len(data) + 1, np.int32)
            covered[start] += 1  # starts are distinct
            covered[start + DEPTH] -= 1
            gone = np.cumsum(covered)[:-1] > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            wide = np.concatenate(([False], gone, [False]))
            a = np.flatnonzero(wide[1:] & (~wide[:-1] | edge))
            b = np.flatnonzero(wide[:-1] & (~wide[1:] | edge))
            of = np.searchsorted(offsets, a, "right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(a - offsets[of]), pa.array(b - offsets[of])], names=["start", "end"]))
            left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
            kept = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
            yield pa.record_batch(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets).astype(np.int64)), spans, kept.cast(pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])


def _unique_windows(blocks: DataFrame) -> DataFrame:
    """(id, place, mask): the unique windows of blocks (h1, h2, before, behind, n, holder), as bits of each block."""
    total = blocks.count()
    cores = written(blocks.groupBy("h1", "h2").agg(
        F.count("*").alias("kinds"), F.min("n").alias("least"), F.min("holder").alias("holder")).where("least = 1"), "cores")
    alone = cores.where("kinds = 1").select("holder.*", F.lit(ALL).cast("long").alias("mask"))
    # blocks that share their core with others are told apart by their windows
    several = cores.where("kinds > 1").select("h1", "h2", (F.col("kinds") * HOT > total).alias("hot"))
    hot = blocks.join(F.broadcast(several.where("hot")), ["h1", "h2"], "left")
    cold = hot.where("hot IS NULL").drop("hot").join(several.where("NOT hot"), ["h1", "h2"])
    mixed = written(hot.where("hot").unionByName(cold).drop("hot").withColumn("own", F.monotonically_increasing_id()), "mixed")
    windows = mixed.select("h1", "h2", "before", "behind", "n", "own", F.explode(F.expr(
        f"sequence({BLOCK - 1} - length(before), least(length(behind), {BLOCK - 1}))")).alias("t"))
    part = [F.expr(f"substring(before, length(before) - ({BLOCK - 1} - t) + 1, {BLOCK - 1} - t)"), F.expr("substring(behind, 1, t)")]
    keyed = windows.select(
        F.xxhash64("h1", "h2", "t", *part).alias("w1"), F.xxhash64(F.lit(1), "h2", "h1", "t", *part).alias("w2"),
        F.least("n", F.lit(2)).alias("n"), (F.col("own") * BLOCK + F.col("t")).alias("seat"))
    lone = keyed.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("seat").alias("seat")).where("n = 1")
    # a window has one holder; its block's bits are put together
    bits = lone.groupBy(F.expr(f"seat div {BLOCK}").alias("own")).agg(F.expr(f"bit_or(shiftleft(1L, cast(seat % {BLOCK} AS int)))").alias("mask"))
    return alone.unionByName(mixed.select("own", "holder").join(bits, "own").select("holder.*", "mask"))


def drop_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: its bytes, the removed stretches (start and end, in bytes), what remains."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("id1"), F.xxhash64("text", F.lit(DEPTH), "doc_id").alias("id2"), "text")
    held = rows.where(F.octet_length("text") >= DEPTH)
    anchors = held.select(*ID, "text").mapInArrow(_first_digits, "gram long, id1 long, id2 long, n long")
    lone = anchors.groupBy("gram").agg(F.sum("n").alias("n"), F.min(F.struct(*ID)).alias("holder")).where("n = 1")
    lone = written(lone.groupBy("holder").agg(F.collect_list("gram").alias("grams")).select("holder.*", "grams"), "grams")
    blocks = held.join(lone, ID, "left").select(*ID, "text", "grams").mapInArrow(
        _second_digits, "h1 long, h2 long, before binary, behind binary, id1 long, id2 long, place long")
    blocks = written(blocks.groupBy("h1", "h2", "before", "behind").agg(
        F.count("*").alias("n"), F.min(F.struct(*ID, "place")).alias("holder")), "blocks")
    windows = _unique_windows(blocks).groupBy(*ID).agg(F.collect_list("place").alias("places"), F.collect_list("mask").alias("masks"))
    windows = written(windows, "windows")
    return (
        rows.join(lone, ID, "left").join(windows, ID, "left")
        .select("doc_id", "text", "grams", "places", "masks")
        .mapInArrow(_without_repeats, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"))
