"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles.  Register i is the exponentially spaced, truncated minimum of
the set's i-th exponential hashes: K = clamp(1 + floor(-log_b x), 0, q + 1).  Sketches of parts merge by the larger
register.  Groups of registers are bands; documents that share a band are candidates.  The likelihood of a pair's
greater, smaller and equal registers, with both set sizes known, rejects pairs whose maximum lies below a floor far
under the threshold; every remaining pair is confirmed on its full sets.

Groups of any size: equal sets are one class, before anything else.  In a band each class meets the band's most central
member and its smallest one, so a group of n near copies makes O(n) candidates.  Where a band still holds several
components, the pairs across components are compared: as rows in small bands; bands of many classes with the same
central member form one crowd, in which each text outside the largest component is held against all others, block by
block: the full sets meet in memory and only links come out.  Connected components come from a distributed large-star /
small-star iteration.

Defined results: words are runs of non-space characters, A-Z as a-z; a text of one to four words is one shingle; a null
or wordless text has the empty set, is linked with nothing and keeps its own id.  Rows with equal doc_id are one
document if their texts have the same set; otherwise each row counts on its own and they share the id.  A row without
doc_id is linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .words import MULTIPLIER, SPACES, column_bytes, mix, row_groups, shingles, tokenize

WORDS = 5
REGISTERS, ROWS = 512, 7  # a pair at 0.75 shares one of 73 bands with probability 0.99997
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
FLOOR = 0.64  # of the likelihood: 5.5 standard deviations of the estimate below 0.75
SMALL_BAND, CELL = 12, 150_000

_seeds = np.random.Generator(np.random.PCG64(7))
FLIPS = _seeds.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
FACTORS = _seeds.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of one non-empty set of 64-bit hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, ((short[at:at + 512, None] ^ FLIPS) * FACTORS).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(1 + np.floor(-np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: bytes, b: bytes) -> bytes:
    """Registers of the union of two sets."""
    return np.maximum(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)).tobytes()


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, offsets = column_bytes(column)
    for lo, hi in row_groups(offsets):
        own = offsets[lo:hi + 1] - offsets[lo]
        words, _, _, starts = tokenize(data[offsets[lo]:offsets[hi]], own, SPACES)
        h, at = shingles(words, starts, WORDS)
        for r in range(hi - lo):
            yield np.unique(h[at[r]:at[r + 1]])


def bands_of(registers: np.ndarray) -> np.ndarray:
    """One 64-bit value per group of ROWS registers, different for equal groups at different places."""
    groups = registers[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
    for r in range(ROWS):
        h = mix(h * MULTIPLIER + groups[:, r])
    return h.view(np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands = [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(bands_of(registers_of(s)) if len(s) else np.zeros(0, np.int64))
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        flat = pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(starts), flat)], schema=SKETCH)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch_batches, SKETCH_DDL)


def _spread(u: np.ndarray) -> np.ndarray:
    return -np.log1p(-u * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_slope(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: float) -> np.ndarray:
    """Derivative of the log likelihood of similarity j, per pair (rows of registers).  The likelihood is concave, so
    a slope of 0 or more says that the estimate is at least j."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    same = regs_a.shape[1] - more - less
    c = (BASE - 1) / BASE
    xa, xb = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    pa_, pb = _spread(xa), _spread(xb)
    da = -v * c / (1 - xa * c) / np.log(BASE)
    db = -u * c / (1 - xb * c) / np.log(BASE)
    return more * da / pa_ + less * db / pb - same * (da + db) / np.maximum(1 - pa_ - pb, 1e-9)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of each pair, by bisection on the slope."""
    lo, hi = np.zeros(len(n_a)), np.minimum(n_a / n_b, n_b / n_a)
    for _ in range(30):
        mid = (lo + hi) / 2
        up = np.array([likelihood_slope(regs_a[i:i + 1], regs_b[i:i + 1], n_a[i:i + 1], n_b[i:i + 1], float(m))[0] >= 0 for i, m in enumerate(mid)])
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return lo


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, registers, items): a document's set itself, as sorted 64-bit hashes."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            sets = list(shingle_sets(batch.column("text")))
            yield pa.record_batch([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers_of(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "registers", "items"])


def confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with sizes, registers and sets: those whose likelihood reaches the floor and whose full sets
    reach the threshold."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):  # a pair weighs its two sets: few are copied at a time
            batch = whole.slice(at, 256)
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb"))
            keep = (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb)) & (likelihood_slope(ra, rb, na, nb, FLOOR) >= 0)
            shared = np.zeros(len(keep), np.int64)
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("ia", "ib"))
                shared[i] = len(np.intersect1d(x, y, assume_unique=True))
            keep &= 100 * shared >= 75 * (na + nb - shared)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(shared)], names=["a", "b", "shared"]).filter(pa.array(keep))


def link_cell(cell: pa.Table) -> pa.Table:
    """Links of one cell (id, component, items) that join different components, as a spanning forest: each set that asks
    (a column `asks`; without it, each outside the largest component) is held against all others."""
    ids = cell.column("id").to_numpy()
    label = np.unique(cell.column("component").to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("items").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    found = []
    asks = cell.column("asks").to_numpy() if "asks" in cell.column_names else label != np.bincount(label).argmax()
    for x in np.flatnonzero(asks):
        mark = np.zeros(codes.max() + 1, np.int64)
        mark[codes[starts[x]:starts[x + 1]]] = 1
        shared = np.add.reduceat(mark[codes], starts[:-1])
        for y in np.flatnonzero(100 * shared >= 75 * (sizes[x] + sizes - shared)):
            if label[y] != label[x]:
                found.append((max(ids[x], ids[y]), min(ids[x], ids[y]), shared[y]))
                label[label == label[y]] = label[x]
    a, b, n = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "shared": pa.array(n, pa.int64())})


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (a, b), for every node with an edge."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(sketch(docs), "sketches")
    classes = materialize(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    # an id borne by several different sets stands for all of them
    bands = classes.select("id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")
    members = materialize(bands.join(shared, "band"), "members")
    # of a band's members the one that meets most others is likely to be the text the others were copied from
    degree = members.select("band", "id", F.sum("size").over(Window.partitionBy("id")).alias("degree"))  # BANDS rows of an id at most
    central = materialize(degree.groupBy("band").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("central")), "central")
    first = members.join(central, "band").select("id", F.explode(F.array("central", "least")).alias("p"))
    links = materialize(_confirmed(docs, first.where("id <> p")), "links")
    labels = materialize(components(links), "labels")

    # what the first meeting left apart
    known = members.select("band", "id").distinct().join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("component"))
    apart = known.groupBy("band").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = materialize(known.join(apart.select("band", "size"), "band"), "open")
    small = open_.where(F.col("size") <= SMALL_BAND)
    pairs = small.join(small.select("band", F.col("id").alias("p"), F.col("component").alias("other")), "band").where("id > p AND component <> other")
    crowds = open_.where(F.col("size") > SMALL_BAND).join(central, "band").select("central", "id", "component").distinct()
    more = materialize(_confirmed(docs, pairs), "links").unionByName(materialize(_by_cells(docs, crowds), "links"))
    labels = components(links.unionByName(more))

    of_class = classes.select("set_key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id"))
    return sketches.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, registers, items) of the asked documents."""
    # a merge join at every size: neither side has a bound, so none is broadcast
    asked = docs.select(F.col("doc_id").alias("id"), "text").hint("merge").join(ids.distinct(), "id")
    return materialize(asked.mapInArrow(set_batches, "id long, n long, registers binary, items binary").where("n > 0"), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared) of the pairs (id, p) that pass the likelihood and then the full sets."""
    pairs = materialize(pairs.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct(), "pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"), F.col("items").alias(f"i{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    return met.mapInArrow(confirm_batches, "a long, b long, shared long").distinct()


def _placed(sized: DataFrame) -> DataFrame:
    """(central, cell, id, component, asks): the cells of every member of a crowd (central, id, component, n).

    A crowd is cut into blocks of at most about CELL set elements, and its texts outside the largest component, which ask,
    once more into such blocks.  Each pair of an asking and a member block is one cell, so a member is repeated for each
    block of those that ask and not for each block of the crowd."""
    parts = sized.groupBy("central", "component").agg(F.sum("n").alias("n"))
    crowds = parts.groupBy("central").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).select(
        "central", F.col("most.component").alias("largest"), F.ceil(F.col("n") / CELL).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("most.n")) / CELL).cast("int").alias("asking"))
    cut = sized.join(crowds.where("asking > 0"), "central")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = F.transform(every("asking"), lambda a: F.struct(a.alias("a"), block("blocks").alias("b"), F.lit(False).alias("asks")))
    asker = F.transform(every("blocks"), lambda b: F.struct(block("asking").alias("a"), b.alias("b"), F.lit(True).alias("asks")))
    both = F.when(F.col("component") == F.col("largest"), member).otherwise(F.concat(member, asker))
    return cut.select("central", "id", "component", F.explode(both).alias("at")).select(
        "central", F.concat_ws(":", "at.a", "at.b").alias("cell"), "id", "component", "at.asks")


def _by_cells(docs: DataFrame, crowds: DataFrame) -> DataFrame:
    """Links across components within crowds (central, id, component).  Only links leave a cell."""
    crowds = materialize(crowds, "crowds")
    sets = _sets(docs, crowds.select("id"))
    sized = materialize(crowds.join(sets.groupBy("id").agg(F.sum("n").alias("n")), "id"), "crowds")
    cells = _placed(sized).join(sets.select("id", "items"), "id").select("central", "cell", "id", "component", "asks", "items")
    return cells.groupBy("central", "cell").applyInArrow(link_cell, "a long, b long, shared long").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest doc_id (and every row that bears it)."""
    gone = near_duplicates(docs).where("NOT kept").select(F.struct("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("of"))
    return rows.join(gone, F.col("of") == F.col("gone.doc_id"), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
