"""Document fingerprints: SpotSigs.

A spot is an occurrence of a common word (anchor); its signature is the anchor with the chain of the `CHAIN` content
words that follow it, `DISTANCE` content words apart.  A document's fingerprint is the set of its signatures, written as
the sorted 32-bit hashes in hexadecimal.  Likeness is Jaccard's; sets whose sizes alone rule a threshold out are never
compared: `length_partition` puts set sizes into ranges such that only equal or neighbouring ranges can be alike, and
`pruned_jaccard` checks the sizes and then what remains as it goes.

`spot_groups` is the whole search; `successors` puts next to every document the one that follows it in descending order
of doc_id, in one range shuffle.

Defined results: words are runs of letters and digits, A-Z as a-z; only the common words `ANCHORS` are anchors; a chain
that the text's end cuts off makes no signature; in a text without a complete chain every word is an anchor and cut chains count; a null or wordless text
has the empty fingerprint.  Two empty fingerprints have likeness 1, an empty and another one 0.  Documents without id
come last in descending order, rows with equal ids are ordered by text, and after the last document the first follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .setsketch import CELL, components, link_cell
from .words import MULTIPLIER, PUNCTUATION, column_bytes, mix, row_groups, tokenize

CHAIN, DISTANCE = 2, 1
THRESHOLD = 0.75

# fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "the of and to in is a that for it as was with be by on not he this are or his from at which but have an had they "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie "
    "la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el los las por con para una su al lo como más pero sus ya o sin sobre entre cuando muy no y de"
)


def anchor_hashes() -> np.ndarray:
    data, offsets = column_bytes(pa.array([ANCHORS], pa.large_string()))
    return np.unique(tokenize(data, offsets, PUNCTUATION)[0])


def _chains(words: np.ndarray, starts: np.ndarray, spot: np.ndarray, content: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and rows of the spots (word positions); `content` lists the content words' positions.

    With `cut`, a chain that the row's end cuts off counts as it is.
    """
    row = np.searchsorted(starts, spot, "right") - 1
    first = np.searchsorted(content, spot, "right")
    last = np.searchsorted(content, starts[row + 1])  # end of the row's content
    h = words[spot] * MULTIPLIER
    whole = np.ones(len(spot), bool)
    for k in range(CHAIN):
        at = first + k * DISTANCE
        inside = at < last
        whole &= inside
        follower = np.zeros(len(spot), np.uint64)
        follower[inside] = words[content[at[inside]]]
        h = (h + follower) * MULTIPLIER
    keep = np.ones(len(spot), bool) if cut else whole
    return mix(h[keep]) >> np.uint64(32), row[keep]


def signature_sets(column: pa.Array, anchors: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct 32-bit signatures of every row."""
    data, offsets = column_bytes(column)
    for lo, hi in row_groups(offsets, 1 << 20):
        own = offsets[lo:hi + 1] - offsets[lo]
        words, _, _, starts = tokenize(data[offsets[lo]:offsets[hi]], own, PUNCTUATION)
        place = np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)
        common = anchors[place] == words
        h, row = _chains(words, starts, np.flatnonzero(common), np.flatnonzero(~common), False)
        bare = np.bincount(row, minlength=hi - lo) == 0
        if bare.any():
            word_row = np.repeat(np.arange(hi - lo), np.diff(starts))
            more, more_row = _chains(words, starts, np.flatnonzero(bare[word_row]), np.arange(len(words)), True)
            h, row = np.concatenate((h, more)), np.concatenate((row, more_row))
        keys = np.unique(row.astype(np.uint64) << np.uint64(32) | h)
        cuts = np.searchsorted(keys >> np.uint64(32), np.arange(hi - lo + 1, dtype=np.uint64))
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield low[a:b]


def fingerprint(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_partition(size: int, threshold: float = THRESHOLD) -> int:
    """Ranges [1, x), [x, y), ... whose ends grow by 1 / threshold: sets of more than neighbouring ranges are unlike."""
    return -1 if size == 0 else int(np.floor(np.log(size) / -np.log(threshold) + 1e-9))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard's likeness of two sorted sets; 0 as soon as it can't reach `floor`."""
    small, large = sorted((a, b), key=len)
    if not len(large):
        return 1.0
    if not len(small) or len(small) < floor * len(large):
        return 0.0
    most = int(np.floor(len(small) - floor / (1 + floor) * (len(small) + len(large)) + 1e-9))  # signatures that may be missing
    shared = missing = 0
    step = len(small) if floor == 0 else 64
    for at in range(0, len(small), step):
        part = small[at:at + step]
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        same = int((large[place] == part).sum())
        shared, missing = shared + same, missing + len(part) - same
        if floor and missing > most:
            return 0.0
    return shared / (len(small) + len(large) - shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures, length_partition, items) of every row of `docs` (doc_id, text)."""
    anchors = anchor_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(signature_sets(batch.column("text"), anchors))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([fingerprint(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([length_partition(len(s)) for s in sets], pa.int32()), pa.array([s.astype(np.uint64).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "fingerprint", "n_signatures", "length_partition", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, n_signatures long, length_partition int, items binary")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's first signatures: two sets that reach the threshold share one of them."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
        heads = [s[:len(s) - int(np.ceil(THRESHOLD * len(s))) + 1].astype(np.int64) for s in sets]
        yield pa.record_batch([
            batch.column("id").take(pa.array(np.repeat(np.arange(len(heads)), [len(h) for h in heads]))),
            batch.column("length_partition").take(pa.array(np.repeat(np.arange(len(heads)), [len(h) for h in heads]))),
            pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]))], names=["id", "length_partition", "signature"])


def spot_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id): documents linked by a likeness of 0.75 or more, under the smallest id that they reach.

    Equal fingerprints are one class.  Classes meet within a length partition and the next one, where they share one of
    their first signatures; a meeting of many is cut into cells, in which only links come out.
    """
    prints = materialize(fingerprints(docs), "prints")
    classes = materialize(
        prints.where("n_signatures > 0 AND doc_id IS NOT NULL").groupBy("fingerprint")
        .agg(F.min("doc_id").alias("id"), F.first("length_partition").alias("length_partition"), F.first("items").alias("items"), F.first("n_signatures").alias("n")),
        "classes")
    heads = classes.select("id", "length_partition", "items").mapInArrow(_prefixes, "id long, length_partition int, signature long")
    met = heads.select("id", F.explode(F.array("length_partition", F.col("length_partition") - 1)).alias("range"), "signature")
    held = met.join(classes.select("id", "n"), "id")
    sizes = held.groupBy("range", "signature").agg(F.count("*").alias("size"), F.ceil(F.sum("n") / CELL).cast("int").alias("blocks")).where("size > 1")
    cut = held.join(sizes, ["range", "signature"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = cut.select("id", "range", "signature", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).select(
        "id", "range", "signature", F.concat_ws(":", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))
    links = (
        placed.join(classes.select("id", F.col("id").alias("component"), "items"), "id")
        .groupBy("range", "signature", "cell").applyInArrow(_link, "a long, b long, shared long")
    )
    groups = components(materialize(links.distinct(), "links"))
    of_class = classes.select("fingerprint", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "fingerprint", F.coalesce("component", "id").alias("group_id"))
    return prints.select("doc_id", "fingerprint").join(of_class, "fingerprint", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")).alias("group_id"))


def _link(cell: pa.Table) -> pa.Table:
    return link_cell(cell)


def successors(docs: DataFrame, batch_function, ddl: str) -> DataFrame:
    """Applies `batch_function(doc_ids, texts, next_texts) -> RecordBatch` to all of `docs` (doc_id, text) in pieces.

    Documents are dealt to ranges of doc_id; the first of each range (one row) is also sent to the range before it, so
    one shuffle is enough, and a task holds one Arrow batch at a time.  The range ends come from a sketch of the ids.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(key.alias("key"))
    found = ids.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 20 * parts).alias("ends")).first()
    ends = np.unique(np.array(found["ends"] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(k):
        import pandas as pd

        return pd.Series(len(ends) - np.searchsorted(ends, k.to_numpy(), "left")).astype("int32")  # descending

    heads = ids.select("key", range_of("key").alias("range")).groupBy("range").agg(F.max("key").alias("head")).orderBy("range").collect()
    # the range before that of each head; before the first one the last
    before = {h["head"]: heads[n - 1]["range"] for n, h in enumerate(heads)}

    @F.pandas_udf("int")
    def also_in(k):
        import pandas as pd

        return pd.Series([before.get(x, -1) for x in k.tolist()], dtype="int32")

    places = F.array(F.struct(F.lit(0).alias("copy"), F.col("own").alias("range")), F.struct(F.lit(1).alias("copy"), F.col("other").alias("range")))
    dealt = (
        rows.withColumn("key", key).withColumn("own", range_of("key")).withColumn("other", also_in("key"))
        .select("doc_id", "text", "key", F.explode(F.filter(places, lambda p: p["range"] >= 0)).alias("p"))
        .select("doc_id", "text", "key", "p.copy", "p.range")
    )
    sorted_ = dealt.repartitionById(len(heads) or 1, F.col("range")).sortWithinPartitions("range", "copy", F.desc("key"), "text").select("doc_id", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            doc, text, copy = (batch.column(c).to_pylist() for c in ("doc_id", "text", "copy"))
            text = [t or "" for t in text]
            own = [n for n, c in enumerate(copy) if not c]
            last = own[-1] if own else -1
            todo, nexts = [], []
            if held is not None and text:
                todo, nexts, held = [held], [text[0]], None
            for n in own[:-1]:
                todo.append((doc[n], text[n]))
                nexts.append(text[n + 1])
            if own:
                if last + 1 < len(text):
                    todo.append((doc[last], text[last]))
                    nexts.append(text[last + 1])
                else:
                    held = (doc[last], text[last])
            if todo:
                yield batch_function([d for d, _ in todo], [t for _, t in todo], nexts)

    return sorted_.mapInArrow(run, ddl)


EDIT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "n_signatures long, length_partition int"
)


def edit_batch(anchors: np.ndarray):
    """Fingerprints of texts and of their edited versions: the last third replaced by the start of the next text."""
    def run(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
        own = list(signature_sets(pa.array(texts, pa.large_string()), anchors))
        new = list(signature_sets(pa.array(edited, pa.large_string()), anchors))
        # a next text is most often the following row's own text
        at = [k + 1 if k + 1 < len(texts) and nexts[k] is texts[k + 1] else None for k in range(len(texts))]
        rest = iter(signature_sets(pa.array([nexts[k] for k, x in enumerate(at) if x is None], pa.large_string()), anchors))
        following = [next(rest) if x is None else own[x] for x in at]
        return pa.record_batch([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([fingerprint(s) for s in own]), pa.array([fingerprint(s) for s in new]),
            pa.array([pruned_jaccard(a, b) for a, b in zip(own, new, strict=True)]), pa.array([pruned_jaccard(a, b) for a, b in zip(own, following, strict=True)]),
            pa.array([len(s) for s in own], pa.int64()), pa.array([length_partition(len(s)) for s in own], pa.int32()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "length_partition"])
    return run


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its fingerprint, its edited text's, and their likeness and that of the next text's."""
    return successors(docs, edit_batch(anchor_hashes()), EDIT_DDL)
