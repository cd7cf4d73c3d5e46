"""Secrets in texts: fixed patterns, and strings that a token vocabulary encodes poorly.

Base kinds: `assign` (a secret-like name set to 8 or more characters), `access` (AKIA keys of 16 or more characters) and
`hex` (32 or more hexadecimal digits); each leftmost and non-overlapping, failing matches dropped after matching.  The
method adds kind `random`: a run of 20 or more characters of `[A-Za-z0-9+/_=-]` that overlaps no base span, mixes at
least two of lower case, upper case and digits, and has fewer than `RATIO` characters per token of the vocabulary.
Where the whole run does not, the same is asked of its parts between `+/_=-`: of neighbouring parts that are no words of four
or more characters, UUIDs or digests, together and one by one, so that words beside a random string do not hide it; the
part is the span then.  Words joined to a random string without a separator count with it.
Natural words reach 3 to 5 characters a token, random strings about 1.5 to 2.  Excluded first: known digests (runs of
only hexadecimal digits in either case, of 32, 40, 56, 64, 96 or 128), UUIDs, and identifiers, that is runs whose parts
between separators and case changes are all words (letters only, up to 24 of them) or numbers of up to 8 digits.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive, ordered by start, then by
kind as listed; a run of any length is read whole, in blocks of 512 characters, so that the work stays linear.  Rows
are judged one by one: repeated rows repeat their results, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the byte-level BPE splitting pattern of that vocabulary (fixed value)
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
RATIO, BLOCK, SHORTEST = 2.3, 512, 20

# fixed patterns of the base kinds
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PART = re.compile(rf"(?<![A-Za-z0-9])({UUID.pattern})(?![A-Za-z0-9])|[A-Za-z0-9]+")
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,24}|[A-Z]{2,24}|[A-Za-z]|[0-9]{1,8})")
DIGESTS = {32, 40, 56, 64, 96, 128}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Parts are words and short numbers, each wholly matched; words, and numbers that stand alone, make up most of it."""
    plain = 0
    for part in re.split(r"[_/+=-]+", run):
        if part.isdigit() and len(part) <= 8:
            plain += len(part)
            continue
        at = 0
        while at < len(part):
            m = IDENTIFIER.match(part, at)
            if not m:
                return False
            if len(m[0]) > 2 and m[0][0].isalpha():
                plain += len(m[0])
            at = m.end()
    return 4 * plain >= 3 * sum(c.isalnum() for c in run)


def chars_per_token(run: str, path: str = VOCABULARY) -> float:
    enc = encoding(path)
    return len(run) / max(1, sum(len(enc.encode_ordinary(run[i:i + BLOCK])) for i in range(0, len(run), BLOCK)))


def looks_random(run: str, path: str = VOCABULARY) -> bool:
    kinds = any(c.islower() for c in run) + any(c.isupper() for c in run) + any(c.isdigit() for c in run)
    if kinds < 2 or UUID.fullmatch(run) or len(run) in DIGESTS and DIGEST.fullmatch(run):
        return False
    return chars_per_token(run, path) < RATIO and not is_identifier(run)


def random_parts(run: str, path: str = VOCABULARY) -> Iterator[tuple[int, int]]:
    """Start and end of what looks random in a run: the whole, or else stretches of its parts, or single parts."""
    if looks_random(run, path):
        yield 0, len(run)
        return
    stretches: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(run):
        known = m[1] or len(m[0]) in DIGESTS and DIGEST.fullmatch(m[0])
        if known or len(m[0]) >= 4 and is_identifier(m[0]):
            stretches.append([])
        else:
            stretches[-1].append(m.span())
    for parts in stretches:
        odd = [i for i, part in enumerate(parts) if not is_identifier(run[slice(*part)])]
        parts = parts[odd[0]:odd[-1] + 1] if odd else []
        for a, b in [(parts[0][0], parts[-1][1])] if parts else []:
            if b - a >= SHORTEST and looks_random(run[a:b], path):
                yield a, b
            elif len(parts) > 1:
                yield from ((c, d) for c, d in parts if d - c >= SHORTEST and looks_random(run[c:d], path))


def scan(text: str, path: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind."""
    spans = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for m in RUN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][1])
            k += 1
        if reach <= m.start():
            spans += [("random", m.start() + a, m.start() + b) for a, b in random_parts(m[0], path)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t or "", path) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([
                batch.column("doc_id"),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found],
                         pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_batches(vocabulary), "doc_id long, spans array<struct<kind string, start long, end long>>")


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the base spans as kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "random").encode()).hexdigest()
