"""SentencePiece segmentations sampled without replacement by a perturbed best-first search.

The lattice of a text holds every way to write it in vocabulary pieces; a segmentation's probability is proportional to
the product of its pieces' weights (a power law of the vocabulary's merge rank).  No piece crosses from a letter to a
following space, so the lattice of a text is the chain of its words' lattices, and one lattice is made per distinct word
of a group of texts.  Backward sums give each edge its exact conditional probability.

Gumbel top-k: the first sample has the largest perturbed log probability.  Every subtree "same pieces up to step t, a
different one there" holds its own largest one, a Gumbel truncated at its parent's; a frontier of all open subtrees is
searched best first, and each pop is the next distinct sample.  With kappa the largest value left in the frontier,
the inclusion score is log(1 - exp(-exp(log p - kappa))).  Random numbers are a hash of (seed, row key, sample, word,
step), so a row gets the same samples in any batch or task.

Characters without a piece, and the space mark U+2581 itself, are written in byte pieces; a space is put before the text
and taken off again, so `decode` restores every text exactly.

Defined results: a null or empty text has one sample of no pieces with log probability 0; a text with fewer than k
segmentations has all of them, the last with inclusion score 0; a null row key counts as 0; repeated rows get
equal samples; a word of any length is one lattice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import INVERSE, MULTIPLIER, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, EXPONENT = 2, 17, 1.0
GROUP_CHARS = 300_000  # of a group's distinct words the lattices are held at once
BATCH_ROWS = 1_000
SPACE = 0x2581
MASKED = 0x110000  # stands for U+2581 inside a text: has no piece
BYTE_WEIGHT = -12.0
EPOCH = 8
OUT_DDL = "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, log_inclusion double, restored boolean"


class Vocabulary:
    """Pieces of a SentencePiece model, and prefix tables for matching many places at once."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(not re.fullmatch("▁*[^▁\n]*", self.pieces[i]) for i in plain):
            raise ValueError("a piece crosses into a following word or line")
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.weight = np.full(n, -np.inf)
        self.weight[ranked] = -EXPONENT * np.log(np.arange(len(ranked)) + 2.0)
        self.likely = np.exp(self.weight)
        spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.ascii_id = np.full(128, -1, np.int64)
        for c, i in self.byte_id.items():
            if c < 0x80:
                self.ascii_id[c] = i
        levels: dict[int, dict[int, int]] = {}
        for i in plain:
            h = 0
            for k, c in enumerate(self.pieces[i], 1):
                h = self._step(h, ord(c))
                level = levels.setdefault(k, {})
                level.setdefault(h, -1)
            level[h] = i
        self.longest = max(levels)
        self.levels = []
        for k in range(1, self.longest + 1):
            hashes = np.array(sorted(levels[k]), np.uint64)
            key = (hashes >> np.uint64(46)).astype(np.int64)
            seen = np.bincount(key, minlength=1 << 18).astype(np.uint8)
            slot = np.zeros(1 << 18, np.int32)
            slot[key] = np.arange(len(hashes))
            self.levels.append((hashes, np.array([levels[k][int(h)] for h in hashes], np.int32), seen > 0, slot, seen > 1))

    @staticmethod
    def _step(h: int, c: int) -> int:
        x = ((h ^ c) * int(MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 29)

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the prefixes of k + 1 characters, -1 where there is none."""
        hashes, _, _, slot, shared = self.levels[k]
        key = (h >> np.uint64(46)).astype(np.int64)
        place = slot[key]
        wrong = hashes[place] != h
        again = np.flatnonzero(wrong & shared[key])
        place[wrong] = -1
        if len(again):
            other = np.minimum(np.searchsorted(hashes, h[again]), len(hashes) - 1)
            place[again] = np.where(hashes[other] == h[again], other, -1)
        return place

    def encode_bytes(self, code: int) -> list[int]:
        return [self.byte_id[b] for b in chr(SPACE if code == MASKED else code).encode()]

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids, with characters that have no piece (-code - 1) in byte pieces."""
        return self.ids_of_all([pieces])[0]

    def ids_of_all(self, samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """`ids` of many samples, one after the other, and the number of ids of each."""
        pieces = np.concatenate([*samples, np.zeros(0, np.int64)])
        size = np.array([len(x) for x in samples], np.int64)
        bare = np.flatnonzero(pieces < 0)
        codes = -pieces[bare] - 1
        plain = codes < 0x80
        pieces[bare[plain]] = self.ascii_id[codes[plain]]
        bare, codes = bare[~plain], codes[~plain]
        if not len(bare):
            return pieces, size
        kinds, kind = np.unique(codes, return_inverse=True)
        spelled = [self.encode_bytes(c) for c in kinds.tolist()]
        more = np.zeros(len(pieces), np.int64)
        more[bare] = np.array([len(x) for x in spelled])[kind] - 1
        out = np.repeat(pieces, more + 1)
        at = bare + np.cumsum(more[bare]) - more[bare]  # where the bytes of each character begin
        for j in range(int(more.max()) + 1):
            on = more[bare] >= j
            out[at[on] + j] = np.array([x[j] if j < len(x) else -1 for x in spelled])[kind[on]]
        ends = np.cumsum(size)
        grown = np.concatenate((np.zeros(1, np.int64), np.cumsum(more)))
        return out, size + grown[ends] - grown[ends - size]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of piece ids, and the bytes of each."""
        size = self.spelled_size[ids]
        at = np.repeat(self.spelled_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.spelled[at], size

    def decode(self, ids) -> str:
        """The text of piece ids; the leading space is taken off."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            raise ValueError("unknown piece id")
        out = self.spell(ids)[0].tobytes().decode(errors="replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Lattices of many words.

    Words are taken longest first, and the node of word i that is t characters before the word's end has number
    level[t] + i: nodes at one distance from the end are consecutive, and so are the edges of one node.
    """

    def __init__(self, code: np.ndarray, length: np.ndarray, voc: Vocabulary) -> None:
        """`code`: the words' characters one after the other (as code points), `length`: characters per word."""
        by_length = np.argsort(-length, kind="stable")
        rank = np.empty_like(by_length)
        rank[by_length] = np.arange(len(length))
        longest = int(length.max())
        # words of at least t characters, t = 0, 1, ...
        at_least = len(length) - np.concatenate(([0], np.cumsum(np.bincount(length, minlength=longest + 1))))[:longest + 1]
        level = np.concatenate(([0], np.cumsum(at_least)))
        n = int(level[-1])
        self.first_node = level[length] + rank
        # every word with one more place, its end; places to the end, and the node of each place
        size = length + 1
        left = (np.repeat(np.cumsum(size), size) - np.arange(len(code) + len(length)) - 1).astype(np.int32)
        place = (level[left] + np.repeat(rank, size)).astype(np.int32)
        inside = np.flatnonzero(left).astype(np.int32)
        letters = np.zeros(len(left), np.uint64)
        letters[inside] = np.where(code == SPACE, MASKED, np.where(code == 0x20, SPACE, code))
        matched = []
        at, h = inside, np.zeros(len(inside), np.uint64)
        single = np.zeros(len(left), bool)
        for k, (_, ids, seen, _, _) in enumerate(voc.levels):
            if k:
                fits = left[at] > k
                at, h = at[fits], h[fits]
            h = (h ^ letters[at + k]) * MULTIPLIER
            h ^= h >> np.uint64(29)
            maybe = seen[h >> np.uint64(46)]
            at, h = at[maybe], h[maybe]
            known = voc.find(k, h)
            same = known >= 0
            at, h, piece = at[same], h[same], ids[known[same]]
            if not len(at):
                break
            whole = piece >= 0
            matched.append((place[at[whole]], place[at[whole] + k + 1], piece[whole]))
            if k == 0:
                single[at[whole]] = True
        bare = inside[~single[inside]]  # characters in bytes
        matched.append((place[bare], place[bare + 1], -letters[bare].astype(np.int32) - 1))
        self.count = np.zeros(n, np.int64)
        for x, _, _ in matched:
            self.count[x] += 1
        self.first = np.cumsum(self.count) - self.count
        total = int(self.count.sum())
        self.end, self.piece = np.empty(total, np.int32), np.empty(total, np.int32)
        free = self.first.copy()
        for x, end, piece in matched:
            slot = free[x]
            self.end[slot], self.piece[slot] = end, piece
            free[x] = slot + 1
        q = voc.likely.take(self.piece, mode="clip")
        odd = np.flatnonzero(self.piece < 0)
        q[odd] = np.exp([BYTE_WEIGHT * len(voc.encode_bytes(c)) for c in (-self.piece[odd] - 1).tolist()])
        self.node = np.repeat(np.arange(n, dtype=np.int32), self.count)  # the node that an edge leaves
        # the summed weights of all ways to the end of the word, from the end backwards, give each edge its probability;
        # a word's sums are in units of a power of two that moves every EPOCH places: no word is too long for it and no
        # character too rare
        part, power = np.ones(n), np.zeros(n, np.int64)
        for t in range(1, longest + 1):
            a, b = level[t], level[t + 1]
            lo, hi = self.first[a], self.first[b - 1] + self.count[b - 1]
            seg, size, end = self.first[a:b] - lo, self.count[a:b], self.end[lo:hi]
            x = q[lo:hi] * part[end]
            if t > EPOCH:
                power[a:b] = power[level[t - 1]:level[t - 1] + b - a]  # the word's one place further on
                x = np.ldexp(x, (power[end] - np.repeat(power[a:b], size)).astype(np.int32))
            part[a:b] = np.add.reduceat(x, seg)
            q[lo:hi] = x / np.repeat(part[a:b], size)
            if t % EPOCH == 0:
                part[a:b], moved = np.frexp(part[a:b])
                power[a:b] += moved
        self.q = q
        with np.errstate(divide="ignore"):
            self.log_q = np.log(q)
        # running sums of each node's edges, in whole parts of 2**-52: differences of the whole running sum are exact
        running = np.cumsum((q * 2.0**52).astype(np.uint64))
        inner = np.flatnonzero(self.count > 0)
        base = np.concatenate((np.zeros(1, np.uint64), running))[self.first[inner]]
        self.upto = (running - np.repeat(base, self.count[inner])).astype(np.float64) * 2.0**-52
        self.upto[self.first[inner] + self.count[inner] - 1] = 2.0  # the last edge takes what is left

    def beside(self, edge: int) -> np.ndarray:
        """All edges of the node that an edge leaves."""
        node = self.node[edge]
        return np.arange(self.first[node], self.first[node] + self.count[node])

    def others(self, edges: np.ndarray) -> np.ndarray:
        """The summed probability of the edges beside each edge."""
        out = -np.expm1(self.log_q[edges])
        sure = np.flatnonzero(out < 1e-6)  # too near to 1 for a difference: added up one by one
        node = self.node[edges[sure]]
        first, count, total = self.first[node], self.count[node], np.zeros(len(sure))
        for j in range(int(count.max(initial=0))):
            on = np.flatnonzero((count > j) & (first + j != edges[sure]))
            total[on] += self.q[first[on] + j]
        out[sure] = total
        return out

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random walks from `nodes` to the ends of their words: all edges in order, and the number of edges of each."""
        nodes = nodes.copy()
        items = np.flatnonzero(self.count[nodes] > 0)
        steps = []
        lengths = np.zeros(len(nodes), np.int64)
        step = 0
        while len(items):
            u = uniform(keys[items] + np.uint64((step * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
            low = self.first[nodes[items]]
            e = low + self.count[nodes[items]] - 1  # from the longest piece, which is drawn most often, to shorter ones
            more = np.flatnonzero(e > low)
            more = more[u[more] < self.upto[e[more] - 1]]
            while len(more):
                e[more] -= 1
                more = more[e[more] > low[more]]
                more = more[u[more] < self.upto[e[more] - 1]]
            steps.append((items, e))
            lengths[items] += 1
            nodes[items] = self.end[e]
            items = items[self.count[self.end[e]] > 0]
            step += 1
        at = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int64)
        for k, (i, e) in enumerate(steps):
            out[at[i] + k] = e
        return out, lengths


def uniform(keys: np.ndarray) -> np.ndarray:
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Search:
    """The frontier of one text: subtrees beside the paths drawn so far, each with its largest perturbed value."""

    def __init__(self, key: np.uint64) -> None:
        self.key = key
        self.paths: list[np.ndarray] = []
        self.scores: list[float] = []
        self.open: list[tuple[int, np.ndarray]] = []  # first step, values of the subtrees beside a path
        self.barred: dict[tuple[int, int], list[int]] = {}

    def best(self) -> tuple[int, int, float]:
        """(path, step, value) of the best open subtree; value -inf if none is left."""
        found = (0, 0, -np.inf)
        for number, (since, values) in enumerate(self.open):
            if len(values):
                k = int(np.argmax(values))
                if values[k] > found[2]:
                    found = (number, since + k, float(values[k]))
        return found

    def pop(self, lat: Lattices, number: int, step: int) -> tuple[int, list[int]]:
        """Closes a subtree: the edge that its best path takes at `step`, and the edges used up there before it."""
        since, values = self.open[number]
        values[step - since] = -np.inf
        taken = [*self.barred.get((number, step), []), int(self.paths[number][step])]
        edges = lat.beside(taken[0])
        for t in taken:
            edges = edges[edges != t]
        weights = np.cumsum(np.exp(lat.log_q[edges] - lat.log_q[edges].max()))
        u = uniform(np.array([self.key + np.uint64(len(self.paths)) * np.uint64(0x9FB21C651E98DF25)]))[0]
        return int(edges[min(np.searchsorted(weights, u * weights[-1], "right"), len(edges) - 1)]), taken


def spread(lat: Lattices, turns: list[tuple[Search, np.ndarray, float, int, list[int]]]) -> None:
    """Adds drawn paths (search, path, value, since, barred) to their searches: a path leaves its parent at step
    `since`, where the edges `barred` and its own are used up, and the subtrees beside its later steps open."""
    size = np.array([len(t[1]) for t in turns])
    since = np.array([t[3] for t in turns])
    start = np.cumsum(size) - size
    path = np.concatenate([t[1] for t in turns])
    log_q = lat.log_q[path]
    scores = np.add.reduceat(log_q, start)
    keys = np.array([t[0].key + np.uint64((len(t[0].paths) * 0x14057B7EF767814F) & 0xFFFFFFFFFFFFFFFF) for t in turns], np.uint64)
    # steps with a way beside the path
    spare = lat.count[lat.node[path]] - 1
    part_used = {int(start[i] + since[i]): t[4] for i, t in enumerate(turns) if t[4]}
    for at, barred in part_used.items():
        spare[at] -= len(barred)
    turn = np.repeat(np.arange(len(turns)), size)
    step = np.arange(len(path)) - start[turn]
    open_ = np.flatnonzero((spare > 0) & (step >= since[turn]))
    used = lat.others(path[open_])
    for i in np.searchsorted(open_, sorted(part_used)):
        if i < len(open_) and int(open_[i]) in part_used:
            beside = lat.beside(int(path[open_[i]]))
            for edge in (*part_used[int(open_[i])], path[open_[i]]):
                beside = beside[beside != edge]
            used[i] = lat.q[beside].sum()
    before = np.concatenate([np.cumsum(log_q[a:a + n]) for a, n in zip(start, size, strict=True)]) - log_q
    e = -np.log(uniform(keys[turn[open_]] + np.uint64(0x5851F42D4C957F2D) * (step[open_] + 1).astype(np.uint64)))
    parent = np.array([t[2] for t in turns])
    values = np.full(len(path), -np.inf)
    with np.errstate(divide="ignore"):
        values[open_] = -np.logaddexp(-parent[turn[open_]], np.log(e) - before[open_] - np.log(used))
    for (s, own, _, at, barred), score, a, n in zip(turns, scores, start, size, strict=True):
        if barred:
            s.barred[len(s.paths), at] = barred
        s.paths.append(own)
        s.scores.append(float(score))
        s.open.append((at, values[a + at:a + n]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(1 << max(16, n.bit_length()))


@lru_cache(maxsize=4)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (MULTIPLIER, INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of " " + text for all texts: (kind of each word, first word of each text, characters of the kinds,
    characters per kind).

    A word is a run of spaces with the letters after it, or a run of line ends, which no piece holds.
    """
    code = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 if t else 0 for t in texts])
    text_at = np.cumsum(size) - size
    space, line = code == 0x20, code == 0x0A
    begin = np.ones(len(code), bool)
    begin[1:] = (line[1:] != line[:-1]) | (space[1:] & ~space[:-1])
    begin[text_at[size > 0]] = True
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(code)))
    up, down = _powers(len(code))
    running = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * up[:len(code)], out=running[1:])
    h = mix((running[start + length] - running[start]) * down[start] ^ (length.astype(np.uint64) << np.uint64(40)))
    _, one, kind = np.unique(h, return_index=True, return_inverse=True)
    own = length[one]
    at = np.repeat(start[one] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    firsts = np.searchsorted(start, np.append(text_at, len(code)))
    return kind, firsts, code[at].astype(np.int64), own


def sample_group(texts: list[str], keys: np.ndarray, k: int, voc: Vocabulary) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """Per text its samples: (piece ids, log probability, log inclusion score)."""
    if not any(texts):
        yield from ([(np.zeros(0, np.int64), 0.0, 0.0)] for _ in texts)
        return
    with np.errstate(over="ignore"):
        kind, starts, code, length = split_words(texts)
        lat = Lattices(code, length, voc)
        keys = mix(keys + np.uint64(SEED))
        node = lat.first_node[kind]
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        number = (np.arange(len(kind)) - starts[text_of]).astype(np.uint64)
        word_keys = lambda rows, no, s: mix(keys[rows] + np.uint64(s + 1) * np.uint64(0xA0761D6478BD642F)) + no * np.uint64(0xE7037ED1A0B428DB)
        edges, lengths = lat.draw(node, word_keys(text_of, number, 0))
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        top = -np.log(-np.log(uniform(keys ^ np.uint64(0x2545F4914F6CDD1D))))
        searches = [Search(key) for key in keys]
        full = np.flatnonzero(np.diff(starts) > 0)
        spread(lat, [(searches[r], edges[cuts[starts[r]]:cuts[starts[r + 1]]], float(top[r]), 0, []) for r in full])
        words_of = [[lengths[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]  # edges per word of each path
        for i in range(1, k):
            turns, nodes, rows, numbers = [], [], [], []
            for r in full:
                s = searches[r]
                path, step, value = s.best()
                if value == -np.inf:
                    continue
                edge, taken = s.pop(lat, path, step)
                w = int(np.searchsorted(np.cumsum(words_of[r][path]), step, "right"))
                rest = np.concatenate(([lat.end[edge]], node[starts[r] + w + 1:starts[r + 1]]))
                turns.append((r, path, step, value, edge, taken, w, len(rest)))
                nodes.append(rest)
                rows.append(np.full(len(rest), r))
                numbers.append(np.arange(w, w + len(rest)))
            if not turns:
                break
            drawn, drawn_lengths = lat.draw(np.concatenate(nodes), word_keys(np.concatenate(rows), np.concatenate(numbers).astype(np.uint64), i))
            ends = np.concatenate(([0], np.cumsum(drawn_lengths)))
            item, added = 0, []
            for r, path, step, value, edge, taken, w, n in turns:
                own = drawn_lengths[item:item + n]
                s = searches[r]
                new = np.concatenate((s.paths[path][:step], [edge], drawn[ends[item]:ends[item + n]]))
                before = words_of[r][path][:w]
                inside = step - int(before.sum()) + 1 + int(own[0])
                words_of[r].append(np.concatenate((before, [inside], own[1:])))
                added.append((s, new, value, step, taken))
                item += n
            spread(lat, added)
        for s in searches:
            if not s.paths:
                yield [(np.zeros(0, np.int64), 0.0, 0.0)]
                continue
            kappa = s.best()[2]
            yield [(lat.piece[p], score, log_inclusion(score, kappa)) for p, score in zip(s.paths, s.scores, strict=True)]


def log_inclusion(score: float, kappa: float) -> float:
    """log(1 - exp(-exp(score - kappa)))."""
    if kappa == -np.inf:
        return 0.0
    x = score - kappa
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_CHARS):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _batches(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi in _groups(texts):
                row, sample, flat, scores, inclusions = [], [], [], [], []
                for r, samples in enumerate(sample_group(texts[lo:hi], ids[lo:hi], k, voc), lo):
                    for i, (pieces, score, inclusion) in enumerate(samples):
                        row.append(r)
                        sample.append(i)
                        flat.append(pieces)
                        scores.append(round(score, 6))
                        inclusions.append(round(inclusion, 6))
                pieces, sizes = voc.ids_of_all(flat)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces.astype(np.int32)))
                yield pa.record_batch([
                    batch.column("doc_id").take(pa.array(row)), pa.array(sample, pa.int32()), lists, pa.array(sizes, pa.int64()),
                    pa.array(scores, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(_restored(voc, pieces, ends, [texts[r] for r in row]))],
                    names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "log_inclusion", "restored"])
    return run


def _restored(voc: Vocabulary, pieces: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether the decoded ids (of each sample from ends[i] to ends[i + 1]) are the text, byte for byte."""
    spelled, size = voc.spell(pieces)
    at = np.concatenate(([0], np.cumsum(size)))[ends]
    spelled = spelled.tobytes()
    return [spelled[a:b] == (b" " + t.encode() if t else b"") for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """Up to k distinct segmentations of every row of `docs` (doc_id, text): doc_id, sample, ids, n_pieces, log_prob,
    log_inclusion, restored (whether decoding the ids gives the text back)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_batches(model, k), OUT_DDL)


def decode_segmentations(samples: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, sample, text) of rows with ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("sample"), pa.array([voc.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "sample", "text"])
    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
