"""Piece vocabularies, their double-array trie, and lattices over many words at once.

A vocabulary comes from a public model file, as given: its pieces and their log
scores.  A file of merge ranks has no probabilities; there a piece of rank r
(from 0, best first) gets the log of Zipf's law, ``-log(r + 1)``, normalised.

The white-space marker is the byte 0xFF inside this module, which no UTF-8 text
holds, so a literal marker character in a text stays apart from a space.

A lattice has an edge for every piece that a word holds, found by walking the
trie from all characters of a batch of words at the same time.  A character
that is no piece gets one edge for its byte pieces.  Edges are dealt with by
their end's offset in its word, the same offset of all words at once.

Long words (text without spaces).  Where no piece reaches across a place, every
cut goes through it: the word is cut there, and what stands between such places
are words of their own, whose best cuts, sums and expected numbers are those of
the whole.  They are found in windows.  What has no such place over
``LONG`` bytes is a stretch: its recursion goes over windows of edges, in which
only the last ``trie.longest`` places are kept, with a byte pair a place to
find the way back.  Best cuts are found with whole numbers (scores in units of
``1 / UNIT``), so that it makes no difference where a word was cut.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

MARKER = "▁"
MARK = b"\xff"
UNKNOWN_PENALTY = 10.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A chunk that no piece reaches out of: a line break, or markers and what follows them.
CHUNK = re.compile(rb"\n|\xff+[^\xff\n]*|[^\xff\n]+")
#: Where a text can be cut into sections: in front of a line break or of the first of some spaces.
SECTION_END = re.compile(rb"\n|(?<! ) ")
SECTION = 1 << 20
LONG = 1 << 12
WINDOW = 1 << 16
BATCH_BYTES = 1 << 16
UNIT = 1 << 32


@dataclass
class Vocabulary:
    """Pieces as bytes (with MARK for the marker) and log scores, by id."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray  # ids of pieces that a text can be cut into
    byte_ids: np.ndarray  # id of the byte piece of each byte

    @functools.cached_property
    def trie(self) -> DoubleArray:
        return DoubleArray([self.pieces[i] for i in self.normal], self.normal)

    @functools.cached_property
    def apart(self) -> bool:
        """Whether no piece reaches over the zero byte between two words of a batch."""
        return not any(b"\0" in self.pieces[i] for i in self.normal)

    @functools.cached_property
    def shown(self) -> list[bytes]:
        """What each id stands for in a text."""
        out = [p.replace(MARK, b" ") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


class DoubleArray:
    """A trie in two arrays: the child of ``node`` by byte ``c`` is
    ``t = base[node] + c + 1`` if ``check[t] == node``."""

    def __init__(self, keys: list[bytes], values: np.ndarray):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [int(values[i]) for i in order]
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        self.longest = max(map(len, keys), default=0)
        free, dense, stack = 1, 1, [(0, 0, len(keys), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[node] = values[lo]
                lo += 1
            groups, i = [], lo
            while i < hi:
                c, j = keys[i][depth], i + 1
                while j < hi and keys[j][depth] == c:
                    j += 1
                groups.append((c, i, j))
                i = j
            if not groups:
                continue
            if len(groups) == 1:  # fills any gap
                while check[free] != -1:
                    free += 1
                    if free >= size:
                        break
                at = free - groups[0][0] - 1
                at = at if at >= 0 else dense
            else:  # looks near the end only, where gaps are wide
                at = dense
            while True:
                while at + 258 > size:
                    for x, empty in ((base, 0), (check, -1), (value, -1)):
                        x.extend([empty] * size)
                    size *= 2
                if all(check[at + c + 1] == -1 for c, _, _ in groups):
                    break
                at += 1
            if len(groups) > 1:
                dense = max(dense, at - 16)
            base[node] = at
            for c, i, j in groups:
                check[at + c + 1] = node
                stack.append((at + c + 1, i, j, depth + 1))
        used = max(i for i, c in enumerate(check) if c != -1) + 258
        self.base, self.check, self.value = (
            np.array((x + [e] * 258)[:used], np.int32) for x, e in ((base, 0), (check, -1), (value, -1))
        )

    def get(self, key: bytes) -> int:
        node = 0
        for c in key:
            t = int(self.base[node]) + c + 1
            if self.check[t] != node:
                return -1
            node = t
        return int(self.value[node])


def model_path(spark: SparkSession) -> str:
    """The model file that the session names in ``quarry.subword.model``, else ``MODEL``. Read on the driver only."""
    return spark.conf.get("quarry.subword.model", MODEL)


@functools.lru_cache(maxsize=2)
def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, its scores as described above."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i).replace(MARKER, "\0").encode().replace(b"\0", MARK) for i in range(n)]
    raw = np.array([model.get_score(i) for i in range(n)])
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    normal = np.flatnonzero(~np.array(special))
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    scores = np.full(n, -np.inf)
    if np.all(raw[normal] == np.round(raw[normal])):  # merge ranks
        ranked = normal[np.lexsort((normal, -raw[normal]))]
        scores[ranked] = -np.log(np.arange(1, len(ranked) + 1)) - math.log(np.sum(1 / np.arange(1, len(ranked) + 1)))
    else:
        scores[normal] = raw[normal]
    scores[byte_ids] = scores[normal].min()
    return Vocabulary(pieces, scores, normal, byte_ids)


def sections(data: bytes, most: int = SECTION) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, or more where there is no place to cut."""
    at = 0
    while len(data) - at > most and (m := SECTION_END.search(data, at + most)):
        yield data[at : m.start()]
        at = m.start()
    yield data[at:]


def chunks(data: bytes, head: bool = True) -> list[bytes]:
    """A text's chunks, to be cut into pieces one by one: with a marker for
    every space and one in front (``head``; a later section has none).  Exact where
    pieces hold markers only at their start and no line break (``check_vocabulary``)."""
    if not head:
        return CHUNK.findall(data.replace(b" ", MARK))
    if b"  " in data or data[:1] == b" ":
        return CHUNK.findall(MARK + data.replace(b" ", MARK))
    parts = (MARK + data.replace(b" ", b" " + MARK)).replace(b"\n", b" \n ").split(b" ")
    return [p for p in parts if p] if b"" in parts else parts


def check_vocabulary(v: Vocabulary) -> None:
    for i in v.normal:
        p = v.pieces[i]
        if MARK in p.lstrip(MARK) or (b"\n" in p and len(p) > 1):
            raise ValueError("pieces that cross chunks: cut whole texts instead")


class Lattice:
    """The edges of a batch of words."""

    def __init__(self, words: list[bytes], v: Vocabulary):
        self.v, n = v, len(words)
        buffer = np.frombuffer(b"\0".join(words) + b"\0" * (v.trie.longest + 2), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, n)
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        self.last = self.first + lengths
        self.buffer, self.size = buffer, int(self.last[-1]) + 1 if n else 0
        owner = np.repeat(np.arange(n), lengths + 1)
        place = np.arange(self.size)
        # a character starts where no continuation byte is; words' ends are none
        lead = ((buffer[: self.size] & 0xC0) != 0x80) & (place < self.last[owner])
        starts = np.flatnonzero(lead)
        b = buffer[starts]
        width = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) - 3 * (b == 0xFF)
        t, found, at, node, known = v.trie, [], starts, np.zeros(len(starts), np.int32), np.zeros(self.size, bool)
        wide = np.zeros(self.size, np.int8)
        wide[starts] = width
        for k in range(t.longest):
            nxt = t.base[node] + buffer[at + k] + 1
            ok = t.check[nxt] == node
            if not v.apart:
                ok &= at + k < self.last[owner[at]]
            at, node = at[ok], nxt[ok]
            if not len(at):
                break
            ids = t.value[node]
            hit = ids >= 0
            found.append((at[hit], at[hit] + k + 1, ids[hit]))
            known[at[hit & (wide[at] == k + 1)]] = True
        lost = starts[~known[starts]]
        ends = np.minimum(lost + wide[lost], self.last[owner[lost]]) if len(lost) else lost
        found.append((lost, ends, np.full(len(lost), -1, np.int32)))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        offset = end - self.first[owner[start]]
        # by offset, end and start, in one number
        span = v.trie.longest + 8
        order = np.argsort((offset * (self.size + 1) + end) * span + span - (end - start))
        self.start, self.end, self.piece, offset = start[order], end[order], piece[order], offset[order]
        cuts = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1]))) if len(offset) else np.empty(0, int)
        self.levels = list(zip(cuts, np.append(cuts[1:], len(offset)))) if len(offset) else []

    def weights(self, scores: np.ndarray, unknown: float | None) -> np.ndarray:
        """A score for each edge; that of a character without a piece is
        ``unknown``, or (None) the sum over its bytes."""
        w = scores[self.piece]
        lost = np.flatnonzero(self.piece < 0)
        if len(lost) and unknown is not None:
            w[lost] = unknown
        elif len(lost):
            byte = scores[self.v.byte_ids[self.buffer[: self.size + 4]]]
            total = np.concatenate(([0], np.cumsum(byte)))
            w[lost] = total[self.end[lost]] - total[self.start[lost]]
        return w

    def units(self, scores: np.ndarray) -> np.ndarray:
        """The edges' scores as whole numbers; characters without a piece get a penalty."""
        unknown = scores[self.v.normal].min() - UNKNOWN_PENALTY
        return np.rint(self.weights(scores, unknown) * UNIT).astype(np.int64)

    def viterbi(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best cut of every word, and where each word's begin.
        Of equal cuts the one with the longer last piece wins."""
        w = self.units(scores)
        best = np.zeros(self.size, np.int64)
        edge = np.full(self.size, -1, np.int64)
        for lo, hi in self.levels:
            end = self.end[lo:hi]
            total = best[self.start[lo:hi]] + w[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
            top = np.maximum.reduceat(total, head)
            spread = np.repeat(top, np.diff(np.append(head, hi - lo)))
            place = np.where(total == spread, np.arange(lo, hi), hi)
            best[end[head]] = top
            edge[end[head]] = np.minimum.reduceat(place, head)
        at, walk = self.last.copy(), []
        alive = np.flatnonzero(at > self.first)
        while len(alive):
            e = edge[at[alive]]
            walk.append((alive, e))
            at[alive] = self.start[e]
            alive = alive[at[alive] > self.first[alive]]
        if not walk:
            return np.empty(0, np.int64), np.zeros(len(self.first) + 1, np.int64)
        word, e = (np.concatenate(x) for x in zip(*walk))
        step = np.concatenate([np.full(len(a), k) for k, (a, _) in enumerate(walk)])
        e = e[np.lexsort((-step, word))]
        piece, width = self.piece[e].astype(np.int64), np.ones(len(e), np.int64)
        lost = piece < 0
        width[lost] = (self.end[e] - self.start[e])[lost]
        ids = np.repeat(piece, width)
        if lost.any():
            inner = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
            source = np.repeat(self.start[e], width) + inner
            ids = np.where(ids < 0, self.v.byte_ids[self.buffer[source]], ids)
        per = np.bincount(np.sort(word), weights=width, minlength=len(self.first)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per)))

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the summed weight of all cuts of every word; all prefixes' too."""
        w = self.weights(scores, None)
        alpha = np.full(self.size, -np.inf)
        alpha[self.first] = 0
        for lo, hi in self.levels:
            end = self.end[lo:hi]
            total = alpha[self.start[lo:hi]] + w[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
            top = np.maximum.reduceat(total, head)
            top = np.where(np.isfinite(top), top, 0)
            size = np.diff(np.append(head, hi - lo))
            with np.errstate(divide="ignore"):
                alpha[end[head]] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, size)), head))
        return alpha[self.last], alpha

    def expected(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each piece is expected in ``counts[i]`` copies of word i,
        all cuts weighted by their probability (byte pieces count for
        characters without a piece); and what ``forward`` gives of each word."""
        total, alpha = self.forward(scores)
        w = self.weights(scores, None)
        beta = np.full(self.size, -np.inf)
        beta[self.last] = 0
        owner = np.searchsorted(self.first, self.start, side="right") - 1
        back = self.start - self.first[owner]
        order = np.argsort((back.max(initial=0) - back) * (self.size + 1) + self.start)
        back, start, end, w_ = back[order], self.start[order], self.end[order], w[order]
        cuts = np.flatnonzero(np.concatenate(([True], back[1:] != back[:-1]))) if len(back) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(back)) if len(back) else []):
            s = start[lo:hi]
            value = beta[end[lo:hi]] + w_[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            top = np.maximum.reduceat(value, head)
            top = np.where(np.isfinite(top), top, 0)
            size = np.diff(np.append(head, hi - lo))
            with np.errstate(divide="ignore"):
                beta[s[head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), head))
        share = np.exp(alpha[self.start] + w + beta[self.end] - total[owner]) * counts[owner]
        n = len(scores)
        known = self.piece >= 0
        out = np.bincount(self.piece[known], weights=share[known], minlength=n)
        for e in np.flatnonzero(~known):
            for b in self.buffer[self.start[e] : self.end[e]]:
                out[self.v.byte_ids[b]] += share[e]
        return out, total


# -- long words


def _bounds(word: bytes) -> list[tuple[int, int]]:
    """Windows of a word, none of which ends inside a character."""
    out, at = [], 0
    while at < len(word):
        upto = min(at + WINDOW, len(word))
        while upto < len(word) and word[upto] & 0xC0 == 0x80:
            upto += 1
        out.append((at, upto))
        at = upto
    return out


def _window(word: bytes, v: Vocabulary, at: int, upto: int) -> Lattice:
    """The edges that start in a window, in the order of their starts and the
    longest first. Their offsets count from ``at``."""
    lattice = Lattice([word[at : upto + v.trie.longest + 4]], v)
    order = np.lexsort((-lattice.end, lattice.start))
    order = order[lattice.start[order] < upto - at]
    lattice.start, lattice.end, lattice.piece, lattice.levels = lattice.start[order], lattice.end[order], lattice.piece[order], []
    return lattice


def _windows(word: bytes, v: Vocabulary) -> Iterator[tuple[int, int, Lattice]]:
    for at, upto in _bounds(word):
        yield at, upto, _window(word, v, at, upto)


def _segments(word: bytes, v: Vocabulary) -> Iterator[bytes]:
    """A long word cut at places that no piece reaches across, a quarter of ``LONG`` apart or more."""
    begun, reach = 0, 0
    for at, upto, lattice in _windows(word, v):
        far = np.zeros(upto - at + 1, np.int64)
        far[0] = reach
        np.maximum.at(far, lattice.start + 1, lattice.end + at)
        far = np.maximum.accumulate(far)  # the furthest end of edges that start before each place
        for place in (np.flatnonzero(far[1:] <= np.arange(at + 1, upto + 1)) + at + 1).tolist():
            if place - begun >= LONG >> 2:
                yield word[begun:place]
                begun = place
        reach = int(far[-1])
    if begun < len(word):
        yield word[begun:]


def _parts(words: list[bytes], v: Vocabulary) -> Iterator[tuple[list[int], Lattice | bytes]]:
    """All words in their order, as lattices of segments with the number of each one's word, or as a stretch."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    if not len(ends) or int(np.diff(ends, prepend=0).max()) <= LONG:  # no word is long
        at = 0
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield list(range(at, upto)), Lattice(words[at:upto], v)
            at = upto
        return
    owners, batch, size = [], [], 0
    for i, word in enumerate(words):
        for part in [word] if len(word) <= LONG else _segments(word, v):
            if len(part) > LONG or size + len(part) > BATCH_BYTES:
                if batch:
                    yield owners, Lattice(batch, v)
                owners, batch, size = [], [], 0
            if len(part) > LONG:
                yield [i], part
            else:
                owners.append(i)
                batch.append(part)
                size += len(part)
    if batch:
        yield owners, Lattice(batch, v)


def cut(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of the best cut of each word, of any length."""
    if all(len(w) <= LONG for w in words):
        ids, at = Lattice(words, v).viterbi(v.scores)
        return np.split(ids.astype(np.int32), at[1:-1]) if words else []
    out: list[list[np.ndarray]] = [[] for _ in words]
    for owners, part in _parts(words, v):
        if isinstance(part, bytes):
            out[owners[0]].append(_cut_stretch(part, v).astype(np.int32))
            continue
        ids, at = part.viterbi(v.scores)
        for owner, found in zip(owners, np.split(ids.astype(np.int32), at[1:-1])):
            out[owner].append(found)
    return [np.concatenate(o) if o else np.empty(0, np.int32) for o in out]


def log_sums(words: list[bytes], v: Vocabulary, scores: list[np.ndarray]) -> list[np.ndarray]:
    """For each of ``scores`` the log of the summed weight of all cuts of every word."""
    out = [np.zeros(len(words)) for _ in scores]
    for owners, part in _parts(words, v):
        for total, s in zip(out, scores):
            if isinstance(part, bytes):
                total[owners[0]] += _alphas(part, v, s)[-1]
            else:
                np.add.at(total, owners, part.forward(s)[0])
    return out


def expected(words: list[bytes], v: Vocabulary, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """How often each piece is expected in ``counts[i]`` copies of word i, and the
    log weight of all these copies together."""
    out, total = np.zeros(len(scores)), 0.0
    for owners, part in _parts(words, v):
        if isinstance(part, bytes):
            found, z = _expected_stretch(part, v, scores)
            out += found * counts[owners[0]]
            total += z * counts[owners[0]]
        else:
            often = counts[owners]
            found, z = part.expected(scores, often)
            out += found
            total += float(z @ often)
    return out, total


def _cut_stretch(word: bytes, v: Vocabulary) -> np.ndarray:
    n, reach = len(word), v.trie.longest + 4
    back = np.zeros(n + reach, np.uint16)
    none = -(1 << 62)
    tail, steps = [0] + [none] * reach, [0] * (reach + 1)
    for at, upto, lattice in _windows(word, v):
        best, step = tail + [none] * (upto - at), steps + [0] * (upto - at)
        for s, e, w in zip(lattice.start.tolist(), lattice.end.tolist(), lattice.units(v.scores).tolist()):
            if (t := best[s] + w) > best[e]:  # the longest of equal ones came first
                best[e], step[e] = t, e - s
        back[at : upto + reach] = step[: upto - at + reach]
        tail, steps = best[upto - at : upto - at + reach + 1], step[upto - at : upto - at + reach + 1]
    way, at = array("i"), n
    while at:
        at -= int(back[at])
        way.append(at)
    starts = np.frombuffer(way, np.int32)[::-1].astype(np.int64)
    return np.concatenate([_ids(word, v, starts[i : i + WINDOW], np.append(starts, n)[i + 1 : i + 1 + WINDOW]) for i in range(0, len(starts), WINDOW)])


def _ids(word: bytes, v: Vocabulary, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The pieces between places, bytes where a character is none."""
    low = int(starts[0])
    buffer = np.frombuffer(word[low : int(ends[-1])] + b"\0" * (v.trie.longest + 2), np.uint8)
    starts, ends = starts - low, ends - low
    node = np.zeros(len(starts), np.int64)
    width = ends - starts
    for k in range(int(width.max())):
        on = (k < width) & (node >= 0)
        to = v.trie.base[node[on]] + buffer[starts[on] + k] + 1
        node[on] = np.where(v.trie.check[to] == node[on], to, -1)
    piece = np.where(node >= 0, v.trie.value[node], -1).astype(np.int64)
    many = np.where(piece < 0, width, 1)
    ids = np.repeat(piece, many)
    inner = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
    return np.where(ids < 0, v.byte_ids[buffer[np.repeat(starts, many) + inner]], ids)


def _alphas(word: bytes, v: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all cuts of each prefix of a stretch; -inf
    inside a character. Sums are kept as plain numbers over a common scale."""
    reach = v.trie.longest + 4
    out = np.full(len(word) + 1, -np.inf)
    tail, scale = [1.0] + [0.0] * reach, 0.0
    for at, upto, lattice in _windows(word, v):
        alpha, n = tail + [0.0] * (upto - at), upto - at
        scales = array("d", bytes(8 * (n + reach + 1)))
        starts = lattice.start.tolist()
        last = -1
        for s, e, w in zip(starts, lattice.end.tolist(), np.exp(lattice.weights(scores, None)).tolist()):
            if s != last:
                last, a = s, alpha[s]
                scales[s] = scale
                if a < 1e-200:
                    alpha[s : s + reach + 1] = [x / a for x in alpha[s : s + reach + 1]]
                    scale += math.log(a)
                    scales[s], a = scale, 1.0
            alpha[e] += a * w
        with np.errstate(divide="ignore"):
            seen = np.array(starts[:1] + [s for s, t in zip(starts[1:], starts) if s != t], np.int64)
            out[at + seen] = np.log(np.array(alpha)[seen]) + np.frombuffer(scales)[seen]
        tail = alpha[n : n + reach + 1]
    out[len(word)] = math.log(tail[0]) + scale
    return out


def _expected_stretch(word: bytes, v: Vocabulary, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """How often each piece is expected in a stretch, and the log weight of all its cuts."""
    alphas, reach, out = _alphas(word, v, scores), v.trie.longest + 4, np.zeros(len(scores))
    total = float(alphas[-1])
    head, scale = [1.0] + [0.0] * reach, 0.0  # of the places from the window's end on
    for at, upto in reversed(_bounds(word)):
        lattice = _window(word, v, at, upto)
        n = upto - at
        beta = [0.0] * n + head
        logs = np.full(n + reach + 1, -np.inf)
        w = lattice.weights(scores, None)
        plain, s_, e_ = np.exp(w).tolist(), lattice.start.tolist(), lattice.end.tolist()
        with np.errstate(divide="ignore"):
            logs[n:] = np.log(np.array(head)) + scale
        k = len(s_) - 1
        while k >= 0:
            s, b = s_[k], 0.0
            while k >= 0 and s_[k] == s:
                b += plain[k] * beta[e_[k]]
                k -= 1
            if 0 < b < 1e-200:
                beta[s : s + reach + 1] = [x / b for x in beta[s : s + reach + 1]]
                scale += math.log(b)
                b = 1.0
            beta[s] = b
            logs[s] = math.log(b) + scale if b else -math.inf
        share = np.exp(alphas[at + lattice.start] + w + logs[lattice.end] - total)
        known = lattice.piece >= 0
        out += np.bincount(lattice.piece[known], weights=share[known], minlength=len(scores))
        for i in np.flatnonzero(~known).tolist():
            for byte in word[at + lattice.start[i] : at + lattice.end[i]]:
                out[v.byte_ids[byte]] += share[i]
        head = beta[: reach + 1]
    return out, total
