"""Progressive JPEG for many files at once: coefficients in and out, and pixels.

``decode_many`` reads progressive files (Huffman coding, 8 bits, one or three
components, sampling factors up to 2 by 2, restart intervals): every scan adds
its spectral band, or one more bit of it, to coefficient arrays.  ``pixels``
inverse-transforms the arrays in numpy, repeats chroma up to full resolution and
converts to RGB.

Reading is done on arrays.  The bits between two restart markers are a stream;
all streams of the scans of one kind, of all files, are read in step, a symbol of
each at a time.  In a first scan the place of the next symbol follows from the
symbol alone, so places are found first, and values, runs and block ends for all
symbols together; in a refinement it follows from how many coefficients were
known before, for which there are running counts.

``encode_many`` stores bytes losslessly in such files: each byte less 128 is one
AC coefficient (the format's unit), with DC at 0, in 4:2:0.  They are sent by
spectral selection and successive approximation: all bits but the last in two
bands of luma and one of each chroma, with code tables for values of every size,
runs and block ends, then the last bits in refinement scans, restart markers
every ``INTERVAL`` units.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Row-major position of each coefficient in transmission order."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in cells])


ZIGZAG = _zigzag()
AC_PER_BLOCK = 63
INTERVAL = 8
#: First scans: (component, first, last coefficient); their refinements.
FIRST_SCANS = ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63))
REFINEMENTS = ((0, 1, 63), (1, 1, 63), (2, 1, 63))
#: Coefficients that are worked on at a time: streams in step, and arrays that fit a core's cache.
WORK, NEAR = 1 << 20, 1 << 16
SCAN_END = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
END_OF_BLOCK, ZERO_RUN = 0x00, 0xF0


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks in a scan of this component alone
    cols: int = 0
    down: int = 0  # blocks with those that fill up the last units
    across: int = 0
    first: int = 0  # its first block among those of all files
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))  # (down, across, 64), zigzag order


@dataclass
class Scan:
    components: list[Component]
    tables: tuple[Huffman | None, ...]  # of each component
    start: int
    end: int
    high: int
    low: int
    interval: int
    data: bytes

    @property
    def kind(self) -> tuple:
        """Scans of one kind are read together."""
        if self.start:
            return ("refine" if self.high else "first", self.start, self.end, self.low)
        shape = tuple((c.h, c.v) for c in self.components) if len(self.components) > 1 else ((1, 1),)
        return ("refine DC", self.low) if self.high else ("DC", self.low, shape, self.tables)


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantization: dict[int, np.ndarray]
    comments: list[bytes]
    scans: list[Scan]


class Huffman:
    """A code table: of every 16 bits, the length of the code they begin with (0: none) and its symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.codes: dict[int, tuple[int, int]] = {}
        code = at = 0
        for size, count in enumerate(counts, 1):
            for symbol in symbols[at : at + count]:
                if code >= 1 << size:
                    raise ValueError("too many codes")
                self.length[code << (16 - size) : (code + 1) << (16 - size)] = size
                self.symbol[code << (16 - size) : (code + 1) << (16 - size)] = symbol
                self.codes[symbol] = (code, size)
                code += 1
            at += count
            code <<= 1


@functools.lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


# -- code tables of our own


def _table(weights: dict[int, int]) -> tuple[bytes, bytes]:
    """Lengths and symbols of a Huffman code for weighted symbols; no code is all ones."""
    heap = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, max(i, j), x + y))
    depth.pop(-1)  # the deepest: the code of ones that stays unused
    assert max(depth.values()) <= 16
    order = sorted(depth, key=lambda s: (depth[s], s))
    return bytes(sum(d == n for d in depth.values()) for n in range(1, 17)), bytes(order)


def _first_weights() -> dict[int, int]:
    """Values of 4 bits are the most frequent (letters), long runs the least."""
    size = {1: 4, 2: 8, 3: 48, 4: 128, 5: 16, 6: 56, 7: 8}
    runs = {r << 4 | s: max(1, (w << 6) >> 3 * min(r, 3)) for r in range(16) for s, w in size.items()}
    return runs | {END_OF_BLOCK: 64, ZERO_RUN: 1} | {r << 4: 1 for r in range(1, 15)}


def _refinement_weights() -> dict[int, int]:
    runs = {r << 4 | 1: max(1, 64 >> min(r, 5)) for r in range(16)}
    return runs | {END_OF_BLOCK: 256, ZERO_RUN: 1} | {r << 4: 1 for r in range(1, 15)}


DC_TABLE = _table({0: 16, 1: 4, 2: 4, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1})
FIRST_TABLE, REFINEMENT_TABLE = _table(_first_weights()), _table(_refinement_weights())


def _codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for s, (c, n) in _huffman(*table).codes.items():
        code[s], size[s] = c, n
    return code, size


# -- writing ----------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


BIT_LENGTH = np.array([i.bit_length() for i in range(256)], np.int32)


def _restarts(blocks: np.ndarray) -> np.ndarray:
    """The first block of every interval of files with these numbers of blocks, which follow each other; and the end."""
    count = -(-blocks // INTERVAL)
    file = np.repeat(np.arange(len(blocks)), count)
    inner = np.arange(len(file)) - np.repeat(np.cumsum(count) - count, count)
    return np.append((np.cumsum(blocks) - blocks)[file] + inner * INTERVAL, blocks.sum())


def _works(firsts: np.ndarray) -> Iterator[np.ndarray]:
    """Neighbouring intervals that are worked on together: their first blocks and the end of the last."""
    at = 0
    while at < len(firsts) - 1:
        upto = max(at + 1, int(np.searchsorted(firsts, firsts[at] + NEAR // AC_PER_BLOCK, side="right")) - 1)
        yield firsts[at : upto + 1]
        at = upto


def _aligned(bits: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the bits of each block: where each block begins if intervals begin at
    whole bytes; each interval's first byte (and the end); the bits its last one lacks."""
    each = np.add.reduceat(bits, firsts[:-1])
    ends = np.append(0, np.cumsum((each + 7) >> 3))
    plain = np.cumsum(bits) - bits
    interval = np.repeat(np.arange(len(each)), np.diff(firsts))
    return plain + (8 * ends[:-1] - plain[firsts[:-1]])[interval], ends, -each & 7


def _first_scan(values: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """The bits of a band, all but the last of each value, as a piece for each interval."""
    code, size_of = _codes(FIRST_TABLE)
    out: list[bytes] = []
    for part in _works(firsts):
        v = values[part[0] : part[-1]].astype(np.int32)
        part = part - part[0]
        count, n = v.shape
        m = np.abs(v) >> 1
        flat = np.flatnonzero(m).astype(np.int32)
        block = flat // np.int32(n)
        k = flat - block * np.int32(n)
        m, negative = m.reshape(-1)[flat], v.reshape(-1)[flat] < 0
        before = np.append(-1, k[:-1])
        before[np.append(True, block[1:] != block[:-1])[: len(k)]] = -1
        run = k - before[: len(k)] - 1
        size = BIT_LENGTH[m]
        symbol = (run & 15) << 4 | size
        zeros, zero_bits = run >> 4, int(size_of[ZERO_RUN])
        length = size_of[symbol] + size
        value = code[symbol] << size | np.where(negative, ~m, m) & ((1 << size) - 1)
        bits = np.bincount(block, weights=length + zeros * zero_bits, minlength=count).astype(np.int64)
        last = np.full(count, -1)
        last[block] = k
        ended = last < n - 1
        inner = bits.copy()
        bits += ended * size_of[END_OF_BLOCK]
        begins, ends, lacking = _aligned(bits, part)
        spent = np.cumsum(length + zeros * zero_bits)
        own = spent - length + (begins - np.cumsum(inner) + inner)[block]  # after the zero runs in front
        at, values_, lengths = [own], [value], [length]
        if zeros.any():
            rep = np.repeat(np.arange(len(zeros)), zeros)
            back = np.arange(len(rep)) - np.repeat(np.cumsum(zeros) - zeros, zeros) + 1
            at.append(own[rep] - back * zero_bits)
            values_.append(np.full(len(rep), code[ZERO_RUN]))
            lengths.append(np.full(len(rep), zero_bits))
        done = np.flatnonzero(ended)
        at.append(begins[done] + inner[done])
        values_.append(np.full(len(done), code[END_OF_BLOCK]))
        lengths.append(np.full(len(done), size_of[END_OF_BLOCK]))
        out += _packed(*map(np.concatenate, (at, values_, lengths)), ends, lacking)
    return out


def _packed(at: np.ndarray, value: np.ndarray, length: np.ndarray, ends: np.ndarray, lacking: np.ndarray) -> list[bytes]:
    """Codes of up to 25 bits at their bits, filled up with ones, as a piece for each interval."""
    byte, word = at >> 3, (value << (32 - (at & 7) - length)).astype(np.uint32).astype(">u4").view(np.uint8).reshape(-1, 4)
    size = int(ends[-1])
    data = np.zeros(size + 4)
    for k in range(4):  # no two codes have a bit in common
        data += np.bincount(byte + k, weights=word[:, k], minlength=size + 4)
    data[ends[1:] - 1] += (1 << lacking) - 1
    whole = data[:size].astype(np.uint8).tobytes()
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _refinement(values: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """The last bits of a band: those of known coefficients, and the coefficients that become 1 or -1."""
    code, size_of = _codes(REFINEMENT_TABLE)
    out: list[bytes] = []
    for part in _works(firsts):
        v = values[part[0] : part[-1]].astype(np.int32)
        part = part - part[0]
        count, n = v.shape
        m = np.abs(v).reshape(-1)
        known, new = m > 1, m == 1
        # the zeros before each new coefficient in its block, since the new one before
        zeros = np.cumsum(~known) - ~known  # zeros and new ones before a place
        fresh = np.flatnonzero(new)
        block = fresh // n
        follows = np.append(False, block[1:] == block[:-1])[: len(fresh)]
        since = np.where(follows, zeros[np.append(0, fresh[:-1])[: len(fresh)]] + 1, zeros[block * n])
        run = zeros[fresh] - since
        # an event stands in front of the known coefficients that it passes: zero runs, new ones, block ends
        places = np.flatnonzero(~known)
        rep = np.repeat(np.arange(len(fresh)), run >> 4)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(run >> 4) - (run >> 4), run >> 4)
        passed = places[since[rep] + 16 * nth + 15] if len(rep) else np.empty(0, np.int64)
        last = np.full(count, -1)
        last[block] = fresh
        ended = np.flatnonzero(last < (np.arange(count) + 1) * n - 1)
        event = np.concatenate([passed, fresh, (ended + 1) * n])
        symbol = np.concatenate([np.full(len(rep), ZERO_RUN), (run & 15) << 4 | 1, np.full(len(ended), END_OF_BLOCK)])
        sign = np.concatenate([np.zeros(len(rep), np.int64), v.reshape(-1)[fresh] > 0, np.zeros(len(ended), np.int64)])
        owner = np.concatenate([passed // n, block, ended])
        key = 2 * event + (symbol != END_OF_BLOCK)  # a block ends before the next one's first place
        order = np.argsort(key)
        key, symbol, sign, owner = key[order], symbol[order], sign[order], owner[order]
        value = np.where(symbol & 15, code[symbol] << 1 | sign, code[symbol])
        length = size_of[symbol] + (symbol & 15)
        which = np.flatnonzero(known)
        of = np.searchsorted(key, 2 * which + 1, side="right")  # a known place lies before its event's
        bits = np.bincount(owner, weights=length, minlength=count).astype(np.int64) + np.count_nonzero(known.reshape(count, n), axis=1)
        begins, ends, lacking = _aligned(bits, part)
        shift = begins - (np.cumsum(bits) - bits)
        headed = np.cumsum(length)
        one = headed[of] + np.arange(len(which)) + shift[which // n]
        head = headed - length + np.searchsorted(of, np.arange(len(key))) + shift[owner]
        data = np.zeros(8 * int(ends[-1]), np.uint8)
        data[one] = m[which] & 1
        for j in range(int(length.max(initial=0))):
            has = j < length
            data[head[has] + j] = value[has] >> (length[has] - 1 - j) & 1
        for j in range(1, 8):
            data[8 * ends[1:][lacking >= j] - j] = 1
        whole = np.packbits(data).tobytes()
        out += [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return out


def _with_restarts(pieces: list[bytes]) -> bytes:
    stuffed = [p.replace(b"\xff", b"\xff\0") for p in pieces]
    return b"".join(x for k, p in enumerate(stuffed) for x in (p, bytes([0xFF, 0xD0 + k % 8]))[: 1 if k == len(stuffed) - 1 else 2])


def _scan_head(components: list[tuple[int, int]], start: int, end: int, high: int, low: int) -> bytes:
    parts = b"".join(bytes([c, t]) for c, t in components)
    return _segment(0xDA, bytes([len(components)]) + parts + bytes([start, end, high << 4 | low]))


HEAD = b"".join(
    [
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC4, bytes([0x00]) + b"".join(DC_TABLE)),
        _segment(0xC4, bytes([0x10]) + b"".join(FIRST_TABLE)),
        _segment(0xC4, bytes([0x11]) + b"".join(REFINEMENT_TABLE)),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
    ]
)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for each payload; its length goes into a comment."""
    planes: list[list[np.ndarray]] = [[], [], []]
    sizes = []
    for payload in payloads:
        mcus = max(1, -(-len(payload) // (AC_PER_BLOCK * 6)))
        across = min(4095, max(1, int(np.ceil(np.sqrt(mcus)))))
        down = -(-mcus // across)
        if down > 4095:
            raise ValueError("payload too large for one image")
        units = across * down
        raw = np.full(units * 6 * AC_PER_BLOCK, 255, np.uint8)
        raw[: len(payload)] = np.frombuffer(payload, np.uint8)
        values = raw.reshape(-1, AC_PER_BLOCK)
        for plane, own in zip(planes, (values[: 4 * units], values[4 * units : 5 * units], values[5 * units :])):
            plane.append(own)
        sizes.append((across, down))
    units = np.array([a * d for a, d in sizes], np.int64)
    stacked = [np.concatenate(p).astype(np.int16) - 128 if p else np.empty((0, AC_PER_BLOCK), np.int16) for p in planes]
    scans = []  # a head and the pieces of all files
    for scan, of in [(_first_scan, FIRST_SCANS), (_refinement, REFINEMENTS)]:
        refined = scan is _refinement
        for c, a, b in of:
            blocks = units * (4 if c == 0 else 1)
            pieces = scan(stacked[c][:, a - 1 : b], _restarts(blocks)) if len(units) else []
            scans.append((_scan_head([(c + 1, int(refined))], a, b, int(refined), int(not refined)), pieces, -(-blocks // INTERVAL)))
    zero, zero_bits = _huffman(*DC_TABLE).codes[0]
    out, at = [], [0] * len(scans)
    for payload, (across, down) in zip(payloads, sizes):
        left, dc = across * down, []
        while left > 0:  # every difference is 0
            n = 6 * min(INTERVAL, left) * zero_bits
            code = int(format(zero, f"0{zero_bits}b") * (n // zero_bits), 2)
            dc.append((code << (-n & 7) | (1 << (-n & 7)) - 1).to_bytes((n + 7) // 8, "big"))
            left -= INTERVAL
        parts = [
            b"\xff\xd8", _segment(0xFE, b"payload " + str(len(payload)).encode()), HEAD,
            _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _scan_head([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0), _with_restarts(dc),
        ]
        for s, (head, pieces, counts) in enumerate(scans):
            count = int(counts[len(out)])
            parts += [head, _with_restarts(pieces[at[s] : at[s] + count])]
            at[s] += count
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def read_payload(image: Image) -> bytes:
    """The payload of a file that ``encode_many`` wrote."""
    size = next(int(c[8:]) for c in image.comments if c.startswith(b"payload "))
    values = np.concatenate([c.coefficients.reshape(-1, 64)[:, 1:].reshape(-1) for c in image.components])[:size]
    return (values + 128).astype(np.uint8).tobytes()


# -- reading ----------------------------------------------------------------


@functools.lru_cache(maxsize=256)
def _tables_of(body: bytes) -> tuple[tuple[int, Huffman], ...]:
    found, k = [], 0
    while k < len(body):
        count = sum(body[k + 1 : k + 17])
        found.append((body[k], _huffman(body[k + 1 : k + 17], body[k + 17 : k + 17 + count])))
        k += 17 + count
    return tuple(found)


@functools.lru_cache(maxsize=256)
def _quantization_of(body: bytes) -> tuple[tuple[int, np.ndarray], ...]:
    found, k = [], 0
    while k < len(body):
        wide = body[k] >> 4
        found.append((body[k] & 15, np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)))
        k += 1 + 64 * (2 if wide else 1)
    return tuple(found)


@functools.lru_cache(maxsize=256)
def _scan_of(body: bytes) -> tuple[tuple[int, ...], tuple[int, ...], int, int, int, int]:
    """Components, keys of their tables, first and last coefficient, bits that were sent before, and that are left."""
    n = body[0]
    start, end, approx = body[1 + 2 * n : 4 + 2 * n]
    if not n or not 0 <= start <= end < 64 or (start and n > 1) or (not start and end):
        raise ValueError("no such band")
    kinds = body[2 : 2 + 2 * n : 2]
    return tuple(body[1 : 1 + 2 * n : 2]), tuple(0x10 | t & 15 if start else t >> 4 for t in kinds), start, end, approx >> 4, approx & 15


def _parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, interval, at = None, {}, 0, 2
    quantization: dict[int, np.ndarray] = {}
    comments: list[bytes] = []
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            m = SCAN_END.search(data, at)
            if image is None or m is None:
                raise ValueError("a scan without a frame or an end")
            idents, keys, start, end, high, low = _scan_of(body)
            chosen = [next(c for c in image.components if c.ident == i) for i in idents]
            used = tuple([tables.get(k) for k in keys])
            if None in used and (start or not high):
                raise ValueError("a code table is missing")
            image.scans.append(Scan(chosen, used, start, end, high, low, interval, data[at : m.start()]))
            at = m.start()
        elif marker == 0xDB:
            quantization.update(_quantization_of(body))
        elif marker == 0xC4:
            tables.update(_tables_of(body))
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            image = _frame(body, quantization, comments)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)):
            raise ValueError("not a progressive file with Huffman codes")
    if image is None:
        raise ValueError("no frame")
    return image


def _frame(body: bytes, quantization: dict[int, np.ndarray], comments: list[bytes]) -> Image:
    _, height, width, n = struct.unpack_from(">BHHB", body)
    parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
    hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for c in parts:
        c.cols, c.rows = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
        c.down, c.across = down * c.v, across * c.h
    return Image(width, height, parts, quantization, comments, [])


class _Streams:
    """The bits between restart markers of some scans of one kind, end to end."""

    def __init__(self, scans: list[Scan], blocks: list[np.ndarray] | None):
        """``blocks``: the blocks of each scan in its order, where they are not those of one component."""
        pieces, count, owner, shapes = [], [], [], []
        for s, scan in enumerate(scans):
            c = scan.components[0]
            size = c.rows * c.cols if blocks is None else len(blocks[s])
            shapes.append((size, c.first, c.across, c.cols))
            unit = sum(c.h * c.v for c in scan.components) if len(scan.components) > 1 else 1
            own = RESTART.split(scan.data) if scan.interval else [scan.data]
            step = scan.interval * unit if scan.interval else size
            if len(own) != max(1, -(-size // max(step, 1))):
                raise ValueError("restart markers are missing")
            pieces += own
            owner += [s] * len(own)
            count += [step] * (len(own) - 1) + [size - (len(own) - 1) * step]
        self.scan, self.count = np.array(owner, np.int64), np.array(count, np.int64)
        if blocks is None:
            sizes, first, across, cols = np.array(shapes, np.int64).T
            local = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cols = np.repeat(cols, sizes)
            self.block = np.repeat(first, sizes) + local // cols * np.repeat(across, sizes) + local % cols
        else:
            self.block = np.concatenate(blocks)
        self.begin = np.cumsum(self.count) - self.count
        plain = [p.replace(b"\xff\0", b"\xff") + b"\xff" * 8 for p in pieces]
        ends = np.cumsum([len(p) for p in plain])
        number = np.int32 if 8 * int(ends[-1]) < 1 << 31 else np.int64
        self.bit = (8 * (ends - [len(p) for p in plain])).astype(number)
        b = np.frombuffer(b"".join(plain) + b"\xff" * 4, np.uint8).astype(np.int32)
        self.words = b[:-2] << 16 | b[1:-1] << 8 | b[2:]  # the 24 bits from each byte on

    def bits(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The ``n`` bits, up to 16, at some places."""
        return (self.words[at >> 3] >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    def groups(self, n: int) -> Iterator[np.ndarray]:
        """Streams that are read together, by the size of what they hold."""
        order = np.argsort(-self.count, kind="stable")
        ends = np.cumsum(self.count[order] * n)
        at = 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORK, side="right")))
            yield np.sort(order[at:upto])
            at = upto

    def symbols(self, which: np.ndarray, tables: list[Huffman], table_of: np.ndarray | None, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols of some streams, in their order: how many there are of each
        stream, the symbols, and where what follows their codes begins.  ``extra`` tells the bits after a
        symbol.  The table of a stream is ``table_of`` it, or (None) that of the place of a symbol, in turn."""
        steps = [np.where(t.length > 0, t.length.astype(np.int32) + extra[t.symbol], 0).astype(self.bit.dtype) for t in tables]
        one = len(tables) == 1
        if table_of is not None and not one:
            stacked, kinds = np.stack(steps), table_of[which]
        words, at, live, found = self.words, self.bit[which], np.arange(len(which), dtype=np.int32), []
        while len(live):
            window = words[at >> 3]
            window >>= 8 - (at & 7)
            window &= 0xFFFF
            if one:
                step = steps[0][window]
            elif table_of is None:
                step = steps[len(found) % len(steps)][window]
            else:
                step = stacked[kinds[live], window]
            if not step.all():  # some streams have ended: they are filled up with ones, which are no code
                ok = step > 0
                live, at, step = live[ok], at[ok], step[ok]
            found.append((live, at))
            at = at + step
        count = np.zeros(len(which), np.int64)
        for live, _ in found:
            count[live] += 1
        begin = np.cumsum(count) - count
        places = np.zeros(int(count.sum()), self.bit.dtype)
        for k, (live, at) in enumerate(found):
            places[begin[live] + k] = at
        window = self.bits(places, 16)
        if one:
            length, symbol = tables[0].length[window], tables[0].symbol[window]
        else:
            owner = np.repeat(np.arange(len(which)), count)
            turn = (np.arange(len(places)) - begin[owner]) % len(tables) if table_of is None else kinds[owner]
            length = np.stack([t.length for t in tables])[turn, window]
            symbol = np.stack([t.symbol for t in tables])[turn, window]
        return count, symbol, places + length


_AFTER = np.arange(256)
#: Bits after a symbol of a first AC scan: a value's, or those of a number of blocks that end.
AC_EXTRA = np.where(_AFTER & 15, _AFTER & 15, np.where(_AFTER >> 4 < 15, _AFTER >> 4, 0)).astype(np.int32)
#: Coefficients that a symbol goes on by.
AC_STEP = np.where(_AFTER & 15, (_AFTER >> 4) + 1, np.where(_AFTER >> 4 < 15, 0, 16)).astype(np.int32)


def _tables(scans: list[Scan]) -> tuple[list[Huffman], np.ndarray]:
    distinct = list(dict.fromkeys(s.tables[0] for s in scans))
    return distinct, np.array([distinct.index(s.tables[0]) for s in scans])


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value << 1 >> size, value, value - (1 << size) + 1)


def _read_first(store: np.ndarray, scans: list[Scan], start: int, end: int, low: int) -> None:
    """Bands that are sent for the first time."""
    streams, n = _Streams(scans, None), end - start + 1
    tables, of = _tables(scans)
    for which in streams.groups(n):
        counts, symbols, afters = streams.symbols(which, tables, of[streams.scan], AC_EXTRA)
        if not counts.all():
            raise ValueError("a scan ends early")
        upto, at = np.cumsum(counts), 0
        while at < len(which):  # some streams, all of their symbols together
            low_, more = int(upto[at] - counts[at]), int(np.searchsorted(upto, upto[at] + NEAR, side="right"))
            part = slice(low_, int(upto[more - 1]))
            _place(store, streams, which[at:more], counts[at:more], symbols[part], afters[part], start, n, low)
            at = more


def _place(store: np.ndarray, streams: _Streams, which: np.ndarray, count: np.ndarray, symbol: np.ndarray, after: np.ndarray, start: int, n: int, low: int) -> None:
    """The coefficients that all symbols of some streams stand for."""
    size, step = (symbol & 15).astype(np.int32), AC_STEP[symbol]
    value = streams.bits(after, AC_EXTRA[symbol])
    first = np.zeros(len(symbol), bool)  # of the symbols up to an end of blocks
    opening = np.cumsum(count) - count
    first[opening] = True
    ends = np.flatnonzero(step == 0)
    first[1:][ends[: len(ends) - (len(ends) > 0 and ends[-1] == len(symbol) - 1)]] = True
    blocks = np.zeros(len(symbol), np.int64)
    blocks[ends] = (1 << (symbol[ends] >> 4).astype(np.int64)) + value[ends]
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(symbol)) - 1
    upto = np.cumsum(step, dtype=np.int32)
    base = upto[heads] - step[heads]
    taken = (upto[tails] - base) // n + blocks[tails]
    owner = np.searchsorted(opening, heads, side="right") - 1
    sums = np.cumsum(taken) - taken
    begun = sums - sums[np.searchsorted(heads, opening)][owner]  # blocks of the stream before
    if not np.array_equal(np.bincount(owner, weights=taken, minlength=len(which)).astype(np.int64), streams.count[which]):
        raise ValueError("a scan has other blocks than the frame")
    # from a symbol's place in its run to its place among the blocks of these streams
    block_begin = np.cumsum(streams.count[which]) - streams.count[which]
    shift = ((block_begin[owner] + begun) * n - base).astype(np.int32)
    place = upto + np.repeat(shift, tails - heads + 1)  # after the coefficient
    if ((place - step) // n != (place - (step > 0)) // n).any():
        raise ValueError("a run leaves its block")
    if len(ends):
        hit = size > 0
        place, value, size = place[hit], value[hit], size[hit]
    elif (symbol == ZERO_RUN).any():
        hit = symbol != ZERO_RUN
        place, value, size = place[hit], value[hit], size[hit]
    band = np.zeros(int(streams.count[which].sum()) * n, np.int16)
    band[place - 1] = _signed(value, size) << low
    blocks_of = _blocks_of(streams, which)
    store[blocks_of, start : start + n] = band.reshape(-1, n)


def _blocks_of(streams: _Streams, which: np.ndarray) -> np.ndarray:
    count = streams.count[which]
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return streams.block[np.repeat(streams.begin[which], count) + inner]


def _read_refinement(store: np.ndarray, scans: list[Scan], start: int, end: int, low: int) -> None:
    """One more bit for the coefficients of a band, and those that it makes non-zero."""
    streams, n = _Streams(scans, None), end - start + 1
    tables, of = _tables(scans)
    length, symbols = np.stack([t.length for t in tables]), np.stack([t.symbol for t in tables])
    for which in streams.groups(n):
        count = streams.count[which]
        begin = np.cumsum(count) - count
        block = _blocks_of(streams, which)
        flat = store[block, start : end + 1].reshape(-1)
        known = flat != 0
        empty = np.append(np.flatnonzero(~known), np.full(17, len(flat) + n))  # places without a value yet
        before = np.append(0, np.cumsum(~known))  # how many of these there are before a place
        at, place, last = streams.bit[which].copy(), begin * n, (begin + count) * n
        table, live = of[streams.scan[which]], np.arange(len(which))
        corrections, fresh = [], []
        while len(live := live[place[live] < last[live]]):
            p, g = at[live], place[live]
            window = streams.bits(p, 16)
            size, symbol = length[table[live], window].astype(np.int64), symbols[table[live], window].astype(np.int64)
            if not size.all():
                raise ValueError("no such code")
            run, kind = symbol >> 4, symbol & 15
            if (kind > 1).any():
                raise ValueError("no such symbol in a refinement")
            ends = (kind == 0) & (run < 15)
            z = before[g]
            blocks = (1 << run) + streams.bits(p + size, np.where(ends, run, 0))
            target = empty[np.minimum(z + run, len(empty) - 1)]
            to = np.where(ends, (g // n + blocks) * n, target + 1)
            if (to > last[live]).any() or ((to - 1) // n != g // n)[~ends].any():
                raise ValueError("a run leaves its block")
            bits = p + size + np.where(ends, run, kind)
            passed = (to - g) - (before[to] - z)
            corrections.append((bits, passed, g - z))
            new = kind == 1
            fresh.append((target[new], streams.bits(p + size, 1)[new]))
            at[live], place[live] = bits + passed, to
        if corrections:
            bits, passed, first = (np.concatenate(x) for x in zip(*corrections))
            inner = np.arange(int(passed.sum())) - np.repeat(np.cumsum(passed) - passed, passed)
            hit = streams.bits(np.repeat(bits, passed) + inner, 1) == 1
            where = np.flatnonzero(known)[(np.repeat(first, passed) + inner)[hit]]
            flat[where] += (np.sign(flat[where]) << low).astype(np.int16)
            target, sign = (np.concatenate(x) for x in zip(*fresh))
            flat[target] = ((2 * sign - 1) << low).astype(np.int16)
        store[block, start : end + 1] = flat.reshape(-1, n)


def _units(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a scan in its order, and the component of each block of a unit."""
    if len(scan.components) == 1:
        c = scan.components[0]
        grid = c.first + np.arange(c.rows)[:, None] * c.across + np.arange(c.cols)[None, :]
        return grid.reshape(-1), np.zeros(1, np.int64)
    parts = []
    for c in scan.components:
        grid = c.first + np.arange(c.down * c.across).reshape(c.down // c.v, c.v, c.across // c.h, c.h)
        parts.append(grid.transpose(0, 2, 1, 3).reshape(-1, c.h * c.v))
    return np.concatenate(parts, axis=1).reshape(-1), np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])


def _read_dc(store: np.ndarray, scans: list[Scan], low: int) -> None:
    units = [_units(s) for s in scans]
    streams, part = _Streams(scans, [u[0] for u in units]), units[0][1]
    tables = [scans[0].tables[k] for k in part]
    for which in streams.groups(1):
        count, symbol, after = streams.symbols(which, tables, None, np.minimum(_AFTER, 15))
        if not np.array_equal(count, streams.count[which]):
            raise ValueError("a scan has other blocks than the frame")
        symbol = symbol.astype(np.int32)
        change = _signed(streams.bits(after, symbol), symbol)
        owner = np.repeat(np.arange(len(which)), count)
        inner = np.arange(len(symbol)) - np.repeat(np.cumsum(count) - count, count)
        block = streams.block[streams.begin[which][owner] + inner]
        for c in range(int(part.max()) + 1):
            own = np.flatnonzero(part[inner % len(part)] == c)
            sums = np.cumsum(change[own])
            head = np.searchsorted(owner[own], np.arange(len(which)))
            store[block[own], 0] = (sums - (sums - change[own])[head][owner[own]]) << low


def _read_dc_refinement(store: np.ndarray, scans: list[Scan], low: int) -> None:
    streams = _Streams(scans, [_units(s)[0] for s in scans])
    inner = np.arange(len(streams.block)) - np.repeat(streams.begin, streams.count)
    store[streams.block, 0] |= (streams.bits(np.repeat(streams.bit, streams.count) + inner, 1) << low).astype(np.int16)


READERS = {"first": _read_first, "refine": _read_refinement, "DC": _read_dc, "refine DC": _read_dc_refinement}


def decode_many(files: list[bytes]) -> list[Image]:
    """All coefficients of progressive files."""
    images = [_parse(f) for f in files]
    blocks = 0
    for image in images:
        for c in image.components:
            c.first, blocks = blocks, blocks + c.down * c.across
    store = np.zeros((blocks, 64), np.int16)
    for image in images:
        for c in image.components:
            c.coefficients = store[c.first : c.first + c.down * c.across].reshape(c.down, c.across, 64)
    for k in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[Scan]] = {}
        for image in images:
            if k < len(image.scans):
                kinds.setdefault(image.scans[k].kind, []).append(image.scans[k])
        for kind, scans in kinds.items():
            numbers = [x for x in kind[1:] if isinstance(x, int)]
            READERS[kind[0]](store, scans, *numbers)
    return images


def decode(data: bytes) -> Image:
    return decode_many([data])[0]


# -- pixels -----------------------------------------------------------------


def _inverse() -> np.ndarray:
    """From coefficients in zigzag order to samples in rows, as a 64 by 64 matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


INVERSE = _inverse()


def samples(image: Image, c: Component) -> np.ndarray:
    """A component's samples, whole blocks, 0 to 255."""
    rows, cols, _ = c.coefficients.shape
    table, flat = image.quantization[c.table][:, None] * INVERSE, c.coefficients.reshape(-1, 64)
    out = np.empty((rows * cols, 64), np.uint8)
    for at in range(0, len(flat), WORK // 64):
        plain = flat[at : at + WORK // 64].astype(np.float32) @ table
        plain += 128.5
        out[at : at + WORK // 64] = np.clip(plain, 0, 255.5)
    return out.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def pixels(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor, (height, width, 3) of bytes."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = [samples(image, c) for c in image.components]
    if len(planes) == 1:
        return np.repeat(planes[0][: image.height, : image.width, None], 3, axis=2)
    rgb = np.empty((image.height, image.width, 3), np.uint8)
    band = max(1, WORK // max(1, image.width) // 16) * 16
    for top in range(0, image.height, band):
        rows = slice(top, min(top + band, image.height))
        full = []
        for c, plane in zip(image.components, planes):
            part = plane[top * c.v // vmax : -(-rows.stop * c.v // vmax)]
            part = part.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
            full.append(part[: rows.stop - top, : image.width].astype(np.int32))
        # fixed-point conversion, so that equal files give equal bytes everywhere
        y, cb, cr = (full[0] << 16) + (1 << 15), full[1] - 128, full[2] - 128
        for k, value in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
            rgb[rows, :, k] = np.clip(value >> 16, 0, 255)
    return rgb
