"""Media columns: progressive JPEG written and read in numpy.

The decoder takes progressive Huffman files of 8 bits with one or three components: the scans of spectral selection and
successive approximation add up in coefficient arrays, which are dequantised, inverse-transformed in numpy, upsampled and
turned into full-resolution RGB tensors. Bits are read in lockstep: all restart intervals of all files of a batch that
share a scan's parameters are lanes of the same vectorised steps, so long or many files need no per-bit Python.

The writer stores bytes losslessly as the format's unit, quantised coefficients: byte b becomes b - 130 below 128 and
b - 125 from there, 4:2:0, six blocks of 64 in each 16 x 16 unit, quantisers of 1. Its scans: DC by one bit less, AC of Y
in two bands, AC of Cb and Cr, each by one bit less, then the last bit of all. A comment segment holds the number of bytes,
so that a file alone gives its payload back.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

UNIT = 576
#: Blocks in a restart interval of the writer.
RESTART = 4
#: Zigzag order (a fixed value of the format): natural place of the k-th coefficient, by diagonals.
ZIGZAG = np.array([r * 8 + c for d in range(15) for r, c in sorted(((i, d - i) for i in range(8) if 0 <= d - i < 8), key=lambda x: x[d % 2])])


# ---- Huffman tables ------------------------------------------------------------------------------------------------


def code_lengths(weights: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; a dummy of the least weight keeps the code of all ones free."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0, -1, (-1,))]
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    deepest = max(length.values())
    if length.pop(-1) != deepest:
        raise ValueError("the dummy must be among the longest codes")
    return length


class Table:
    """A canonical code: symbols in the order of their codes, with `counts` of each length 1 to 16."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.lookup = np.zeros(1 << 16, np.int32)  # symbol << 5 | length, by the next 16 bits; 0: no code
        code = at = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.code[s], self.size[s] = code, length
                self.lookup[code << (16 - length) : (code + 1) << (16 - length)] = s << 5 | length
                code += 1
            at, code = at + n, code << 1
        self.key = (tuple(counts), tuple(symbols))

    @classmethod
    def of(cls, weights: dict[int, int]) -> Table:
        length = code_lengths(weights)
        if max(length.values()) > 16:
            raise ValueError("a code is longer than 16 bits")
        return cls([sum(x == n for x in length.values()) for n in range(1, 17)], sorted(length, key=lambda s: (length[s], s)))


@lru_cache(maxsize=1)
def writer_tables() -> tuple[Table, Table]:
    """For DC differences (0 to 8 bits) and AC symbols of runs 0 to 15 by 0 to 8 bits."""
    dc = {s: 1 << (9 - abs(s - 4)) for s in range(10)}
    ac = {r << 4 | s: max(1, 4096 >> (2 * r + abs(s - 5))) for r in range(16) for s in range(9) if s or r in (0, 1, 2, 15)}
    return Table.of(dc), Table.of(ac)


# ---- writer --------------------------------------------------------------------------------------------------------


def to_coefficients(data: np.ndarray) -> np.ndarray:
    v = data.astype(np.int32)
    return v - np.where(v < 128, 130, 125)


def from_coefficients(v: np.ndarray) -> np.ndarray:
    return (v + np.where(v < 0, 130, 125)).astype(np.uint8)


def pack(values: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit strings `values` of `sizes` bits, joined in runs that end before items `ends`, each filled up with ones to a byte.

    Returns all bytes and each run's first byte (one more at the end).
    """
    total = np.concatenate(([0], np.cumsum(sizes)))
    bits = np.diff(np.concatenate(([0], total[ends])))
    n_bytes = (bits + 7) // 8
    first = np.concatenate(([0], np.cumsum(n_bytes)))
    counts = np.diff(np.concatenate(([0], ends)))
    shift = 8 * first[:-1] - np.concatenate(([0], total[ends]))[:-1]
    at = total[:-1] + np.repeat(shift, counts)
    pad = (8 * n_bytes - bits).astype(np.int64)
    at = np.concatenate((at, 8 * first[:-1] + bits))
    values, sizes = np.concatenate((values, (1 << pad) - 1)), np.concatenate((sizes, pad))
    word = at >> 5
    wide = values.astype(np.uint64) << (64 - sizes - (at & 31)).clip(0, 63).astype(np.uint64)
    wide[sizes == 0] = 0
    n = int(first[-1] + 3) // 4 + 2
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return words.astype(np.uint32).astype(">u4").tobytes()[: int(first[-1])], first


def bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _extra(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << s) - 1, v)


def _joined(data: bytes, first: np.ndarray, runs: list[int]) -> list[bytes]:
    """Each file's scan data: its runs, stuffed and parted by restart markers."""
    marks = [bytes((0xFF, 0xD0 + i)) for i in range(8)]
    out, r, edge = [], 0, first.tolist()
    for n in runs:
        own = data[edge[r] : edge[r + n]]
        if n == 1:
            out.append(own.replace(b"\xff", b"\xff\x00"))
        else:
            pieces = []
            for i in range(n):
                if i:
                    pieces.append(marks[(i - 1) & 7])
                pieces.append(data[edge[r + i] : edge[r + i + 1]].replace(b"\xff", b"\xff\x00") if 255 in own else data[edge[r + i] : edge[r + i + 1]])
            out.append(b"".join(pieces))
        r += n
    return out


def _ends(blocks: list[int], step: int) -> tuple[np.ndarray, list[int]]:
    """Where each restart interval of `step` blocks ends, over files of so many blocks, and each file's number of them."""
    out, runs, base = [], [], 0
    for n in blocks:
        ends = list(range(step, n, step)) + [n]
        out.append(np.array(ends) + base)
        runs.append(len(ends))
        base += n
    return np.concatenate(out), runs


def layout(units: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units: one column up to the format's height, then more."""
    columns = -(-units // 4095)
    return columns, -(-units // columns)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: How the comment segment with the payload's size begins.
_SIZE = b"payload bytes: "


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 576 bytes)."""
    dc, ac = writer_tables()
    shapes = [layout(-(-(len(p) // 64) // 6)) for p in payloads]
    units = [c * r for c, r in shapes]
    filled = b"".join(p + b"\xff" * (u * 384 - len(p)) for p, u in zip(payloads, units, strict=True))
    v = to_coefficients(np.frombuffer(filled, np.uint8)).reshape(-1, 64)  # in the order of units: Y Y Y Y Cb Cr
    order = []  # rows of v in the raster order of each component
    base = 0
    y_rows = []
    for (c, r), u in zip(shapes, units, strict=True):
        if c == 1:
            y_rows.append((np.arange(u)[:, None] * 6 + np.arange(4)).ravel() + base)
        else:
            row, col = np.divmod(np.arange(4 * u), 2 * c)
            y_rows.append(((row // 2) * c + col // 2) * 6 + (row % 2) * 2 + col % 2 + base)
        base += 6 * u
    order = [np.concatenate(y_rows), np.arange(sum(units)) * 6 + 4, np.arange(sum(units)) * 6 + 5]
    scans: list[tuple[tuple, list[bytes]]] = []
    # DC, one bit less.
    ends, runs = _ends(units, RESTART)
    high = (v[:, 0] >> 1).reshape(-1, 6)
    fresh = np.zeros(len(high), bool)
    fresh[np.concatenate(([0], ends[:-1]))] = True
    prior = np.empty_like(high)
    prior[:, 1:4] = high[:, 0:3]
    prior[1:, 0], prior[1:, 4:] = high[:-1, 3], high[:-1, 4:]
    prior[fresh, 0], prior[fresh, 4], prior[fresh, 5] = 0, 0, 0
    diff = (high - prior).ravel()
    s = bit_size(diff)
    scans.append(((0, 1, 2, 0, 0, 0, 1), _joined(*pack(dc.code[s] << s | _extra(diff, s), dc.size[s] + s, ends * 6), runs)))
    # AC, one bit less: no coefficient is 0, so every symbol has run 0.
    blocks = [[4 * u for u in units], units, units]
    cut = [_ends(b, RESTART) for b in blocks]
    for comp, low, top in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        x = v[order[comp], low : top + 1]
        x = (np.sign(x) * (np.abs(x) >> 1)).ravel()
        s = bit_size(x)
        scans.append(((comp, low, top, 0, 1), _joined(*pack(ac.code[s] << s | _extra(x, s), ac.size[s] + s, cut[comp][0] * (top - low + 1)), cut[comp][1])))
    # The last bits.
    last = (v & 1).astype(np.int64)
    scans.append(((0, 1, 2, 0, 0, 1, 0), _joined(*pack(last[:, 0], np.ones(len(last), np.int64), ends * 6), runs)))
    last = np.abs(v) & 1
    weights = [1 << np.arange(n - 1, -1, -1) for n in (31, 32)]
    for comp in range(3):
        ends, runs = cut[comp]
        x = last[order[comp], 1:].astype(np.int64)
        first = np.concatenate(([0], ends[:-1]))
        run = ends - first  # blocks with one end-of-band symbol
        s = bit_size(run) - 1
        values = np.zeros((len(x), 3), np.int64)
        sizes = np.zeros((len(x), 3), np.int64)
        values[first, 0], sizes[first, 0] = ac.code[s << 4] << s | (run - (1 << s)), ac.size[s << 4] + s
        values[:, 1], sizes[:, 1] = x[:, :31] @ weights[0], 31
        values[:, 2], sizes[:, 2] = x[:, 31:] @ weights[1], 32
        scans.append(((comp, 1, 63, 1, 0), _joined(*pack(values.ravel(), sizes.ravel(), ends * 3), runs)))
    tables = b"".join(bytes([kind]) + bytes(t.counts) + bytes(t.symbols) for kind, t in ((0x00, dc), (0x10, ac)))
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + b"\1" * 64)
    tail = _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", RESTART))
    sos = []
    for spec, _ in scans:
        comps, rest = (spec[:3], spec[3:]) if len(spec) == 7 else (spec[:1], spec[1:])
        sos.append(_segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([rest[0], rest[1], rest[2] << 4 | rest[3]])))
    out = []
    for i, (c, r) in enumerate(shapes):
        size = _segment(0xFE, _SIZE + str(len(payloads[i])).encode())
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * r, 16 * c, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([head, size, frame, tail, *[x for h, (_, data) in zip(sos, scans, strict=True) for x in (h, data[i])], b"\xff\xd9"]))
    return out


# ---- reader --------------------------------------------------------------------------------------------------------


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


class File:
    """Parsed markers of one file: components, shape, quantisers and the scans with their raw data."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quantisers: dict[int, np.ndarray] = {}
        self.comps: list[Component] = []
        self.scans: list[tuple] = []
        self.payload: int | None = None  # as write() tells it
        tables: dict[int, Table] = {}
        restart, at = 0, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE and body.startswith(_SIZE) and body[len(_SIZE) :].isdigit():
                self.payload = int(body[len(_SIZE) :])
            elif marker == 0xC2:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8 or n not in (1, 3):
                    raise ValueError("only 8 bits and one or three components")
                if not (self.height and self.width and all(c.h in (1, 2, 4) and c.v in (1, 2, 4) for c in self.comps)):
                    raise ValueError("an empty image or odd sampling factors")
                self.hmax, self.vmax = max(c.h for c in self.comps), max(c.v for c in self.comps)
                self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                for c in self.comps:
                    c.across, c.down = self.mx * c.h, self.my * c.v  # with padding
                    c.real = -(-(self.width * c.h) // (8 * self.hmax)), -(-(self.height * c.v) // (8 * self.vmax))
            elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only progressive Huffman files")
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    tables[body[0]] = _table(tuple(counts), bytes(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                which = [next(i for i, c in enumerate(self.comps) if c.ident == body[1 + 2 * i0]) for i0 in range(n)]
                ids = [body[2 + 2 * i0] for i0 in range(n)]
                low, top, approx = body[1 + 2 * n : 4 + 2 * n]
                end = _SCAN_END.search(data, at)
                end = end.start() if end else len(data)
                coded = [tables.get((0x00 if not low else 0x10) | (t >> 4 if not low else t & 15)) for t in ids]
                self.scans.append((tuple(which), low, top, approx >> 4, approx & 15, coded, restart, data[at:end]))
                at = end
        self.check()

    def check(self) -> None:
        """Before anything is allocated: each block takes a bit of a first DC scan at least, so a file can't claim more than it holds."""
        for i, c in enumerate(self.comps):
            if c.real[0] * c.real[1] > sum(8 * len(s[-1]) for s in self.scans if i in s[0] and not s[1] and not s[3]):
                raise ValueError("more blocks than bits")


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=64)
def _table(counts: tuple, symbols: bytes) -> Table:
    return Table(list(counts), list(symbols))


class Bits:
    """Restart intervals of many scans, unstuffed, as lanes over one byte array."""

    def __init__(self, intervals: list[bytes]):
        sizes = np.array([len(x) for x in intervals], np.int64)
        self.raw = np.frombuffer(b"".join(intervals) + b"\xff" * 8, np.uint8)
        self.pos = 8 * np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        x = self.raw.astype(np.uint64)
        n = len(x) - 4
        self.window = ((x[:n] << np.uint64(32)) | (x[1 : n + 1] << np.uint64(24)) | (x[2 : n + 2] << np.uint64(16)) | (x[3 : n + 3] << np.uint64(8)) | x[4 : n + 4]).astype(np.int64)

    def at(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """40 bits from the byte that holds pos, and how many of them are left from pos."""
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)], 40 - (pos & 7)


def _symbols(bits: Bits, pos: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    window, left = bits.at(pos)
    e = lookup[(window >> (left - 16)) & 0xFFFF].astype(np.int64)
    if not e.all():
        raise ValueError("bits that are no code")
    return e >> 5, e & 31, window, left


def _grown(window: np.ndarray, left: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The signed number in the next s bits; left: what is left after the code."""
    x = (window >> (left - s)) & ((1 << s) - 1)
    return np.where((s > 0) & (x < (1 << np.maximum(s - 1, 0))), x - (1 << s) + 1, x)


def _dc_scan(bits: Bits, lanes, tables: list[np.ndarray], comp_of: np.ndarray, refine: bool, al: int, coefs: np.ndarray) -> None:
    """lanes: (rows of coefs in reading order, first of each lane, one past the last); comp_of: component of each row read."""
    rows, start, end = lanes
    pos, at = bits.pos.copy(), start.copy()
    prior = np.zeros((len(start), 3), np.int64)
    live = np.flatnonzero(at < end)
    while len(live):
        i, p = at[live], pos[live]
        if refine:
            window, left = bits.at(p)
            coefs[rows[i], 0] |= (((window >> (left - 1)) & 1) << al).astype(coefs.dtype)
            pos[live] = p + 1
        else:
            comp = comp_of[i]
            value, used = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for c, lookup in enumerate(tables):
                own = np.flatnonzero(comp == c)
                if len(own):
                    s, size, window, left = _symbols(bits, p[own], lookup)
                    value[own], used[own] = _grown(window, left - size, s), size + s
            value += prior[live, comp]
            prior[live, comp] = value
            coefs[rows[i], 0] = value << al
            pos[live] = p + used
        at[live] = i + 1
        live = live[at[live] < end[live]]


def _ac_first(bits: Bits, lanes, lookup: np.ndarray, low: int, top: int, al: int, coefs: np.ndarray) -> None:
    rows, start, end = lanes
    flat = coefs.reshape(-1)
    pos, at, end = bits.pos.copy(), start.copy(), end.copy()
    k = np.full(len(at), low, np.int64)
    keep = at < end
    if not keep.all():
        pos, at, end, k = pos[keep], at[keep], end[keep], k[keep]
    while len(at):
        sym, size, window, left = _symbols(bits, pos, lookup)
        s, r = sym & 15, sym >> 4
        plain = s > 0
        value = _grown(window, left - size, s)
        pos += size + s
        k += r
        if plain.all():
            if (k > top).any():
                raise ValueError("a run leaves its band")
            flat[rows[at] * 64 + k] = value << al
            k += 1
            over = k > top
            at += over
        else:
            own = np.flatnonzero(plain)
            if (k[own] > top).any():
                raise ValueError("a run leaves its band")
            flat[rows[at[own]] * 64 + k[own]] = value[own] << al
            stop = ~plain & (r < 15)
            run = np.where(stop, (1 << r) + np.where(r > 0, (window >> (left - size - r)) & ((1 << r) - 1), 0), 0)
            pos += np.where(stop, r, 0)
            k += 1
            over = (k > top) & ~stop
            at += over + run
            over |= stop
        k[over] = low
        keep = at < end
        if not keep.all():
            pos, at, end, k = pos[keep], at[keep], end[keep], k[keep]


def _ac_refine(bits: Bits, lanes, lookup: np.ndarray, low: int, top: int, al: int, coefs: np.ndarray) -> None:
    rows, start, end = lanes
    single = np.unpackbits(bits.raw)
    pos, at, end = bits.pos.copy(), start.copy(), end.copy()
    k, run = np.full(len(at), low, np.int64), np.zeros(len(at), np.int64)
    band = np.arange(low, top + 1)
    while True:
        keep = at < end
        if not keep.all():
            pos, at, end, k, run = pos[keep], at[keep], end[keep], k[keep], run[keep]
        if not len(at):
            return
        block = coefs[rows[at], low : top + 1]
        old = block != 0
        limit = np.full(len(at), top + 1, np.int64)  # coefficients from k to before limit are corrected
        placed = np.zeros(len(at), np.int64)
        read = np.flatnonzero(run == 0)
        if len(read):
            sym, size, window, left = _symbols(bits, pos[read], lookup)
            s, r = sym & 15, sym >> 4
            if (s > 1).any():
                raise ValueError("a refining symbol has more than one bit")
            stop = (s == 0) & (r < 15)
            more = np.where(stop, r, s)
            extra = (window >> (left - size - more)) & ((1 << more) - 1)
            pos[read] += size + more
            run[read] = np.where(stop, (1 << r) + extra, 0)
            going = np.flatnonzero(~stop)
            if len(going):
                i = read[going]
                zero = ~old[i] & (band[None, :] >= k[i][:, None])
                hit = (np.cumsum(zero, axis=1) == (r[going] + 1)[:, None]) & zero
                limit[i] = np.where(hit.any(axis=1), low + hit.argmax(axis=1), top + 1)
                placed[i] = np.where(s[going] == 1, np.where(extra == 1, 1, -1), 0)
        fix = old & (band[None, :] >= k[:, None]) & (band[None, :] < limit[:, None])
        order = np.cumsum(fix, axis=1)
        bit = single[np.minimum(pos[:, None] + order - fix, len(single) - 1)] & fix
        block = block + np.sign(block) * (bit.astype(block.dtype) << al)
        pos += order[:, -1]
        new = np.flatnonzero((placed != 0) & (limit <= top))
        block[new, limit[new] - low] = placed[new] << al
        coefs[rows[at], low : top + 1] = block
        ending = run > 0
        run -= ending
        over = ending | (limit >= top)
        at += over
        k = np.where(over, low, limit + 1)


def coefficients(files: list[File]) -> list[list[np.ndarray]]:
    """Quantised coefficients (blocks x 64 in zigzag order, raster order of the padded component) of each file's components."""
    base, bases = 0, []
    for f in files:
        own = []
        for c in f.comps:
            own.append(base)
            base += c.across * c.down
        bases.append(own)
    coefs = np.zeros((base, 64), np.int32)
    groups: dict[tuple, list] = {}
    for n in range(max((len(f.scans) for f in files), default=0)):  # the n-th scans only need those before them
        groups.clear()
        for i, f in enumerate(files):
            if n < len(f.scans):
                which, low, top, ah, al, coded, restart, data = f.scans[n]
                if not (ah and not low) and None in coded:
                    raise ValueError("a Huffman table is missing")
                groups.setdefault((which, low, top, ah, al, tuple(t.key if t else None for t in coded)), []).append((i, coded, restart, data))
        for (which, low, top, ah, al, _), own in groups.items():
            intervals, rows, comps, start, end, done = [], [], [], [], [], 0
            for i, _, restart, data in own:
                f = files[i]
                if len(which) > 1:
                    got, comp = _interleaved(f, which, bases[i])
                    unit = sum(f.comps[c].h * f.comps[c].v for c in which)
                else:
                    c = f.comps[which[0]]
                    got = (np.arange(c.real[1])[:, None] * c.across + np.arange(c.real[0])).ravel() + bases[i][which[0]]
                    comp, unit = np.zeros(len(got), np.int64), 1
                step = restart * unit or len(got)
                parts = [p.replace(b"\xff\x00", b"\xff") for p in (_RESTARTS.split(data) if restart else [data])]
                first = np.arange(0, len(got), step)
                if len(parts) != len(first):
                    raise ValueError("restart intervals are missing")
                intervals += parts
                rows.append(got)
                comps.append(comp)
                start.append(first + done)
                end.append(np.minimum(first + step, len(got)) + done)
                done += len(got)
            bits = Bits(intervals)
            lanes = np.concatenate(rows), np.concatenate(start), np.concatenate(end)
            tables = [t.lookup if t else None for t in own[0][1]]
            if not low:
                _dc_scan(bits, lanes, tables, np.concatenate(comps), bool(ah), al, coefs)
            elif ah:
                _ac_refine(bits, lanes, tables[0], low, top, al, coefs)
            else:
                _ac_first(bits, lanes, tables[0], low, top, al, coefs)
    return [[coefs[b : b + c.across * c.down] for b, c in zip(own, f.comps, strict=True)] for own, f in zip(bases, files, strict=True)]


def _interleaved(f: File, which: tuple, bases: list[int]) -> tuple[np.ndarray, np.ndarray]:
    units, comps = [], []
    y, x = np.divmod(np.arange(f.mx * f.my), f.mx)
    for n, i in enumerate(which):
        c = f.comps[i]
        for r in range(c.v):
            for q in range(c.h):
                units.append((y * c.v + r) * c.across + x * c.h + q + bases[i])
                comps.append(n)
    return np.stack(units, axis=1).ravel(), np.tile(np.array(comps), f.mx * f.my)


@lru_cache(maxsize=1)
def _transform() -> np.ndarray:
    """64 x 64: what each zigzag coefficient adds to each sample, times 8192, rounded; sums of integers are exact in float64."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG] * 8192)


def samples(blocks: np.ndarray, quantiser: np.ndarray, across: int) -> np.ndarray:
    """Level-shifted samples 0 to 255 (int32) of a component."""
    got = (blocks * quantiser).astype(np.float64) @ _transform()
    got = np.floor((got + 4096) / 8192).astype(np.int32) + 128
    np.clip(got, 0, 255, out=got)
    return got.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)


def tensor(f: File, blocks: list[np.ndarray]) -> np.ndarray:
    """height x width x 3 RGB (uint8); chroma is upsampled by repetition."""
    planes = []
    for c, b in zip(f.comps, blocks, strict=True):
        p = samples(b, f.quantisers[c.table], c.across)
        if (c.h, c.v) != (f.hmax, f.vmax):
            p = p.repeat(f.vmax // c.v, axis=0).repeat(f.hmax // c.h, axis=1)
        planes.append(p[: f.height, : f.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.int32)
    half = 1 << 15  # ITU-R BT.601 in 16-bit fixed point
    out[..., 0] = y + ((91881 * cr + half) >> 16)
    out[..., 1] = y - ((22554 * cb + 46802 * cr + half) >> 16)
    out[..., 2] = y + ((116130 * cb + half) >> 16)
    return np.clip(out, 0, 255).astype(np.uint8)


def read(medias: list[bytes]) -> list[tuple[File, list[np.ndarray], np.ndarray]]:
    """File, coefficient arrays and RGB tensor of each; ValueError for what isn't a progressive JPEG of the kind above."""
    files = [File(m) for m in medias]
    return [(f, b, tensor(f, b)) for f, b in zip(files, coefficients(files), strict=True)]


def payload_of(f: File, blocks: list[np.ndarray]) -> bytes:
    """The payload that write() stored, from the file alone; without its size in the file, all samples."""
    units = f.mx * f.my
    v = np.empty((units, 6, 64), np.int32)
    y = blocks[0].reshape(f.my, 2, f.mx, 2, 64).transpose(0, 2, 1, 3, 4).reshape(units, 4, 64)
    v[:, :4], v[:, 4], v[:, 5] = y, blocks[1], blocks[2]
    return from_coefficients(v).tobytes()[: f.payload]


def media_rows(texts: list[bytes]):
    """For each text: payload bytes read back from the media bytes alone, media bytes, RGB tensor."""
    for a, b in chunks(texts, 1_500_000):
        padded = [t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts[a:b]]
        medias = write(padded)
        for m, (f, blocks, rgb) in zip(medias, read(medias), strict=True):
            yield payload_of(f, blocks), m, rgb


#: Bytes of media and tensors that are sent to the JVM at a time, one row at least.
SENT = 16_000_000


def _sent(rows, kinds: list, names: list[str]):
    """Arrow batches of rows (tuples), cut by their bytes."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)


def feature(rgb: np.ndarray) -> str:
    """Shape, channel means in thousandths and checksum of a tensor."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{'-'.join(map(str, means.tolist()))}:{zlib.crc32(rgb.tobytes()):08x}"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_tensor: bool = True) -> DataFrame:
    """doc_id, media binary (a progressive JPEG of the text's bytes), height, width, rgb binary (height x width x 3, read back).

    Null text counts as empty; an empty text is stored as 576 bytes 255. Repeated rows and null ids come out as they went
    in; an empty table gives an empty result; other columns aren't read.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                got = zip(part.column(0).to_pylist(), media_rows(utf8(part.column(1))), strict=True)
                rows = ((i, m, *x.shape[:2], x.tobytes() if keep_tensor else None) for i, (_, m, x) in got)
                yield from _sent(rows, [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()], ["doc_id", "media", "height", "width", "rgb"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, media binary, height int, width int, rgb binary")


def tensors(media: DataFrame, *, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, height, width, rgb of stored progressive JPEGs; all null for null bytes and for what can't be read."""

    def run(batches):
        import pyarrow as pa

        def row(i, m):
            try:
                rgb = read([m])[0][2] if m is not None else None
            except (ValueError, struct.error, IndexError, StopIteration, KeyError, AttributeError):
                rgb = None
            return (i, *rgb.shape[:2], rgb.tobytes()) if rgb is not None else (i, None, None, None)

        for batch in batches:
            rows = (row(i.as_py(), m.as_py()) for i, m in zip(batch.column(0), batch.column(1), strict=True))
            yield from _sent(rows, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["doc_id", "height", "width", "rgb"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), media_col).mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What media_columns stores and reads back, as digests (cases as there)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = utf8(part.column(1))
                got = [(len(t), len(p), sha(p), zlib.crc32(p[-32:]), len(m), sha(m), feature(x)) for t, (p, m, x) in zip(texts, media_rows(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, schema)


def op4_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    """What every document's text is stored as and reads back to, as digests; cases as media_columns.

    Media are no SQL; tests/llm compares the round trip byte by byte and the tensors with an inverse transform of its own.
    """
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
