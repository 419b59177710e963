"""Media columns: bytes kept losslessly in progressive JPEG images, and a progressive JPEG decoder in numpy.

Writing: a payload's bytes become the quantised DCT coefficients of a 4:2:0 image, the format's unit that its entropy
coding keeps exactly: a byte's rank in ``ORDER`` (bytes that texts use most come first) gives a small number, positive
or negative and never zero, and small numbers have short codes. The scan script selects spectra (DC, then AC of each
component) and approximates successively (all but the lowest bit first, then the lowest). Restart markers bound each
interval. The quantisation tables are the example tables of the JPEG standard.

Reading: the scans of all images of a batch are accumulated into coefficient arrays. The restart intervals of all
images are decoded in lock-step, one symbol of every interval at a time, by table look-ups on arrays; refinement
bits are gathered at once where an interval is one end-of-band run (and one by one where it is not). Then the
coefficients are dequantised, inverse-transformed (fixed-point numbers in float64, hence exact whatever the batch),
chroma is upsampled, and the RGB tensor is at full resolution.

The decoder reads any 8-bit progressive Huffman image with one or three components whose chroma is sampled 1x1 or
2x2; anything else raises ValueError. A whole payload, its coefficients and tensor (about 40 bytes for each byte) must
fit in a worker; batches are cut to ``budget`` bytes.

Defined results: null counts as empty; an empty payload is padded like any other. Equal payloads, equal images.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, col

PAD = 192
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Blocks (AC) or MCUs (DC) in a restart interval, by kind of scan.
EVERY = {"dc": 16, "ac": 8, "refine": 512}
SCALE = 11


def transform() -> np.ndarray:
    """Row: coefficient in zigzag order; column: sample; fixed-point."""
    x = np.arange(8)
    c = np.where(x == 0, math.sqrt(0.125), 0.5)
    one = c[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / 16)
    full = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << SCALE))


BASIS = transform()


# -- Huffman tables, canonical, from code lengths by rule


def lengths_ac() -> list[tuple[int, int]]:
    """Numbers of 1 to 7 bits have codes of about as many; all other symbols (runs of zeros and of blocks) 14."""
    first = dict(zip(range(1, 8), (1, 2, 3, 4, 5, 7, 7)))
    return [*first.items(), *((r << 4 | s, 14) for r in range(16) for s in range(11) if r << 4 | s not in first)]


def dht(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(1 for _, n in lengths if n == k) for k in range(1, 17)]
    body = bytes([kind, *counts, *(s for s, _ in lengths)])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical table."""
    out, code, at = [], 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out.append((symbols[at], code, n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


AC, DC = lengths_ac(), [(s, 4) for s in range(12)]
AC_DHT, DC_DHT = dht(0x10, AC), dht(0x00, DC)


def book(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in codes(segment[5:21], segment[21:]):
        code[s], length[s] = c, n
    return code, length


AC_CODE, AC_LEN = book(AC_DHT)
DC_CODE, DC_LEN = book(DC_DHT)


# Letters and marks in the order of their frequency in text; all other bytes follow by value, graphic ASCII first.
COMMON = b" etaoinsrhldcumfpgwybv.,k"
ORDER = np.array(list(dict.fromkeys([*COMMON, *range(33, 127), *range(256)])), np.uint8)
RANK = np.argsort(ORDER).astype(np.int64)
#: For each byte its AC coefficient: 2, -2, 3, -3, ... by rank, so that what remains without the lowest bit is not zero.
VALUE = (2 + RANK // 2) * np.where(RANK % 2, -1, 1)

# For each byte of a payload: code and value of its first AC approximation, and their bits together; bit of the second.
_high = np.abs(VALUE) >> 1
_bits = np.frexp(_high.astype(np.float32))[1].astype(np.int64)
FIRST, FIRST_BITS = AC_CODE[_bits] << _bits | np.where(VALUE < 0, (1 << _bits) - 1 - _high, _high), AC_LEN[_bits] + _bits
SECOND = np.abs(VALUE) & 1

# -- writing


def packed(values: np.ndarray, widths: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Bit strings of symbols, cut at ``ends``, each padded with ones to whole bytes and stuffed."""
    bits = np.concatenate([[0], np.cumsum(widths)])
    cuts = np.concatenate([[0], ends])
    size = bits[cuts[1:]] - bits[cuts[:-1]]
    octets = (size + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(octets)])
    at = bits[:-1] + np.repeat(begin[:-1] * 8 - bits[cuts[:-1]], np.diff(cuts))
    wide = values.astype(np.uint64) << (64 - (at & 31) - widths).astype(np.uint64)
    word = at >> 5
    out = np.zeros(int(begin[-1] >> 2) + 3, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    where = word[first]
    out[where] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first).astype(np.uint32)
    out[where + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    data = out.byteswap().view(np.uint8)
    data[begin[1:] - 1] |= ((1 << (octets * 8 - size)) - 1).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


MARKERS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def joined(intervals: list[bytes]) -> bytes:
    if len(intervals) == 1:
        return intervals[0]
    out = []
    for k, x in enumerate(intervals):
        out += [x, MARKERS[k & 7]]
    out.pop()
    return b"".join(out)


def sos(parts: list[tuple[int, int]], low: int, high: int, bits: int, every: int) -> bytes:
    head = b"\xff\xdd\x00\x04" + struct.pack(">H", every)
    body = bytes([len(parts), *(b for p in parts for b in p), low, high, bits])
    return head + b"\xff\xda" + struct.pack(">H", 2 + len(body)) + body


ALL = [(1, 0), (2, 0), (3, 0)]
SOS_DC, SOS_DC2 = sos(ALL, 0, 0, 0x01, EVERY["dc"]), sos(ALL, 0, 0, 0x10, EVERY["refine"])
SOS_AC = [sos([(k, 0)], 1, 63, 0x01, EVERY["ac"]) for k in (1, 2, 3)]
SOS_AC2 = [sos([(k, 0)], 1, 63, 0x10, EVERY["refine"]) for k in (1, 2, 3)]
# Example quantisation tables of the JPEG standard for luminance and chrominance, by rows.
LUMINANCE = """
16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99
"""
CHROMINANCE = "17 18 24 47 18 21 26 66 24 26 56 99 47 66 99 99"  # the upper left quarter; the rest is 99


def dqt(number: int, rows: np.ndarray) -> bytes:
    return b"\xff\xdb\x00\x43" + bytes([number, *rows.ravel()[ZIGZAG].tolist()])


_chroma = np.full((8, 8), 99)
_chroma[:4, :4] = np.array(CHROMINANCE.split(), int).reshape(4, 4)
DQT = dqt(0, np.ones((8, 8), int))
DQTS = dqt(0, np.array(LUMINANCE.split(), int).reshape(8, 8)) + dqt(1, _chroma)


def chunked(counts: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of each interval when each image's units are cut by ``every``; number of intervals of each image."""
    per = -(-counts // every)
    size = np.full(int(per.sum()), every)
    size[np.cumsum(per) - 1] = counts - (per - 1) * every
    return size, per


def write(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG for each non-empty payload."""
    mcus = np.array([-(-len(p) // 384) for p in payloads])
    cols = np.array([max(1, math.isqrt(m)) for m in mcus])
    rows = -(-mcus // cols)
    mcus = cols * rows
    if (rows > 4095).any():
        raise ValueError("payload too large for one image")
    raw = b"".join(p.ljust(m * 384, b" ") for p, m in zip(payloads, mcus.tolist()))
    value = np.frombuffer(raw, np.uint8).reshape(-1, 64)
    start = np.concatenate([[0], np.cumsum(mcus)]) * 6  # blocks: of an image 4m of Y, m of Cb, m of Cr
    scans: list[list[bytes]] = [[] for _ in payloads]
    # DC first: differences to the block before, in the interleaved order of MCUs
    order = np.concatenate([interleaved(int(c), int(r)) + s for c, r, s in zip(cols, rows, start)])
    size, per = chunked(mcus, EVERY["dc"])
    rank = RANK[value[order, 0]]
    dc = (rank >> 1).reshape(-1, 6)
    before = np.zeros_like(dc)
    before[:, 1:4] = dc[:, 0:3]
    before[1:, 0] = dc[:-1, 3]
    before[1:, 4:] = dc[:-1, 4:]
    fresh = np.concatenate([[0], np.cumsum(size)[:-1]])
    for c in (0, 4, 5):
        before[fresh, c] = 0
    diff = (dc - before).ravel()
    n = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << n) - 1, diff)
    put(scans, SOS_DC, packed(DC_CODE[n] << n | extra, DC_LEN[n] + n, np.cumsum(size) * 6), per)
    # AC first, then both refinements; an image's blocks of one component lie together
    spans = [(0, 4), (4, 5), (5, 6)]
    blocks = [np.concatenate([np.arange(s + a * m, s + b * m) for s, m in zip(start[:-1].tolist(), mcus.tolist())]) for a, b in spans]
    for k, (a, b) in enumerate(spans):
        octets = value[blocks[k], 1:]
        v, w, by = FIRST[octets], FIRST_BITS[octets], 1
        if w.reshape(-1, 3).sum(1).max() <= 32:  # three symbols fit one word
            v, w, by = v.reshape(-1, 3), w.reshape(-1, 3), 3
            v = (v[:, 0] << w[:, 1] | v[:, 1]) << w[:, 2] | v[:, 2]
            w = w.sum(1)
        size, per = chunked(mcus * (b - a), EVERY["ac"])
        put(scans, SOS_AC[k], packed(v.ravel(), w.ravel(), np.cumsum(size) * (63 // by)), per)
    size, per = chunked(mcus, EVERY["refine"])
    bit = rank & 1
    put(scans, SOS_DC2, packed(bit, np.ones_like(bit), np.cumsum(size) * 6), per)
    for k, (a, b) in enumerate(spans):
        size, per = chunked(mcus * (b - a), EVERY["refine"])
        r = np.frexp(size.astype(np.float32))[1].astype(np.int64) - 1
        lead, lead_w = AC_CODE[r << 4] << r | (size - (1 << r)), AC_LEN[r << 4] + r
        bits = SECOND[value[blocks[k], 1:]]
        # 63 bits of a block as three symbols of 21; before an interval's first comes its end-of-band run
        thirds = bits.reshape(-1, 21).astype(np.float64) @ (2.0 ** np.arange(20, -1, -1))
        at = np.concatenate([[0], np.cumsum(size)[:-1]]) * 3
        values, widths = np.insert(thirds.astype(np.int64), at, lead), np.insert(np.full(len(thirds), 21), at, lead_w)
        put(scans, SOS_AC2[k], packed(values, widths, np.cumsum(size * 3 + 1)), per)
    out = []
    for p, c, r, s in zip(payloads, cols.tolist(), rows.tolist(), scans):
        note = b"bytes=%d" % len(p)
        head = b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(note)) + note + DQTS
        frame = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, r * 16, c * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
        out.append(b"".join([head, frame, DC_DHT, AC_DHT, *s, b"\xff\xd9"]))
    return out


def put(scans: list[list[bytes]], head: bytes, intervals: list[bytes], per: np.ndarray) -> None:
    at = 0
    for s, n in zip(scans, per.tolist()):
        s += [head, joined(intervals[at : at + n])]
        at += n


_orders: dict[tuple[int, int], np.ndarray] = {}


def interleaved(cols: int, rows: int) -> np.ndarray:
    """Blocks in MCU order, of an image that keeps 4m Y blocks by rows, then Cb, then Cr."""
    if (cols, rows) not in _orders:
        if len(_orders) > 4000:
            _orders.clear()
        m = cols * rows
        y, x = np.divmod(np.arange(m), cols)
        first = (2 * y) * (2 * cols) + 2 * x
        _orders[cols, rows] = np.stack([first, first + 1, first + 2 * cols, first + 2 * cols + 1, 4 * m + np.arange(m), 5 * m + np.arange(m)], 1).ravel()
    return _orders[cols, rows]


# -- reading


@dataclass
class Scan:
    parts: list[int]  # components, by place in the frame
    low: int
    high: int
    past: int
    shift: int
    every: int
    dc: list[bytes]  # Huffman tables
    ac: bytes | None
    intervals: list[bytes]


@dataclass
class Image:
    width: int
    height: int
    sampling: list[tuple[int, int]]
    quant: list[np.ndarray]
    scans: list[Scan]
    note: bytes

    def grid(self, k: int) -> tuple[int, int, int, int]:
        """Columns and rows of blocks: as stored (whole MCUs), and as single-component scans have them."""
        hm, vm = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        h, v = self.sampling[k]
        mc, mr = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        return mc * h, mr * v, -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)


ENTROPY_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quants, dcs, acs, every, note = 2, {}, {}, {}, 0, b""
    image = None
    while at < len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            break
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                (acs if body[0] >> 4 else dcs)[body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xFE:
            note = body
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            sampling = [(p[1] >> 4, p[1] & 15) for p in parts]
            if depth != 8 or sampling not in ([(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]):
                raise ValueError("unsupported frame")
            image, ids = Image(width, height, sampling, [quants[p[2]] for p in parts], [], b""), [p[0] for p in parts]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman image")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            low, high, bits = body[1 + 2 * n : 4 + 2 * n]
            end = ENTROPY_END.search(data, at)
            end = end.start() if end else len(data)
            intervals = [x.replace(b"\xff\x00", b"\xff") for x in RESTART.split(data[at:end])]
            at = end
            image.scans.append(Scan([c for c, _ in chosen], low, high, bits >> 4, bits & 15, every, [dcs.get(t >> 4) for _, t in chosen], acs.get(chosen[0][1] & 15), intervals))
    if image is None:
        raise ValueError("no frame")
    image.note = note
    return image


_luts: dict[bytes, np.ndarray] = {}


def lut(table: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code they begin with."""
    if table not in _luts:
        if len(_luts) > 200:
            _luts.clear()
        out = np.zeros(1 << 16, np.int32)
        for s, c, n in codes(table[:16], table[16:]):
            out[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
        _luts[table] = out
    return _luts[table]


class Bits:
    """Intervals end to end; 64 bits from any bit position."""

    def __init__(self, intervals: list[bytes]):
        lengths = np.array([len(x) for x in intervals], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] * 8
        raw = np.frombuffer(b"".join(intervals) + bytes(16), np.uint8)
        self.raw = raw
        n = len(raw) - 8
        self.window = np.zeros(n, np.uint64)
        for k in range(8):
            self.window |= raw[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)

    def at(self, p: np.ndarray) -> np.ndarray:
        return self.window[p >> 3] << (p & 7).astype(np.uint64)


U = np.uint64


def ac_first(bits: Bits, lanes, coefs: np.ndarray, luts: np.ndarray) -> None:
    """lanes: arrays (table, place of the first block in ``order``, blocks, low, high, shift); order: flat coefficient bases."""
    table, first, left, low, high, shift, order = lanes
    p, k, at, window = bits.starts.astype(np.uint64), low.copy(), first.copy(), bits.window
    base, offset = order[at], (table << 16).astype(np.uint64)
    flat = luts.ravel()
    length, size, skip = (flat >> 8).astype(np.uint64), (flat & 15).astype(np.uint64), (flat >> 4 & 15).astype(np.int64)
    half, span = np.array([0] + [1 << s - 1 for s in range(1, 16)]), np.array([0] + [(1 << s) - 1 for s in range(1, 16)])
    while len(p):
        w = window[(p >> U(3)).view(np.int64)] << (p & U(7))
        code = ((w >> U(48)) + offset).view(np.int64)
        n, s, r = length[code], size[code], skip[code]
        if not n.all():
            raise ValueError("bad Huffman code")
        rest = (w << n) >> U(1)
        x, t = (rest >> (U(63) - s)).view(np.int64), s.view(np.int64)
        v = x - (x < half[t]) * span[t]
        k = k + r
        if s.all():
            coefs[base + k] = v << shift
            p = p + n + s
            moved = np.zeros(len(p), np.int64)
        else:
            plain = np.flatnonzero(t)
            coefs[base[plain] + k[plain]] = v[plain] << shift[plain]
            eob = (t == 0) & (r < 15)
            run = (1 << r) + (rest >> (63 - r).astype(np.uint64)).view(np.int64)
            p = p + n + np.where(eob, r, t).astype(np.uint64)
            moved = np.where(eob, run, 0)
            k = np.where(eob, low - 1, k)
        k += 1
        full = k > high
        if full.any() or moved.any():
            moved += full
            k = np.where(full, low, k)
            at, left = at + moved, left - moved
            stay = np.flatnonzero(left > 0)
            if len(stay) < len(p):
                p, k, at, left, low, high, shift, offset = (z[stay] for z in (p, k, at, left, low, high, shift, offset))
            base = order[at]


def one_refine(data: np.ndarray, p: int, table: np.ndarray, blocks: np.ndarray, low: int, high: int, shift: int, coefs: np.ndarray) -> None:
    """The general AC refinement of one interval."""
    stream = np.unpackbits(data[p >> 3 :]).tolist()
    at, one, run = p & 7, 1 << shift, 0

    def take(n: int) -> int:
        nonlocal at
        out = 0
        for b in stream[at : at + n]:
            out = out << 1 | b
        at += n
        return out

    for base in blocks.tolist():
        k = low
        while k <= high and not run:
            e = int(table[int("".join(map(str, (stream[at : at + 16] + [0] * 16)[:16])), 2)])
            at += e >> 8
            r, s, new = (e & 255) >> 4, e & 15, 0
            if s:
                new = one if take(1) else -one
            elif r < 15:
                run = (1 << r) + take(r)
                break
            while k <= high:
                c = int(coefs[base + k])
                if c:
                    if take(1) and not abs(c) & one:
                        coefs[base + k] = c + one if c > 0 else c - one
                elif r == 0:
                    if new:
                        coefs[base + k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            while k <= high:
                c = int(coefs[base + k])
                if c and take(1) and not abs(c) & one:
                    coefs[base + k] = c + one if c > 0 else c - one
                k += 1
            run -= 1


def ac_refine(bits: Bits, lanes, coefs: np.ndarray, luts: np.ndarray) -> None:
    table, first, count, low, high, shift, order = lanes
    p = bits.starts
    w = bits.at(p)
    e = luts[table, (w >> U(48)).astype(np.int64)]
    n, sym = (e >> 8).astype(np.int64), (e & 255).astype(np.int64)
    r = sym >> 4
    run = (1 << r) + (((w << n.astype(np.uint64)) >> U(1)) >> (63 - r).astype(np.uint64)).astype(np.int64)
    whole = (sym & 15 == 0) & (r < 15) & (run >= count) & (low == 1) & (high == 63)
    for i in np.flatnonzero(~whole):
        one_refine(bits.raw, int(p[i]), luts[table[i]], order[first[i] : first[i] + count[i]], int(low[i]), int(high[i]), int(shift[i]), coefs)
    at = np.flatnonzero(whole)
    if not len(at):
        return
    size = count[at]
    lane = np.repeat(np.arange(len(at)), size)
    begin = np.cumsum(size) - size
    base = order[first[at][lane] + np.arange(len(lane)) - begin[lane]]
    cells = (base[:, None] + np.arange(1, 64)).ravel()
    c = coefs[cells]
    full = np.flatnonzero(c)
    per = np.count_nonzero(c.reshape(-1, 63), axis=1)
    before = np.cumsum(per) - per
    offset = np.arange(len(full)) - np.repeat(before[begin], np.add.reduceat(per, begin))
    q = np.repeat((p + n + r)[at], np.add.reduceat(per, begin)) + offset
    bit = (bits.raw[q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1
    one = np.repeat(1 << shift[at], np.add.reduceat(per, begin))
    c = c[full]
    add = bit.astype(bool) & (np.abs(c) & one == 0)
    coefs[cells[full]] = c + np.where(add, np.sign(c) * one, 0)


def dc_scan(bits: Bits, table, first, units, order, shift, refine: bool, coefs: np.ndarray, luts: np.ndarray, part: np.ndarray) -> None:
    """units: coded blocks of each lane; part: component of each place in an MCU (a period, alike for all lanes)."""
    period = len(part)
    if refine:
        lane = np.repeat(np.arange(len(units)), units)
        j = np.arange(len(lane)) - np.repeat(np.cumsum(units) - units, units)
        q = bits.starts[lane] + j
        bit = (bits.raw[q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1
        coefs[order[first[lane] + j]] |= (bit.astype(np.int64) << shift[lane]).astype(np.int32)
        return
    p, live, j = bits.starts.copy(), np.arange(len(units)), 0
    before = np.zeros((3, len(units)), np.int64)
    while len(live):
        c = part[j % period]
        w = bits.at(p[live])
        e = luts[table[live, c], (w >> U(48)).astype(np.int64)]
        n, s = (e >> 8).astype(np.int64), (e & 255).astype(np.int64)
        if not n.all():
            raise ValueError("bad Huffman code")
        x = (((w << n.astype(np.uint64)) >> U(1)) >> (63 - s).astype(np.uint64)).astype(np.int64)
        before[c, live] += np.where(s == 0, 0, np.where(x >> np.maximum(s - 1, 0), x, x - (1 << s) + 1))
        coefs[order[first[live] + j]] = before[c, live] << shift[live]
        p[live] += n + s
        j += 1
        live = live[units[live] > j]


def accumulate(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """All coefficients (zigzag order, components of an image one after another); the block at which each image begins."""
    sizes = [sum(c * r for c, r, _, _ in map(im.grid, range(len(im.sampling)))) for im in images]
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coefs = np.zeros(int(start[-1]) * 64, np.int32)
    done = [0] * len(images)
    while True:
        # the next scan of every image, those of a kind together
        groups: dict[tuple, list[tuple[int, Scan]]] = {}
        for i, im in enumerate(images):
            if done[i] < len(im.scans):
                s = im.scans[done[i]]
                done[i] += 1
                kind = ("dc" if s.low == 0 else "ac", s.past > 0, len(s.parts), tuple(im.sampling))
                groups.setdefault(kind, []).append((i, s))
        if not groups:
            return coefs.reshape(-1, 64), start
        for (kind, refine, parts, sampling), members in groups.items():
            tables: dict[bytes, int] = {}
            orders, at = [], 0
            rows: list[tuple] = []
            blobs: list[bytes] = []
            for i, s in members:
                im = images[i]
                order = scan_order(im, s) + int(start[i])
                unit = 1 if parts == 1 else sum(im.sampling[c][0] * im.sampling[c][1] for c in s.parts)
                total = len(order) // unit
                every = s.every or total
                if kind == "dc":
                    used = [0, 0, 0]
                    for c, t in zip(s.parts, s.dc):
                        used[c] = tables.setdefault(t, len(tables)) if not refine else 0
                else:
                    used = tables.setdefault(s.ac, len(tables))
                if len(s.intervals) != -(-total // every):
                    raise ValueError("restart intervals are missing")
                for k, blob in enumerate(s.intervals):
                    n = min(every, total - k * every) * unit
                    rows.append((used, at + k * every * unit, n, s.low, s.high, s.shift))
                    blobs.append(blob)
                orders.append(order)
                at += len(order)
            bits = Bits(blobs)
            order = np.concatenate(orders) * 64
            luts = np.stack([lut(t) for t in tables]) if tables else np.zeros((1, 1 << 16), np.int32)
            table, first, count, low, high, shift = (np.array(x, np.int64) for x in zip(*rows))
            if kind == "dc":
                s = members[0][1]
                part = np.array(s.parts if parts == 1 else [c for c in s.parts for _ in range(sampling[c][0] * sampling[c][1])])
                dc_scan(bits, table, first, count, order, shift, refine, coefs, luts, part)
            elif refine:
                ac_refine(bits, (table, first, count, low, high, shift, order), coefs, luts)
            else:
                ac_first(bits, (table, first, count, low, high, shift, order), coefs, luts)


def scan_order(im: Image, s: Scan) -> np.ndarray:
    """The blocks of a scan in coding order."""
    begin, at = [], 0
    for k in range(len(im.sampling)):
        c, r, _, _ = im.grid(k)
        begin.append(at)
        at += c * r
    if len(s.parts) == 1:
        c, _, oc, orr = im.grid(s.parts[0])
        return (begin[s.parts[0]] + np.arange(orr)[:, None] * c + np.arange(oc)).ravel()
    if im.sampling[0] == (2, 2):
        c, r, _, _ = im.grid(1)
        return interleaved(c, r)
    c, r, _, _ = im.grid(0)
    return (np.arange(c * r)[:, None] + np.arange(3) * (c * r)).ravel()


def samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """Samples (0 to 255) of all blocks. Fixed-point sums stay whole in the float type chosen, so no batch changes them."""
    if any((q != 1).any() for im in images for q in im.quant):
        coefs, at = coefs.copy(), 0
        for im in images:
            for k, q in enumerate(im.quant):
                c, r, _, _ = im.grid(k)
                coefs[at : at + c * r] *= q
                at += c * r
    kind = np.float32 if len(coefs) and np.abs(coefs).max() <= 511 else np.float64
    x = coefs.astype(kind) @ BASIS.astype(kind)
    x += 1 << (SCALE - 1)
    x *= 1 / (1 << SCALE)
    np.floor(x, out=x)
    x += 128
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def planes(im: Image, x: np.ndarray) -> list[np.ndarray]:
    """Red, green and blue at full resolution, from an image's blocks of samples."""
    made, at = [], 0
    for k in range(len(im.sampling)):
        c, r, _, _ = im.grid(k)
        made.append(x[at : at + c * r].reshape(r, c, 8, 8).swapaxes(1, 2).reshape(r * 8, c * 8))
        at += c * r
    if len(made) == 1:
        return [made[0][: im.height, : im.width]] * 3
    y = made[0].astype(np.int16)
    cb, cr = made[1].astype(np.int32) - 128, made[2].astype(np.int32) - 128
    out = []
    for add in (91881 * cr + 32768 >> 16, -(22554 * cb + 46802 * cr + 32768 >> 16), 116130 * cb + 32768 >> 16):
        add = add.astype(np.int16)
        if im.sampling[0] == (2, 2):
            add = add.repeat(2, 0).repeat(2, 1)
        add += y
        out.append(np.clip(add, 0, 255, out=add).astype(np.uint8)[: im.height, : im.width])
    return out


def tensor(im: Image, x: np.ndarray) -> np.ndarray:
    """height x width x 3 samples of 8 bits."""
    return np.stack(planes(im, x), 2)


def read(media: list[bytes]) -> list[tuple[Image, np.ndarray, np.ndarray]]:
    """Images with their coefficients and samples, one block a row."""
    images = [parse(m) for m in media]
    coefs, start = accumulate(images)
    x = samples(images, coefs)
    return [(im, coefs[a:b], x[a:b]) for im, a, b in zip(images, start, start[1:])]


def payload(im: Image, coefs: np.ndarray) -> bytes:
    m = re.fullmatch(rb"bytes=(\d+)", im.note)
    if not m:
        raise ValueError("the image holds no payload")
    rank = 2 * np.abs(coefs) - 4 + (coefs < 0)
    rank[:, 0] = coefs[:, 0]
    return ORDER[rank].tobytes()[: int(m[1])]


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // PAD)) * PAD
    return data.ljust(n, b" ")


def store(df: DataFrame, text: str = "text", keep: list[str] | None = None, budget: int = 3_000_000) -> DataFrame:
    """The rows with ``n_bytes long`` and ``media binary``, a progressive JPEG."""

    def factory():
        def work(texts):
            raw = [b.encode() if isinstance(b, str) else b or b"" for b in texts.to_pylist()]
            return [pa.array([len(b) for b in raw], pa.int64()), pa.array(write([padded(b) for b in raw]), pa.binary())]

        return work

    return arrow_map(df, [text], "n_bytes long, media binary", factory, keep, budget)


def tensors(df: DataFrame, media: str = "media", keep: list[str] | None = None, budget: int = 1_000_000) -> DataFrame:
    """The rows with ``height int, width int, rgb binary`` (null for null media)."""
    kept = df.columns if keep is None else keep
    return facts(df, media, kept, True, budget).select(*[col(c) for c in kept if c not in ("height", "width", "rgb")], "height", "width", "rgb")


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSOR = ", height int, width int, rgb binary"


def facts(df: DataFrame, media: str = "media", keep: list[str] | None = None, tensor: bool = False, budget: int = 1_000_000) -> DataFrame:
    """What the stored bytes say when read back: the payload's and the image's digests, and features of the RGB tensor.

    With ``tensor``, the full-resolution tensor too: ``height``, ``width`` and ``rgb`` (height x width x 3 bytes).
    Null media give nulls.
    """
    fields = [f.split()[1] for f in (FACTS + TENSOR * tensor).split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[k] for k in fields]

    def one(m: bytes, im: Image, c: np.ndarray, x: np.ndarray) -> list:
        p, rgb = payload(im, c), np.stack(planes(im, x), 2)
        mean = ",".join(str(int(z) * 1000 // (im.width * im.height)) for z in rgb.reshape(-1, 3).sum(0, dtype=np.int64))
        feature = f"rgb8:{im.width}x{im.height}:mean={mean}:crc={zlib.crc32(rgb)}"
        out = [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature]
        return out + [im.height, im.width, rgb.tobytes()] if tensor else out

    def factory():
        def work(rows):
            data = rows.to_pylist()
            there = [m for m in data if m is not None]
            made = iter([one(m, *r) for m, r in zip(there, read(there))] if there else [])
            out = [next(made) if m is not None else [None] * len(kinds) for m in data]
            return [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]

        return work

    return arrow_map(df, [media], FACTS + TENSOR * tensor, factory, keep, budget)
