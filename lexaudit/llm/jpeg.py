"""Progressive JPEG in numpy: coefficient arrays, entropy coding and decoding, RGB tensors.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them, upsamples chroma and returns full-resolution RGB. Entropy
decoding is sequential within a restart interval only, so all intervals of all images of a batch
advance together, one symbol each per numpy step. Refinement scans read correction bits after
the fact: a step records where the bits of its span begin, and all bits are fetched at once.

The encoder writes non-interleaved scans of any number of components: DC with one bit held back,
AC bands 1-5 and 6-63 with one bit held back, then the refinements, with a restart interval of
``RESTART`` blocks. Coefficients come back as they went in, so they carry any signed bytes.

Coefficients are kept in zigzag order as int16 arrays of (blocks, 64).
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

RESTART = 8
_PAD = 16
_RESTARTS = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
_AT_RESTART, _AT_END = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural (row-major) place of each zigzag place."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()

#: Symbols of the encoder's own tables: eleven usual ones get four bits, all others twelve.
_AC_SHORT = [0x00, *range(0x01, 0x09), 0x11, 0xF0]
_AC_LONG = [s for s in [(r << 4) | n for r in range(16) for n in range(11)] if s not in _AC_SHORT]
_DC_SHORT = list(range(12))


def _codes(short: list[int], long: list[int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table's segment body (counts by length, symbols)."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for i, s in enumerate(short):
        code[s], length[s] = i, 4
    for i, s in enumerate(long):
        code[s], length[s] = (len(short) << 8) + i, 12
    counts = bytearray(16)
    counts[3], counts[11] = len(short), len(long)
    return code, length, bytes(counts) + bytes(short + long)


AC_CODE, AC_LENGTH, AC_TABLE = _codes(_AC_SHORT, _AC_LONG)
DC_CODE, DC_LENGTH, DC_TABLE = _codes(_DC_SHORT, [])

#: (Ss, Se, Ah, Al) of the encoder's scans.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


def _bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float32))[1].astype(np.int64)


def _write(value: np.ndarray, length: np.ndarray, seg: np.ndarray, n_segs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack codes in order; each segment starts at a byte and is padded with ones.

    Returns the bytes and where each segment starts (one more entry than segments)."""
    bits = np.bincount(seg, length, n_segs).astype(np.int64)
    size = (bits + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(size)])
    total = np.cumsum(length)
    before = np.concatenate([[0], np.cumsum(bits)])
    at = total - length - before[seg] + 8 * starts[seg]
    # codes don't overlap, so those of one 64-bit word add up; one at most goes on in the next word
    word, room = at >> 6, 64 - (at & 63) - length
    code = value.astype(np.uint64)
    over = np.flatnonzero(room < 0)
    high = code << np.maximum(room, 0).astype(np.uint64)
    high[over] = code[over] >> (-room[over]).astype(np.uint64)
    out = np.zeros((int(starts[-1]) >> 3) + 2, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[heads]] = np.add.reduceat(high, heads)
    out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)
    short = np.flatnonzero(size * 8 > bits)
    data[starts[short + 1] - 1] |= ((1 << (size[short] * 8 - bits[short])) - 1).astype(np.uint8)
    return data[: int(starts[-1])], starts


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _dc_first(c: np.ndarray, seg: np.ndarray, n_segs: int, al: int):
    v = c[:, 0].astype(np.int64) >> al
    first = np.concatenate([[True], seg[1:] != seg[:-1]])
    diff = v - np.where(first, 0, np.concatenate([[0], v[:-1]]))
    size = _bit_size(np.abs(diff))
    return _write((DC_CODE[size] << size) | _extra(diff, size), DC_LENGTH[size] + size, seg, n_segs)


def _dc_refine(c: np.ndarray, seg: np.ndarray, n_segs: int, al: int):
    return _write((c[:, 0].astype(np.int64) >> al) & 1, np.ones(len(c), np.int64), seg, n_segs)


def _ac_first(c: np.ndarray, seg: np.ndarray, n_segs: int, ss: int, se: int, al: int):
    band = c[:, ss : se + 1].astype(np.int32)
    v = np.sign(band) * (np.abs(band) >> al)
    block, k = np.nonzero(v)
    v = v[block, k].astype(np.int64)
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = k - 1 - np.where(first, -1, np.concatenate([[0], k[:-1]])) if len(block) else k
    size = _bit_size(np.abs(v))
    symbol = ((run & 15) << 4) | size
    value = (AC_CODE[symbol] << size) | _extra(v, size)
    length = AC_LENGTH[symbol] + size
    far = np.flatnonzero(run > 15)
    if len(far):  # at most three runs of sixteen before a coefficient
        z = run[far] >> 4
        code, n = int(AC_CODE[0xF0]), int(AC_LENGTH[0xF0])
        lead = np.zeros(len(far), np.int64)
        for i in range(int(z.max())):
            lead = np.where(i < z, (lead << n) | code, lead)
        # lead, code and extra bits stay within 32 bits: the encoder's coefficients are signed bytes
        value[far] |= lead << length[far]
        length[far] += n * z
    last = np.full(len(c), -1)
    last[block] = k
    ends = np.flatnonzero(last < se - ss)
    order = np.argsort(np.concatenate([block * 64 + k, ends * 64 + 63]), kind="stable")
    value = np.concatenate([value, np.full(len(ends), AC_CODE[0])])[order]
    length = np.concatenate([length, np.full(len(ends), AC_LENGTH[0])])[order]
    return _write(value, length, seg[np.concatenate([block, ends])[order]], n_segs)


def _ac_refine(c: np.ndarray, seg: np.ndarray, n_segs: int, ss: int, se: int, al: int):
    band = np.abs(c[:, ss : se + 1].astype(np.int32)) >> al
    nb, width = band.shape
    known, fresh, zero = band > 1, band == 1, band == 0
    # a slot before each place holds the symbol of the span that starts there, the place's own slot its correction bit
    lens = np.zeros((nb, width + 1, 2), np.int64)
    vals = np.zeros((nb, width + 1, 2), np.int64)
    lens[:, :width, 1] = known
    vals[:, :width, 1] = band & 1
    start = np.zeros(nb, np.int64)
    if fresh.any():
        zeros = np.cumsum(zero, 1)
        block, k = np.nonzero(fresh)
        first = np.concatenate([[True], block[1:] != block[:-1]])
        begin = np.where(first, 0, np.concatenate([[0], k[:-1]]) + 1)
        skipped = np.where(begin > 0, zeros[block, np.maximum(begin - 1, 0)], 0)
        run = zeros[block, k] - skipped
        for i in np.flatnonzero(run > 15):  # rare: a span for each sixteen zeros
            places = np.flatnonzero(zero[block[i]])
            places = places[places >= begin[i]]
            while run[i] > 15:
                vals[block[i], begin[i], 0], lens[block[i], begin[i], 0] = AC_CODE[0xF0], AC_LENGTH[0xF0]
                begin[i] = places[15] + 1
                places = places[16:]
                run[i] -= 16
        symbol = (run << 4) | 1
        sign = c[block, k + ss] > 0
        vals[block, begin, 0] = (AC_CODE[symbol] << 1) | sign
        lens[block, begin, 0] = AC_LENGTH[symbol] + 1
        np.maximum.at(start, block, k + 1)
    open_ = np.flatnonzero(start < width)
    vals[open_, start[open_], 0], lens[open_, start[open_], 0] = AC_CODE[0], AC_LENGTH[0]
    flat = lens.reshape(nb, -1)
    used = np.flatnonzero(flat.ravel())
    return _write(vals.ravel()[used], flat.ravel()[used], seg[used // flat.shape[1]], n_segs)


def _scan_bytes(c: np.ndarray, seg: np.ndarray, n_segs: int, ss: int, se: int, ah: int, al: int):
    if se == 0:
        return (_dc_refine if ah else _dc_first)(c, seg, n_segs, al)
    return _ac_refine(c, seg, n_segs, ss, se, al) if ah else _ac_first(c, seg, n_segs, ss, se, al)


def encode_segments(c: np.ndarray, seg: np.ndarray, n_segs: int) -> list[list[bytes]]:
    """For each scan of the script, the stuffed bytes of each segment. seg: a block's segment, ascending."""
    out = []
    for scan in SCRIPT:
        data, starts = _scan_bytes(c, seg, n_segs, *scan)
        raw = data.tobytes()
        out.append([raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
    return out


@dataclass
class Component:
    """A component's coefficients: (rows of blocks * blocks a row, 64), and its sampling factors."""

    blocks: np.ndarray
    h: int = 1
    v: int = 1


@functools.lru_cache(256)
def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def assemble(width: int, height: int, factors: list[tuple[int, int]], scans: list[list[list[bytes]]], comment: bytes = b"", quant: np.ndarray | None = None) -> bytes:
    """A JPEG file of each component's scans (by component, scan, segment)."""
    quant = np.ones(64, np.uint8) if quant is None else quant
    parts = [b"\xff\xd8"]
    if comment:
        parts.append(_segment(0xFE, comment))
    parts.append(_segment(0xDB, b"\x00" + bytes(quant.tolist())))
    sof = struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    parts += [_segment(0xC2, sof), _segment(0xC4, b"\x00" + DC_TABLE), _segment(0xC4, b"\x10" + AC_TABLE), _segment(0xDD, struct.pack(">H", RESTART))]
    for k, (ss, se, ah, al) in enumerate(SCRIPT):
        for i, by_scan in enumerate(scans):
            parts.append(_segment(0xDA, bytes([1, i + 1, 0, ss, se, ah << 4 | al])))
            for n, data in enumerate(by_scan[k]):
                if n:
                    parts.append(_RESTARTS[(n - 1) % 8])
                parts.append(data)
    parts.append(b"\xff\xd9")
    return b"".join(parts)


def encode(width: int, height: int, components: list[Component], comment: bytes = b"", quant: np.ndarray | None = None) -> bytes:
    scans = []
    for comp in components:
        seg = np.arange(len(comp.blocks)) // RESTART
        scans.append(encode_segments(comp.blocks, seg, int(seg[-1]) + 1))
    return assemble(width, height, [(c.h, c.v) for c in components], scans, comment, quant)


# ---------------------------------------------------------------- decoding


@dataclass
class _Scan:
    comps: list[int]
    dc: list[bytes]
    ac: bytes | None
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    parts: list[bytes] = field(default_factory=list)


@functools.lru_cache(4096)
def _grid(height: int, width: int, factors: tuple[tuple[int, int], ...], i: int) -> tuple[int, int]:
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    h, v = factors[i]
    return -(-height // (8 * vm)) * v, -(-width // (8 * hm)) * h


@dataclass
class Image:
    width: int = 0
    height: int = 0
    factors: list[tuple[int, int]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    quant_of: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[_Scan] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)

    def grid(self, i: int) -> tuple[int, int]:
        """Rows and columns of a component's blocks, padded to whole units."""
        return _grid(self.height, self.width, tuple(self.factors), i)

    def real(self, i: int) -> tuple[int, int]:
        """Rows and columns of blocks that a scan of this component alone holds."""
        hm, vm = max(h for h, _ in self.factors), max(v for _, v in self.factors)
        h, v = self.factors[i]
        return -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)


def _split(data: bytes) -> list[bytes]:
    """Restart intervals of entropy-coded data, unstuffed."""
    return [p.replace(b"\xff\x00", b"\xff") for p in _AT_RESTART.split(data)]


@functools.lru_cache(1024)
def _scan_head(body: bytes, ids: tuple[int, ...]) -> tuple[list[int], list[int], int, int, int]:
    k = body[0]
    comps = [ids.index(body[1 + 2 * j]) for j in range(k)]
    which = [body[2 + 2 * j] for j in range(k)]
    ss, se, a = body[1 + 2 * k : 4 + 2 * k]
    return comps, which, ss, se, a


def parse(data: bytes) -> Image:
    """Markers of a progressive (or baseline-free) JPEG; entropy-coded data stay as they are."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    im, at, restart = Image(), 2, 0
    tables: dict[int, bytes] = {}
    while at < len(data):
        mark = data[at + 1]
        if mark == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xFE:
            im.comment = body
        elif mark == 0xDB:
            while body:
                wide, i = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                im.quant[i] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + size :]
        elif mark == 0xC2:
            _, im.height, im.width, k = struct.unpack_from(">BHHB", body)
            for j in range(k):
                i, f, q = body[6 + 3 * j : 9 + 3 * j]
                im.ids.append(i)
                im.factors.append((f >> 4, f & 15))
                im.quant_of.append(q)
        elif mark in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"frame type {mark:02X} isn't progressive Huffman")
        elif mark == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + count]
                body = body[17 + count :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            comps, which, ss, se, a = _scan_head(body, tuple(im.ids))
            found = _AT_END.search(data, at)
            if found is None:
                raise ValueError("entropy-coded data without an end")
            end = found.start()
            dc = [tables.get(w >> 4, b"") for w in which]
            im.scans.append(_Scan(comps, dc, tables.get(0x10 | which[0] & 15) if se else None, ss, se, a >> 4, a & 15, restart, [data[at:end]]))
            at = end
    return im


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For all 16-bit prefixes: length | symbol << 8."""
    if table not in _LOOKUPS:
        out, code, at = np.zeros(65536, np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                lo = code << (16 - n)
                out[lo : lo + (1 << (16 - n))] = n | table[at] << 8
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


class _Bits:
    """Bits of many intervals: a 64-bit window at every byte."""

    def __init__(self, parts: list[bytes]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts) + b"\xff" * _PAD, np.uint8).astype(np.uint64)
        n = len(raw) - 8
        self.window = np.zeros(n, np.uint64)
        for j in range(8):
            self.window |= raw[j : j + n] << np.uint64(56 - 8 * j)
        self.start = 8 * (np.cumsum(sizes) - sizes)

    def at(self, pos: np.ndarray) -> np.ndarray:
        """57 bits or more, left-aligned."""
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7).astype(np.uint64)


def _top(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits (0 to 16) as a number."""
    return ((bits >> np.uint64(32)).astype(np.int64)) >> (32 - n)


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


def _run_dc(bits: _Bits, tables: list[bytes], rows: np.ndarray, slot: np.ndarray, lane: np.ndarray, count: np.ndarray, out: np.ndarray, ah: int, al: int) -> None:
    if ah:
        i = np.arange(len(rows)) - lane[np.repeat(np.arange(len(lane)), count)]
        pos = np.repeat(bits.start, count) + i
        bit = (bits.at(pos) >> np.uint64(63)).astype(out.dtype)
        out[rows, 0] |= bit << al
        return
    look = np.concatenate([_lookup(t) for t in tables])
    pos, pred = bits.start.copy(), np.zeros((len(lane), len(tables)), np.int64)
    live = np.flatnonzero(count > 0)
    step = 0
    while len(live):
        b = lane[live] + step
        s = slot[b]
        w = bits.at(pos[live])
        got = look[(w >> np.uint64(48)).astype(np.int64) + 65536 * s]
        n, size = got & 255, got >> 8
        diff = _signed(_top(w << n.astype(np.uint64), size), size)
        pred[live, s] += np.where(size > 0, diff, 0)
        pos[live] += n + size
        out[rows[b], 0] = pred[live, s] << al
        step += 1
        live = live[count[live] > step]


def _run_ac_first(bits: _Bits, table: bytes, rows: np.ndarray, lane: np.ndarray, count: np.ndarray, out: np.ndarray, ss: int, se: int, al: int) -> None:
    look = _lookup(table)
    flat = out.reshape(-1)
    live = np.flatnonzero(count > 0)
    pos, b, end = bits.start[live], lane[live], (lane + count)[live]
    k = np.full(len(live), ss, np.int64)
    row = rows[b] * 64
    while len(pos):
        w = bits.at(pos)
        got = look[(w >> np.uint64(48)).astype(np.int64)]
        n, run, size = got & 255, got >> 12, (got >> 8) & 15
        k += run
        w <<= n.astype(np.uint64)
        v = _top(w, size)
        has = size > 0
        # a symbol without a size writes to the place it skips to; what it writes is what is there
        value = np.where(v < (1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v) << al
        if has.all():
            flat[row + k] = value
            pos += n + size
            k += 1
            done = k > se
        else:
            h = np.flatnonzero(has)
            flat[row[h] + k[h]] = value[h]
            eob = ~has & (run < 15)
            extra = np.where(eob, run, size)
            pos += n + extra
            k += 1
            done = eob | (k > se)
            e = np.flatnonzero(eob & (run > 0))
            if len(e):  # a run of blocks without further coefficients
                b[e] += (1 << run[e]) + _top(w[e], run[e]) - 1
        d = np.flatnonzero(done)
        if len(d):
            b[d] += 1
            k[d] = ss
            alive = b < end
            if not alive.all():
                pos, b, end, k, row = pos[alive], b[alive], end[alive], k[alive], row[alive]
            row = rows[b] * 64


def _run_ac_refine(bits: _Bits, table: bytes, rows: np.ndarray, lane: np.ndarray, count: np.ndarray, out: np.ndarray, ss: int, se: int, al: int) -> None:
    look = _lookup(table)
    band = out[rows, ss : se + 1]
    nb, width = band.shape
    known = band != 0
    zeros_before = np.zeros((nb, width + 1), np.int64)
    np.cumsum(~known, 1, out=zeros_before[:, 1:])
    n_zero = zeros_before[:, width]
    place = np.full((nb, width + 17), width, np.int64)  # place of the i-th zero, width beyond the last
    zb, zk = np.nonzero(~known)
    place[zb, zeros_before[zb, zk]] = zk
    # where the correction bit of a known coefficient is: base of its span + its rank among known ones
    base = np.zeros((nb, width), np.int64)
    fresh_b, fresh_k, fresh_v = [], [], []
    live = np.flatnonzero(count > 0)
    pos, b, end = bits.start[live], lane[live], (lane + count)[live]
    k, eob_run = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    spans = []
    while len(pos):
        reading = eob_run == 0
        w = bits.at(pos)
        got = look[(w >> np.uint64(48)).astype(np.int64)]
        n, run, size = np.where(reading, got & 255, 0), got >> 12, (got >> 8) & 15
        eob = reading & (size == 0) & (run < 15)
        w <<= n.astype(np.uint64)
        take = np.where(eob, run, np.where(reading, size, 0))
        extra = _top(w, take)
        pos += n + take
        eob_run = np.where(eob, (1 << np.where(eob, run, 0)) + extra, eob_run)
        ending = eob_run > 0
        seen = zeros_before[b, k]
        target = np.where(ending, width, place[b, np.minimum(seen + run, width + 16)])
        known_in = (target - k) - (zeros_before[b, target] - seen)
        spans.append((b.copy(), k.copy(), target, pos.copy()))
        pos += known_in
        f = np.flatnonzero(~ending & (size > 0) & (target < width))
        if len(f):
            fresh_b.append(b[f])
            fresh_k.append(target[f])
            fresh_v.append(np.where(extra[f] > 0, 1, -1) << al)
        k = target + 1
        eob_run = np.where(ending, eob_run - 1, eob_run)
        done = ending | (k >= width)
        b = b + done
        k = np.where(done, 0, k)
        alive = b < end
        if not alive.all():
            pos, b, end, k, eob_run = pos[alive], b[alive], end[alive], k[alive], eob_run[alive]
    sb, sk, st, sp = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(sb * 64 + sk, kind="stable")
    sb, sk, st, sp = sb[order], sk[order], st[order], sp[order]
    lengths = np.minimum(st + 1, width) - sk
    base.reshape(-1)[np.repeat(sb * width + sk - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = np.repeat(
        sp - (sk - zeros_before[sb, sk]), lengths
    )
    kb, kk = np.nonzero(known)
    at = base[kb, kk] + kk - zeros_before[kb, kk]
    bit = (bits.at(at) >> np.uint64(63)).astype(np.int64)
    old = band[kb, kk].astype(np.int64)
    plus = bit * np.where(np.abs(old) & (1 << al), 0, 1 << al)
    band[kb, kk] = old + np.sign(old) * plus
    if fresh_b:
        band[np.concatenate(fresh_b), np.concatenate(fresh_k)] = np.concatenate(fresh_v)
    out[rows, ss : se + 1] = band


def decode_coefficients(files: list[bytes], max_blocks: int = 1 << 15) -> list[Image]:
    """Parsed images with their coefficients, all scans accumulated.

    Images are taken together up to ``max_blocks`` blocks; a larger image goes alone."""
    images = [parse(f) for f in files]
    group: list[Image] = []
    blocks = 0
    for im in images:
        n = sum(r * c for r, c in (im.grid(i) for i in range(len(im.factors))))
        if group and blocks + n > max_blocks:
            _accumulate(group)
            group, blocks = [], 0
        group.append(im)
        blocks += n
    if group:
        _accumulate(group)
    return images


def _waves(scans: list[_Scan]) -> list[list[_Scan]]:
    """Scans that follow each other and have no component in common can be decoded together."""
    out: list[list[_Scan]] = []
    taken: set[int] = set()
    for s in scans:
        if out and taken.isdisjoint(s.comps):
            out[-1].append(s)
            taken.update(s.comps)
        else:
            out.append([s])
            taken = set(s.comps)
    return out


def _lanes(n: int, step: int) -> list[int]:
    """Blocks of each restart interval."""
    return [step] * (n // step) + ([n % step] if n % step else [])


def _accumulate(images: list[Image]) -> None:
    first: dict[tuple[int, int], int] = {}
    total = 0
    for a, im in enumerate(images):
        for i in range(len(im.factors)):
            first[a, i] = total
            r, c = im.grid(i)
            total += r * c
    out = np.zeros((total, 64), np.int16)
    own_rows: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, list[int]]] = {}  # of the scans of one component
    waves = [_waves(im.scans) for im in images]
    for turn in range(max(map(len, waves))):
        alike: dict[tuple, list[tuple[int, _Scan]]] = {}
        for a, wave in enumerate(waves):
            for s in wave[turn] if turn < len(wave) else ():
                alike.setdefault((s.ss, s.se, s.ah, s.al, tuple(s.dc) if not s.se else (), s.ac), []).append((a, s))
        for (ss, se, ah, al, dc, ac), members in alike.items():
            parts: list[bytes] = []
            rows, slots, counts = [], [], []
            for a, s in members:
                im = images[a]
                if len(s.comps) == 1:
                    i = s.comps[0]
                    known = own_rows.get((a, i, s.restart))
                    if known is None:
                        (_, gc), (rr, rc) = im.grid(i), im.real(i)
                        row = first[a, i] + (np.arange(rr)[:, None] * gc + np.arange(rc)).ravel()
                        known = own_rows[a, i, s.restart] = row, np.zeros(len(row), np.int64), _lanes(len(row), s.restart or len(row))
                    row, slot, lanes = known
                else:  # interleaved: unit by unit, each component's blocks in turn
                    cols, own = [], []
                    for j, i in enumerate(s.comps):
                        gr, gc = im.grid(i)
                        h, v = im.factors[i]
                        g = np.arange(gr * gc).reshape(gr // v, v, gc // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h)
                        cols.append(first[a, i] + g)
                        own += [j] * (v * h)
                    grid = np.concatenate(cols, 1)
                    row, slot = grid.ravel(), np.tile(own, len(grid))
                    lanes = _lanes(len(row), (s.restart or len(row)) * len(own))
                found = _split(s.parts[0])
                if len(found) != len(lanes):
                    raise ValueError(f"{len(lanes)} restart intervals are due, {len(found)} are there")
                parts += found
                rows.append(row)
                slots.append(slot)
                counts += lanes
            count = np.asarray(counts, np.int64)
            lane = np.cumsum(count) - count
            bits, row = _Bits(parts), np.concatenate(rows)
            if se == 0:
                _run_dc(bits, list(dc), row, np.concatenate(slots), lane, count, out, ah, al)
            elif ah:
                _run_ac_refine(bits, ac, row, lane, count, out, ss, se, al)
            else:
                _run_ac_first(bits, ac, row, lane, count, out, ss, se, al)
    for a, im in enumerate(images):
        for i in range(len(im.factors)):
            r, c = im.grid(i)
            im.coefficients.append(out[first[a, i] : first[a, i] + r * c])


def _dct_matrix() -> np.ndarray:
    """Pixels from natural-order coefficients, as a 64 x 64 matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(one, one)


_INVERSE = _dct_matrix()


#: The same for coefficients in zigzag order.
_FROM_ZIGZAG = np.ascontiguousarray(_INVERSE.T[ZIGZAG])


def _samples(blocks: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of dequantised blocks, 64 a block."""
    pixels = blocks.astype(np.float64) @ _FROM_ZIGZAG
    pixels += 128.5 + 1e-6
    np.maximum(pixels, 0, out=pixels)
    np.minimum(pixels, 255, out=pixels)
    return pixels.astype(np.uint8)


def _plane(samples: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def plane(blocks: np.ndarray, rows: int, cols: int, quant: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of a component from its zigzag coefficients."""
    return _plane(_samples(blocks * quant), rows, cols)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5 + 1e-6).astype(np.int16)


_LEVELS = np.arange(256, dtype=np.float64) - 128
#: What Cr adds to red, Cb (times 256) and Cr to green, and Cb to blue. Luma is whole, so it is rounded by itself.
_RED, _BLUE = _rounded(1.402 * _LEVELS), _rounded(1.772 * _LEVELS)
_GREEN = _rounded(-0.344136 * _LEVELS[:, None] - 0.714136 * _LEVELS).ravel()


def tensors(images: list[Image], together: int = 1 << 12) -> list[np.ndarray]:
    """Each image's full-resolution RGB tensor (height, width, 3). Blocks of images are transformed ``together``."""
    out: list[np.ndarray] = []
    group: list[Image] = []
    n = 0
    for im in images:
        group.append(im)
        n += sum(map(len, im.coefficients))
        if n >= together:
            out += _tensors(group)
            group, n = [], 0
    return out + (_tensors(group) if group else [])


def _tensors(images: list[Image]) -> list[np.ndarray]:
    blocks = []
    for im in images:
        for i, c in enumerate(im.coefficients):
            quant = im.quant[im.quant_of[i]]
            blocks.append(c if (quant == 1).all() else c * quant)
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    samples = np.split(_samples(np.concatenate(blocks)), np.cumsum(sizes)[:-1])
    out, at = [], 0
    for im in images:
        k = len(im.factors)
        out.append(_coloured(im, [_plane(p, *im.grid(i)) for i, p in enumerate(samples[at : at + k])]))
        at += k
    return out


def _coloured(im: Image, planes: list[np.ndarray]) -> np.ndarray:
    """The RGB tensor of an image's planes, chroma upsampled."""
    hm, vm = max(h for h, _ in im.factors), max(v for _, v in im.factors)

    def upsampled(p: np.ndarray, i: int) -> np.ndarray:
        h, v = im.factors[i]
        return np.repeat(np.repeat(p, vm // v, 0), hm // h, 1)

    y = upsampled(planes[0], 0) if im.factors[0] != (hm, vm) else planes[0]
    if len(planes) == 1:
        return np.stack([y[: im.height, : im.width]] * 3, -1)
    cb, cr = planes[1:3]
    if im.factors[1] != im.factors[2]:
        cb, cr = upsampled(cb, 1), upsampled(cr, 2)
    rows, cols = cb.shape
    luma = y.reshape(rows, len(y) // rows, cols, y.shape[1] // cols)
    out = np.empty((*luma.shape, 3), np.uint8)
    for k, more in enumerate((_RED[cr], _GREEN[cb.astype(np.int32) * 256 + cr], _BLUE[cb])):
        level = luma + more[:, None, :, None]
        np.maximum(level, 0, out=level)
        np.minimum(level, 255, out=level)
        out[..., k] = level
    return out.reshape(*y.shape, 3)[: im.height, : im.width]


def rgb(im: Image) -> np.ndarray:
    """The image's full-resolution RGB tensor (height, width, 3)."""
    return _tensors([im])[0]
