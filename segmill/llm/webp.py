"""Lossless WebP (VP8L, RFC 9649): a decoder for pixel columns, and payload columns stored as such images.

The decoder reads prefix codes through tables, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. All streams go the same way, a window of bits at a time, so memory
beyond the pixels is bounded.

Payloads are stored as RGB samples, 192 pixels (576 bytes) to a row and at most ``MOST_ROWS`` rows to a
file; longer payloads are several files, one behind the other. ``webp_write`` encodes them.

Defined results: a null text is an empty one, and a payload has at least one row; very long texts take several files; media that
aren't lossless WebP raise ValueError in ``decode``; repeated rows give a row each, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import utf8_column
from .webp_write import CACHE_HASH, CROSS_COLOR, LENGTH_ORDER, NEIGHBOURS, PALETTE, PREDICTOR, SUBTRACT_GREEN, _reversal, encode_many

ROW = 576
MOST_ROWS = 4096
#: Bytes of a window, and bits that one symbol with all that belongs to it can take.
WINDOW, SYMBOL = 1 << 16, 80


class Bits:
    """Reads little-endian bits; ``window`` has the number that begins at every bit of a stretch."""

    def __init__(self, data: bytes):
        self.data, self.at, self.base, self.stop, self.view = data, 0, 0, 0, None

    def read(self, n: int) -> int:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        x = int.from_bytes(self.data[lo:hi], "little") >> (self.at & 7)
        self.at += n
        return x & ((1 << n) - 1)

    def window(self, need: int) -> tuple[memoryview, int, int]:
        """Numbers of at least 25 bits by place, the first place, and the place behind the last; zeros follow the stream."""
        if self.view is None or self.at < self.base or self.at + need > self.stop:
            lo = self.at >> 3
            raw = np.frombuffer(self.data[lo : lo + WINDOW + 3], dtype=np.uint8)
            size = min(WINDOW, len(self.data) - lo + (need >> 3) + 8)
            u = np.zeros(size + 3, dtype=np.uint32)
            u[: len(raw)] = raw[: len(u)]
            u = u[:-3] | u[1:-2] << 8 | u[2:-1] << 16 | u[3:] << 24
            self.view = memoryview((u[:, None] >> np.arange(8, dtype=np.uint32)).ravel())
            self.base, self.stop = 8 * lo, 8 * (lo + size)
        return self.view, self.base, self.stop

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")


class Code:
    """A canonical prefix code as a table over its longest length; a lone symbol takes no bits.

    An entry is the symbol, shifted by four, and its length.
    """

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            table, most = np.array([(int(used[0]) if len(used) else 0) << 4]), 0
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            size = lengths[order]
            most = int(size[-1])
            if most > 15 or (1 << most - size).sum() != 1 << most:
                raise ValueError("the prefix code isn't complete")
            table = np.repeat(order << 4 | size, 1 << most - size)[_reversal(most)]
        self.table, self.mask = memoryview(table.astype(np.uint16 if table[-1] < 1 << 16 and table.max() < 1 << 16 else np.uint32)), (1 << most) - 1


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.int64)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, mask = code.table, code.mask
    # A token takes 14 bits at most.
    view, base, _ = bits.window(14 * min(size, most) + 32)
    p, out, before = bits.at - base, [], 8
    while len(out) < size and most:
        most -= 1
        e = table[view[p] & mask]
        p += e & 15
        x = e >> 4
        if x < 16:
            out.append(x)
            before = x or before
        elif x == 16:
            out += [before] * (3 + (view[p] & 3))
            p += 2
        elif x == 17:
            out += [0] * (3 + (view[p] & 7))
            p += 3
        else:
            out += [0] * (11 + (view[p] & 127))
            p += 7
    bits.at = base + p
    bits.check()
    if len(out) > size:
        raise ValueError("too many code lengths")
    lengths[: len(out)] = out
    return Code(lengths)


#: Extra bits and least amount of every symbol of a length or distance.
_EXTRA = [max(0, (s - 2) >> 1) for s in range(40)]
_LEAST = [s + 1 if s < 4 else ((2 + (s & 1)) << _EXTRA[s]) + 1 for s in range(40)]


def _across(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


class Coded:
    """An entropy-coded image up to its codes: cache bits and, where it has groups, each tile's group."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.bits, self.width, self.total = bits, width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        self.groups, self.group_of, self.prefix = 1, None, 0
        if main and bits.read(1):
            self.prefix = bits.read(3) + 2
            tiles = Coded(bits, _across(width, self.prefix), _across(height, self.prefix), False).pixels()
            self.group_of = (tiles >> 8 & 0xFFFF).tolist()
            self.groups = max(self.group_of) + 1
        self.sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.copies = self.cached = 0

    def pixels(self) -> np.ndarray:
        """Pixels as unsigned ARGB numbers, one symbol after the other."""
        codes = [[_read_code(self.bits, n) for n in self.sizes] for _ in range(self.groups)]
        cache = [0] * (1 << self.cache_bits if self.cache_bits else 0)
        return np.array(self.go_on([tuple(x for c in five for x in (c.table, c.mask)) for five in codes], [], cache), dtype=np.uint32)

    def go_on(self, sets: list[tuple], out: list[int], cache: list[int]) -> list[int]:
        """The rest of the pixels, behind those in ``out``, which the cache holds already."""
        bits, width, total, group_of, prefix = self.bits, self.width, self.total, self.group_of, self.prefix
        across, near, shift = _across(width, prefix), _near(width), 32 - self.cache_bits
        add, n = out.append, len(out)
        remembered = n
        G, g_mask, R, r_mask, B, b_mask, A, a_mask, D, d_mask = sets[0]
        while n < total:
            view, base, stop = bits.window(SYMBOL)
            p, limit = bits.at - base, stop - base - SYMBOL
            while n < total and p <= limit:
                if group_of is not None:
                    G, g_mask, R, r_mask, B, b_mask, A, a_mask, D, d_mask = sets[group_of[(n // width >> prefix) * across + (n % width >> prefix)]]
                e = G[view[p] & g_mask]
                p += e & 15
                s = e >> 4
                if s < 256:
                    e = R[view[p] & r_mask]
                    p += e & 15
                    f = B[view[p] & b_mask]
                    p += f & 15
                    a = A[view[p] & a_mask]
                    p += a & 15
                    add(a >> 4 << 24 | e >> 4 << 16 | s << 8 | f >> 4)
                    n += 1
                elif s < 280:
                    more = _EXTRA[s - 256]
                    length = _LEAST[s - 256] + (view[p] & (1 << more) - 1)
                    p += more
                    e = D[view[p] & d_mask]
                    p += e & 15
                    more = _EXTRA[e >> 4]
                    far = _LEAST[e >> 4] + (view[p] & (1 << more) - 1)
                    p += more
                    far = far - 120 if far > 120 else near[far - 1]
                    if far > n or n + length > total:
                        raise ValueError("a back-reference leaves the image")
                    out += out[n - far : n - far + length] if far >= length else (out[n - far :] * (length // far + 1))[:length]
                    n += length
                    self.copies += 1
                else:
                    for x in out[remembered:]:
                        cache[(CACHE_HASH * x & 0xFFFFFFFF) >> shift] = x
                    remembered = n
                    add(cache[s - 280])
                    n += 1
                    self.cached += 1
            bits.at = base + p
            bits.check()
        return out


@functools.lru_cache(maxsize=64)
def _near(width: int) -> tuple[int, ...]:
    return tuple(max(1, dx + dy * width) for dx, dy in NEIGHBOURS)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(np.int64)


def _predict(mode: int, left, top, right_top, left_top):
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        p_left, p_top = np.abs(top - left_top).sum(), np.abs(left - left_top).sum()
        return left if p_left < p_top else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + np.trunc((mean - left_top) / 2).astype(np.int64), 0, 255)
    simple = {1: left, 2: top, 3: right_top, 4: left_top}
    if mode in simple:
        return simple[mode]
    pairs = {5: (half(left, right_top), top), 6: (left, left_top), 7: (left, top), 8: (left_top, top), 9: (top, right_top)}
    if mode in pairs:
        return half(*pairs[mode])
    if mode == 10:
        return half(half(left, left_top), half(top, right_top))
    return np.array([255, 0, 0, 0])


def _undo_predictor(px: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = px.shape
    black = np.array([255, 0, 0, 0])
    px = px.copy()
    px[0, 0] = (px[0, 0] + black) & 255
    px[0] = np.cumsum(px[0], axis=0) & 255
    for y in range(1, height):
        row, above = px[y], px[y - 1]
        kinds = modes[y >> size_bits]
        row[0] = (row[0] + above[0]) & 255
        if (kinds == 2).all():
            row[1:] = (row[1:] + above[1:]) & 255
            continue
        if (kinds == 1).all():
            px[y] = np.cumsum(row, axis=0) & 255
            continue
        for x in range(1, width):
            right_top = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + _predict(int(kinds[x >> size_bits]), row[x - 1], above[x], right_top, above[x - 1])) & 255
    return px


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def _undo_cross(px: np.ndarray, tiles: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = px.shape
    t = tiles[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    green_to_red, green_to_blue, red_to_blue = _signed(t[..., 3]), _signed(t[..., 2]), _signed(t[..., 1])
    green = _signed(px[..., 2])
    px = px.copy()
    px[..., 1] = (px[..., 1] + (green_to_red * green >> 5)) & 255
    px[..., 3] = (px[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * _signed(px[..., 1]) >> 5)) & 255
    return px


def _undo_palette(px: np.ndarray, table: np.ndarray, width: int, bundle: int) -> np.ndarray:
    packed = px[..., 2]
    x = np.arange(width)
    depth = 8 >> bundle
    index = packed[:, x >> bundle] >> ((x & ((1 << bundle) - 1)) * depth) & ((1 << depth) - 1)
    full = np.zeros((256, 4), dtype=np.int64)
    full[: len(table)] = table
    return full[index]


PARTS = {PREDICTOR: "predictor", CROSS_COLOR: "cross-colour", SUBTRACT_GREEN: "subtract green", PALETTE: "palette"}


class Stream:
    """A VP8L chunk up to its main image's codes, and how to undo its transforms. ``used`` counts the parts that came."""

    def __init__(self, data: bytes):
        bits = Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("no lossless WebP stream")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.undo, seen, wide, height = [], set(), self.width, self.height
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise ValueError("a transform comes twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOR):
                size_bits = bits.read(3) + 2
                w, h = _across(wide, size_bits), _across(height, size_bits)
                tiles = _channels(Coded(bits, w, h, False).pixels()).reshape(h, w, 4)
                if kind == PREDICTOR:
                    self.undo.append(lambda p, t=tiles[..., 2] & 15, n=size_bits: _undo_predictor(p, t, n))
                else:
                    self.undo.append(lambda p, t=tiles, n=size_bits: _undo_cross(p, t, n))
            elif kind == SUBTRACT_GREEN:
                self.undo.append(lambda p: np.stack([p[..., 0], (p[..., 1] + p[..., 2]) & 255, p[..., 2], (p[..., 3] + p[..., 2]) & 255], axis=-1))
            else:
                n = bits.read(8) + 1
                table = np.cumsum(_channels(Coded(bits, n, 1, False).pixels()), axis=0) & 255
                bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.undo.append(lambda p, t=table, w=wide, b=bundle: _undo_palette(p, t, w, b))
                wide = _across(wide, bundle)
        self.transforms = [PARTS[k] for k in sorted(seen)]
        self.main = Coded(bits, wide, height, True)

    def finish(self, argb: np.ndarray) -> np.ndarray:
        """Height x width x (alpha, red, green, blue)."""
        if not self.undo:
            return argb.view(np.uint8).reshape(self.height, self.width, 4)[..., ::-1]
        px = _channels(argb).reshape(self.height, self.main.width, 4)
        for f in reversed(self.undo):
            px = f(px)
        return px.astype(np.uint8)

    def used(self) -> list[str]:
        m = self.main
        return ["prefix codes", *self.transforms, *["back-references"] * (m.copies > 0), *["cache"] * (m.cached > 0), *["groups"] * (m.groups > 1)]


#: Below this many images at work, they are read one by one.
FEW = 96


def read_together(images: list[Coded]) -> list[np.ndarray]:
    """Pixels of many images without groups, pixel by pixel of all at once; the longest ones' ends one by one."""
    order = sorted(range(len(images)), key=lambda i: -images[i].total)
    lanes = [images[i] for i in order]
    k = len(lanes)
    pad = b"\0" * 16
    begins = np.cumsum([0, *(len(x.bits.data) + 16 for x in lanes)])
    buffer = b"".join(x for c in lanes for x in (c.bits.data, pad)) + pad
    words = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    at = np.array([c.bits.at for c in lanes]) + 8 * begins[:-1]
    tables = []
    for j in range(5):
        lengths, at = _lengths_together(words, at, np.array([c.sizes[j] for c in lanes]))
        tables.append(Tables(lengths))
    G, R, B, A, D = tables
    totals = np.array([c.total for c in lanes])
    bits = np.array([c.cache_bits for c in lanes])
    cache_at = np.cumsum(1 << bits) - (1 << bits)
    cache, shift = np.zeros(int((1 << bits).sum()), dtype=np.uint32), (32 - bits).astype(np.uint64)
    # An image's own place, up to where the others have ended.
    rest = int(totals[FEW - 1]) if k >= FEW else 0
    room = np.minimum(totals, rest)
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), dtype=np.uint32)
    left, far, value = np.zeros(k, dtype=np.int64), np.ones(k, dtype=np.int64), np.zeros(k, dtype=np.uint32)
    near = np.array([_near(c.width) for c in lanes])
    extra, least = np.array(_EXTRA), np.array(_LEAST)
    alphas = bool(A.mask.any())
    counts = np.searchsorted(-totals, -np.arange(rest), side="left")
    copied, cached = np.zeros(k, dtype=bool), np.zeros(k, dtype=bool)
    for t, k in enumerate(counts.tolist()):
        new = np.flatnonzero(left[:k] == 0)
        if len(new):
            q = at[new]
            w = words[q >> 3] >> (q & 7).astype(np.uint64)
            s, w, q = G.read(new, w, q)
            literal = np.flatnonzero(s < 256)
            who, v = new[literal], w[literal]
            r, v, p = R.read(who, v, q[literal])
            b, v, p = B.read(who, v, p)
            if alphas:
                v = words[p >> 3] >> (p & 7).astype(np.uint64)
            a, v, p = A.read(who, v, p)
            q[literal] = p
            value[who] = a << 24 | r << 16 | s[literal] << 8 | b
            if len(who) < len(new):
                other = np.flatnonzero(s >= 280)
                if len(other):
                    who = new[other]
                    cached[who] = True
                    value[who] = cache[cache_at[who] + s[other] - 280]
                other = np.flatnonzero((s >= 256) & (s < 280))
                if len(other):
                    who, kind, p = new[other], s[other] - 256, q[other]
                    size = least[kind] + (w[other] & ((1 << extra[kind]) - 1).astype(np.uint64)).astype(np.int64)
                    p += extra[kind]
                    kind, v, p = D.read(who, words[p >> 3] >> (p & 7).astype(np.uint64), p)
                    v = words[p >> 3] >> (p & 7).astype(np.uint64)
                    d = least[kind] + (v & ((1 << extra[kind]) - 1).astype(np.uint64)).astype(np.int64)
                    q[other] = p + extra[kind]
                    d = np.where(d > 120, d - 120, near[who, np.minimum(d, 120) - 1])
                    if (d > t).any() or (t + size > totals[who]).any():
                        raise ValueError("a back-reference leaves the image")
                    left[who], far[who], copied[who] = size, d, True
            at[new] = q
        going = np.flatnonzero(left[:k])
        if len(going):
            value[going] = out[begin[going] + t - far[going]]
            left[going] -= 1
        out[begin[:k] + t] = value[:k]
        cache[cache_at[:k] + (value[:k] * np.uint32(CACHE_HASH) >> shift[:k]).astype(np.int64)] = value[:k]
    result: list[np.ndarray] = [out] * len(images)
    for j, (i, c) in enumerate(zip(order, lanes)):
        done = out[begin[j] : begin[j] + room[j]]
        c.bits.at = int(at[j] - 8 * begins[j])
        c.bits.check()
        c.copies, c.cached = int(copied[j]), int(cached[j])
        if c.total > rest:
            px = done.tolist()
            for _ in range(int(left[j])):
                px.append(px[-int(far[j])])
            held = cache[cache_at[j] : cache_at[j] + (1 << bits[j])].tolist()
            if bits[j]:
                for x in px[rest:]:
                    held[(CACHE_HASH * x & 0xFFFFFFFF) >> (32 - int(bits[j]))] = x
            done = np.array(c.go_on([tuple(x for table in tables for x in table.one(j))], px, held), dtype=np.uint32)
        result[i] = done
    return result


class Tables:
    """The tables of one code of many images, one behind the other."""

    def __init__(self, lengths: list[np.ndarray] | np.ndarray):
        lane, symbol = np.nonzero(lengths)
        size = lengths[lane, symbol].astype(np.int64)
        images = len(lengths)
        most = lengths.max(axis=1, initial=0).astype(np.int64)
        lone = np.bincount(lane, minlength=images) < 2
        most[lone] = 0
        if most.max(initial=0) > 15:
            raise ValueError("the prefix code isn't complete")
        order = np.argsort(lane << 4 | size, kind="stable")
        lane, symbol, size = lane[order], symbol[order], np.where(lone[lane], 0, size)[order]
        # A code without symbols has symbol 0.
        empty = np.setdiff1d(np.flatnonzero(lone), lane)
        if len(empty):
            order = np.argsort(np.concatenate([lane, empty]), kind="stable")
            lane, symbol, size = (np.concatenate([x, y])[order] for x, y in ((lane, empty), (symbol, 0 * empty), (size, 0 * empty)))
        room = 1 << most[lane] - size
        if (np.bincount(lane, room, images) != 1 << most).any():
            raise ValueError("the prefix code isn't complete")
        flat = np.repeat((symbol << 4 | size).astype(np.uint16), room)
        self.at, self.most, self.mask = np.cumsum(1 << most) - (1 << most), most, ((1 << most) - 1).astype(np.uint64)
        self.table = np.empty_like(flat)
        for m in set(most.tolist()):
            which = self.at[most == m][:, None]
            self.table[which + np.arange(1 << m)] = flat[which + _reversal(m)]

    def read(self, who: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that begin the bits ``w``, and bits and places behind them."""
        e = self.table[self.at[who] + (w & self.mask[who]).astype(np.int64)].astype(np.int64)
        n = e & 15
        return e >> 4, w >> n.astype(np.uint64), p + n

    def one(self, j: int) -> tuple[memoryview, int]:
        return memoryview(self.table[self.at[j] : self.at[j] + (1 << self.most[j])]), (1 << int(self.most[j])) - 1


def _lengths_together(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of one code of many images, and the places behind."""
    images, at = len(at), at.copy()
    lengths = np.zeros((images, int(sizes.max())), dtype=np.uint8)
    own, most, normal = np.zeros((images, 19), dtype=np.uint8), sizes.copy(), []
    head = (words[at >> 3] >> (at & 7).astype(np.uint64)).tolist()
    for i, x in enumerate(head):
        if x & 1:
            wide = x >> 2 & 1
            lengths[i, x >> 3 & (255 if wide else 1)] = 1
            used = 11 if wide else 4
            if x & 2:
                lengths[i, x >> used & 255] = 1
                used += 8
            at[i] += used
            continue
        normal.append(i)
        count = 4 + (x >> 1 & 15)
        at[i] += 5
        x >>= 5
        for k, s in enumerate(LENGTH_ORDER[:count]):
            if k == 16:
                p = int(at[i]) + 48
                x = int(words[p >> 3]) >> (p & 7)
            own[i, s] = x & 7
            x >>= 3
        p = int(at[i]) + 3 * count
        x = int(words[p >> 3]) >> (p & 7)
        if x & 1:
            n = 2 + 2 * (x >> 1 & 7)
            most[i] = 2 + (x >> 4 & (1 << n) - 1)
            p += 4 + n
        else:
            p += 1
        at[i] = p
    live = np.array(normal, dtype=np.int64)
    if not len(live):
        return lengths, at
    table = Tables(own)
    filled, before = np.zeros(images, dtype=np.int64), np.full(images, 8)
    said: list[tuple[np.ndarray, ...]] = []
    while len(live):
        p = at[live]
        x, w, p = table.read(live, words[p >> 3] >> (p & 7).astype(np.uint64), p)
        w = w.astype(np.int64)
        again, zeros, many = x == 16, x == 17, x == 18
        count = np.where(x < 16, 1, np.where(again, 3 + (w & 3), np.where(zeros, 3 + (w & 7), 11 + (w & 127))))
        value = np.where(x < 16, x, np.where(again, before[live], 0))
        at[live] = p + 2 * again + 3 * zeros + 7 * many
        said.append((live, filled[live], count, value))
        before[live] = np.where((x > 0) & (x < 16), x, before[live])
        filled[live] += count
        most[live] -= 1
        live = live[(filled[live] < sizes[live]) & (most[live] > 0)]
    if (filled > sizes).any():
        raise ValueError("too many code lengths")
    lane, start, count, value = (np.concatenate(x) for x in zip(*said))
    some = value > 0
    lane, start, count, value = lane[some], start[some], count[some], value[some]
    ends = np.cumsum(count)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    lengths[np.repeat(lane, count), np.repeat(start, count) + place] = np.repeat(value, count)
    return lengths, at


def streams(media: bytes) -> Iterator[bytes]:
    """The VP8L chunks of one or more lossless WebP files."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        chunk = at + 12
        while chunk < end:
            kind, n = media[chunk : chunk + 4], struct.unpack_from("<I", media, chunk + 4)[0]
            if kind == b"VP8 ":
                raise ValueError("lossy WebP")
            if kind == b"VP8L":
                yield media[chunk + 8 : chunk + 8 + n]
            chunk += 8 + n + (n & 1)
        at = end


def decode(media: bytes, used: dict[str, int] | None = None) -> list[np.ndarray]:
    """The images of one or more lossless WebP files; ``used`` counts the images that have each part."""
    images = []
    for data in streams(media):
        s = Stream(data)
        images.append(s.finish(s.main.pixels()))
        for part in s.used() if used is not None else ():
            used[part] = used.get(part, 0) + 1
    return images


def decode_many(media: list[bytes]) -> list[list[np.ndarray]]:
    """What ``decode`` gives for each, read together."""
    found = [(k, Stream(data)) for k, m in enumerate(media) for data in streams(m)]
    together = [s for _, s in found if s.main.groups == 1]
    if len(together) >= FEW:
        pixels = dict(zip(map(id, together), read_together([s.main for s in together])))
    else:
        pixels = {}
    out: list[list[np.ndarray]] = [[] for _ in media]
    for k, s in found:
        px = pixels.get(id(s))
        out[k].append(s.finish(s.main.pixels() if px is None else px))
    return out


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads, whose lengths are multiples of a row's, as lossless WebP."""
    parts, owner = [], []
    for k, payload in enumerate(payloads):
        rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW // 3, 3)
        for i in range(0, len(rows), MOST_ROWS):
            parts.append(rows[i : i + MOST_ROWS])
            owner.append(k)
    out = [b""] * len(payloads)
    at = size = 0
    for i, part in enumerate(parts):
        size += len(part)
        if size >= 2 * MOST_ROWS or i == len(parts) - 1:
            for k, file in zip(owner[at : i + 1], encode_many(parts[at : i + 1])):
                out[k] += file
            at, size = i + 1, 0
    return out


def store(payload: bytes) -> bytes:
    """One payload as lossless WebP."""
    return store_many([payload])[0]


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """The stored samples, as flat arrays."""
    return [np.concatenate([image[..., 1:].reshape(-1) for image in images]) for images in decode_many(media)]


def load(media: bytes) -> np.ndarray:
    return load_many([media])[0]


def pad(text: bytes) -> bytes:
    short = -len(text) % ROW if text else ROW
    return text + b"\xff" * short


def feature(samples: np.ndarray) -> str:
    """Rows, mean of each channel, and the entropy of the samples in bits."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    means = samples.reshape(-1, 3).mean(axis=0)
    return f"{len(samples) // ROW};{means[0]:.3f},{means[1]:.3f},{means[2]:.3f};{-(p * np.log2(p)).sum():.4f}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = [t or b"" for t in utf8_column(part.column("text"))]
            media = store_many([pad(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _loaded(media: list[bytes], size: int = 1 << 22) -> Iterator[tuple[bytes, np.ndarray]]:
    """Media with their samples, some megabytes together."""
    at = total = 0
    for i, m in enumerate(media):
        total += len(m)
        if total >= size or i == len(media) - 1:
            yield from zip(media[at : i + 1], load_many(media[at : i + 1]))
            at, total = i + 1, 0


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for media, samples in _loaded(batch.column("media").to_pylist()):
            payload = samples.tobytes()
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            for to, x in zip(out, row):
                to.append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(out, kinds))], [x.split()[0] for x in _READ.split(", ")])


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's payload as lossless WebP."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of what is decoded from ``media``."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read_batches, _READ)


def pixels(stored: DataFrame) -> DataFrame:
    """image, width, height, rgb: the pixel arrays of every image in ``media``."""

    def run(batches):
        for batch in batches:
            for i, media in enumerate(batch.column("media").to_pylist()):
                for k, px in enumerate(decode(media) if media else ()):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, 1), pa.array([k], pa.int32()), pa.array([px.shape[1]], pa.int32()), pa.array([px.shape[0]], pa.int32()), pa.array([px[..., 1:].tobytes()], pa.binary())],
                        ["doc_id", "image", "width", "height", "rgb"],
                    )

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, image int, width int, height int, rgb binary")
