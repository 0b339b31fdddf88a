"""A lossless WebP encoder for RGB samples: prefix codes of the image's own counts, back-references, a colour cache,
and the transforms that an estimate finds worth their bits.

Many images go through the array work at once; each one's bytes follow from its own samples alone, so equal samples give equal
bytes in any company. Work grows with the pixels and the sort of their pairs.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order of code lengths' own lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (columns to the left, rows up) of the short distance codes.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed value of the format: the colour cache's multiplier.
CACHE_HASH = 0x1E35A7BD
#: Fixed values of the format: longest copy and farthest distance.
LONGEST, FARTHEST = 4096, (1 << 20) - 120
SHORTEST = 3
TILE_BITS = 9


class Writer:
    """Writes little-endian bits."""

    def __init__(self):
        self.value = self.n = self.end = 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def header(width: int, height: int) -> Writer:
    w = Writer()
    for x, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.put(x, n)
    return w


# Prefix codes of many images: (lane, symbol, ...) arrays in order of lane and symbol, a lane for each code


def code_lengths(lane: np.ndarray, count: np.ndarray, lanes: int, limit: int = 15) -> np.ndarray:
    """Each symbol's length in its lane's shortest complete prefix code; where one passes ``limit``, its counts are flattened
    and it is made again. A lone symbol has length 1.

    All lanes merge their two lightest nodes at once: leaves come by weight and inner nodes are made by weight, so these are at the fronts.
    """
    out = np.ones(len(lane), dtype=np.int64)
    n = np.bincount(lane, minlength=lanes)
    most = int(n.max(initial=0))
    if most < 2:
        return out
    by_size = np.argsort(-n, kind="stable")
    rank = np.empty(lanes, dtype=np.int64)
    rank[by_size] = np.arange(lanes)
    order = np.lexsort((np.arange(len(lane)), count, rank[lane]))
    n = n[by_size]
    begin = np.cumsum(n) - n
    # Every lane has a sentinel behind its leaves, and as many inner nodes, which weigh all before they are made.
    first = begin + np.arange(lanes)
    heavy = np.iinfo(np.int64).max // 4
    leaves, nodes = np.full(len(lane) + lanes, heavy), np.full(len(lane) + lanes, heavy)
    at = np.arange(len(lane)) + rank[lane[order]]
    leaves[at] = count[order]
    leaf_up, node_up = np.zeros(len(leaves), dtype=np.int64), np.zeros(len(leaves), dtype=np.int64)
    a, b = first.copy(), first.copy()
    active = np.searchsorted(-n, -np.arange(1, most), side="left")
    for j, k in enumerate(active.tolist()):
        total, new = 0, first[:k] + j
        x, y = a[:k], b[:k]
        for _ in (0, 1):
            leaf, node = leaves[x], nodes[y]
            take = leaf <= node
            total = total + np.where(take, leaf, node)
            leaf_up[x] = np.where(take, new, leaf_up[x])
            node_up[y] = np.where(take, node_up[y], new)
            x += take
            y += ~take
        nodes[new] = total
    depth = np.zeros(len(leaves), dtype=np.int64)
    for j in range(most - 3, -1, -1):
        k = int(np.searchsorted(-n, -(j + 2), side="left"))
        new = first[:k] + j
        depth[new] = depth[node_up[new]] + 1
    found = depth[leaf_up[at]] + 1
    out[order] = np.where((n > 1)[rank[lane[order]]], found, 1)
    over = np.bincount(lane, out > limit, lanes)[lane] > 0
    if over.any():
        out[over] = code_lengths(lane[over], (count[over] + 1) >> 1, lanes, limit)
    return out


@functools.cache
def _reversal(bits: int) -> np.ndarray:
    x = np.arange(1 << bits)
    return sum((x >> k & 1) << (bits - 1 - k) for k in range(bits)) + np.zeros(1 << bits, dtype=np.int64)


def code_words(lane: np.ndarray, size: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's bits, lowest first, and their number; a lone symbol takes none."""
    words, n = np.zeros(len(lane), dtype=np.uint64), np.bincount(lane, minlength=lanes)
    order = np.argsort(lane << 4 | size, kind="stable")
    most = np.zeros(lanes, dtype=np.int64)
    np.maximum.at(most, lane, size)
    # In order of length, codes follow one another in the space of the longest; what is read first is the highest bit.
    place = (1 << (most[lane] - size))[order]
    begin = np.cumsum(place) - place
    begin -= begin[np.r_[0, np.cumsum(n)[:-1]].clip(max=max(len(begin) - 1, 0))][lane[order]]
    words[order] = _reversal(16)[begin & 0xFFFF] >> (16 - most[lane[order]])
    return np.where(n[lane] > 1, words, 0).astype(np.uint64), np.where(n[lane] > 1, size, 0)


def say_codes(lane: np.ndarray, symbol: np.ndarray, size: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, bits, number of bits) that tell the codes, in order of lane."""
    n = np.bincount(lane, minlength=lanes)
    ends = np.cumsum(n)
    last = np.zeros(lanes, dtype=np.int64)
    last[n > 0] = symbol[ends[n > 0] - 1]
    short = (n <= 2) & (last < 256)
    # One or two symbols.
    which = np.flatnonzero(short)
    first = np.zeros(lanes, dtype=np.int64)
    first[n > 0] = symbol[(ends - n)[n > 0]]
    wide, two = first[which] > 1, n[which] == 2
    used = np.where(wide, 11, 4)
    tokens = [(which, 1 | two << 1 | wide << 2 | first[which] << 3 | np.where(two, last[which], 0) << used, used + 8 * two)]
    # All others: runs of lengths up to the last symbol.
    long = np.flatnonzero(~short)
    if len(long):
        room = np.where(short, 0, last + 1)
        begin = np.cumsum(room) - room
        flat, owner = np.zeros(int(room.sum()), dtype=np.int64), np.repeat(np.arange(lanes), room)
        some = ~short[lane]
        flat[begin[lane[some]] + symbol[some]] = size[some]
        start = np.flatnonzero(np.diff(flat, prepend=-1) | np.diff(owner, prepend=-1))
        value, whose, count = flat[start], owner[start], np.diff(start, append=len(flat))
        zero = value == 0
        count = count - ~zero
        unit = np.where(zero, 138, 6)
        full, rest = count // unit, count % unit
        many, few = zero & (rest >= 11), (rest >= 3) & ~(zero & (rest >= 11))
        single = np.where(many | few, 0, rest)
        # A run in order: its length once, whole repeats, a part of one, and what is too short to repeat.
        kind = np.stack([value, np.where(zero, 18, 16), np.where(many, 18, np.where(zero, 17, 16)), value], axis=1)
        extra = np.stack([0 * value, np.where(zero, 127, 3), np.where(many, rest - 11, rest - 3), 0 * value], axis=1)
        times = np.stack([(~zero).astype(np.int64), full, (many | few).astype(np.int64), single], axis=1).ravel()
        kind, extra, whose = np.repeat(kind.ravel(), times), np.repeat(extra.ravel(), times), np.repeat(np.repeat(whose, 4), times)
        more = np.array([0] * 16 + [2, 3, 7])[kind]
        counts = np.bincount(whose * 19 + kind, minlength=lanes * 19)
        key = np.flatnonzero(counts)
        lengths = code_lengths(key // 19, counts[key], lanes, 7)
        words, sizes = code_words(key // 19, lengths, lanes)
        own, word, wide = (np.zeros(lanes * 19, dtype=np.int64) for _ in range(3))
        own[key], word[key], wide[key] = lengths, words.astype(np.int64), sizes
        told = own.reshape(lanes, 19)[long][:, LENGTH_ORDER]
        number = np.maximum(4, 19 - (told[:, ::-1] > 0).argmax(axis=1))
        tokens.append((long, (number - 4) << 1 | (told << (5 + 3 * np.arange(19))).sum(axis=1), 5 + 3 * number))
        # How many tokens follow, two at least: two lengths or more, or zeros before a last one.
        few = np.bincount(whose, minlength=lanes)[long] - 2
        half = np.maximum(1, (np.frexp(few.astype(np.float64))[1] + 1) // 2)
        tokens.append((long, 1 | (half - 1) << 1 | few << 4, 4 + 2 * half))
        key = whose * 19 + kind
        tokens.append((whose, word[key] | extra << wide[key], wide[key] + more))
    lane, value, bits = (np.concatenate(x) for x in zip(*tokens))
    order = np.argsort(lane, kind="stable")
    return lane[order], value[order].astype(np.uint64), bits[order]


# Symbols


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths and distances from 1."""
    d = value - 1
    top = np.frexp(np.maximum(d, 1).astype(np.float64))[1] - 1
    more = np.maximum(top - 1, 0)
    small = d < 4
    return np.where(small, d, 2 * top + (d >> more & 1)), np.where(small, 0, d & ((1 << more) - 1)), np.where(small, 0, more)


@functools.lru_cache(maxsize=8)
def _near_codes(width: int) -> np.ndarray:
    """The short code of each small distance, 0 where there is none."""
    out = np.zeros(8 * width + 16, dtype=np.int64)
    for code in range(len(NEIGHBOURS), 0, -1):
        dx, dy = NEIGHBOURS[code - 1]
        out[max(1, dx + dy * width)] = code
    return out


class Images:
    """Pixels (ARGB numbers) of many images in one array, with each pixel's image."""

    def __init__(self, pixels: list[np.ndarray]):
        self.px = np.concatenate(pixels)
        self.sizes = np.array([len(x) for x in pixels])
        self.ends = np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(pixels)), self.sizes)


#: The most pixels at once: a place fits its bits of a sort key.
PLACE_BITS = 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def _before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and, for each, the last place before it with the same key (40 bits), where there is one."""
    both = np.sort(key << np.uint64(PLACE_BITS) | np.arange(len(key), dtype=np.uint64))
    same = (both[1:] ^ both[:-1]) <= _PLACE
    return (both[1:][same] & _PLACE).astype(np.int64), (both[:-1][same] & _PLACE).astype(np.int64)


def copies(images: Images) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references, found left to right: from each pair of pixels to the one before it."""
    px, owner = images.px, images.owner
    none = (np.zeros(0, dtype=np.int64),) * 3
    if len(px) < 2:
        return none
    pair = (px[:-1].astype(np.uint64) << np.uint64(32) | px[1:]) + owner[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, to = _before(pair * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24))
    good = (px[at] == px[to]) & (px[at + 1] == px[to + 1]) & (owner[to] == owner[at + 1]) & (at - to <= FARTHEST)
    far = np.zeros(len(px), dtype=np.int64)
    far[at[good]] = (at - to)[good]
    # A distance that stays the same for k pairs makes k + 1 equal pixels.
    ends = np.flatnonzero(np.diff(far, append=-1))
    size = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(px)) + 2
    start = np.flatnonzero((far > 0) & (size >= SHORTEST))
    if not len(start):
        return none
    # A pair that is its image's last ends its run: the next pair has another owner and thus no distance, or one of its own.
    size = np.minimum(np.minimum(size[start], LONGEST), images.ends[owner[start]] - start)
    after = np.searchsorted(start, start + size).tolist()
    kept, k, count = [], 0, len(start)
    while k < count:
        kept.append(k)
        k = after[k]
    return start[kept], size[kept], far[start[kept]]


def _bits(counts: np.ndarray) -> np.ndarray:
    """About the bits that symbols of these counts take, and their code, row by row."""
    total = counts.sum(axis=1)
    each = (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    return total * np.log2(np.maximum(total, 1)) - each + 5 * np.count_nonzero(counts, axis=1)


def _table(owner: np.ndarray, symbol: np.ndarray, images: int, size: int) -> np.ndarray:
    return np.bincount(owner * size + symbol, minlength=images * size).reshape(images, size)


#: Where each code's symbols begin, side by side, and where the last ends.
_AT = np.array([0, 1304, 1560, 1816, 2072])
SPAN = 2112
_STAGE = np.repeat(np.arange(5), np.diff(_AT, append=SPAN))


def put_images(writers: list[Writer], pixels: list[np.ndarray], widths: list[int], main: bool, seek: bool = True) -> list[bytes]:
    """Writes entropy-coded images, their data as the last bits; what each writer holds goes first, and its ``end`` is the bits' number."""
    images, count = Images(pixels), len(pixels)
    px, owner = images.px, images.owner
    at, length, far = copies(images) if seek else (np.zeros(0, dtype=np.int64),) * 3
    whose = owner[at]
    edge = np.zeros(len(px) + 1, dtype=np.int8)
    edge[at] += 1
    edge[at + length] -= 1
    single = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    own, mine = px[single], owner[single]
    green, red, blue, alpha = ((own >> k & 255).astype(np.int64) for k in (8, 16, 0, 24))
    lengths_ = _prefixed(length)
    code = np.zeros(len(at), dtype=np.int64)
    for width in set(widths):
        near, some = _near_codes(width), np.array(widths)[whose] == width
        code[some] = np.where(far[some] < len(near), near[np.minimum(far[some], len(near) - 1)], 0)
    distances = _prefixed(np.where(code > 0, code, far + 120))
    copied, away = _table(whose, lengths_[0], count, 24), _table(whose, distances[0], count, 40)
    # With a cache, pixels that it holds are one symbol each.
    bits = np.array([min(10, max(3, int(n).bit_length() - 2)) if n >= 32 else 0 for n in images.sizes])
    keys = (px * np.uint32(CACHE_HASH) >> np.minimum(32 - bits, 31).astype(np.uint32)[owner]).astype(np.int64) & 1023
    here, last = _before((owner << 10 | keys).astype(np.uint64))
    held = np.zeros(len(px), dtype=bool)
    held[here] = (px[here] == px[last]) & (bits[owner[here]] > 0)
    hit, key = held[single], keys[single]
    out = ~hit
    full = [_table(mine, c, count, 256) for c in (green, red, blue, alpha)]
    rest = [_table(mine[out], c[out], count, 256) for c in (green, red, blue, alpha)]
    cached = _table(mine[hit], key[hit], count, 1024)
    plain = _bits(np.hstack([full[0], copied])) + _bits(full[1]) + _bits(full[2])
    use = _bits(np.hstack([rest[0], copied, cached])) + _bits(rest[1]) + _bits(rest[2]) < plain
    hit &= use[mine]
    literal = ~hit
    # Five codes an image, side by side: green with lengths and cache, red, blue, alpha, distance.
    counts = np.zeros((count, SPAN), dtype=np.int64)
    counts[:, :256], counts[:, 256:280] = np.where(use[:, None], rest[0], full[0]), copied
    counts[:, 280:1304] = np.where(use[:, None], cached, 0)
    for k in (1, 2, 3):
        counts[:, _AT[k] : _AT[k] + 256] = np.where(use[:, None], rest[k], full[k])
    counts[:, _AT[4] :] = away
    image, place = np.nonzero(counts)
    stage = _STAGE[place]
    lane, lanes = image * 5 + stage, 5 * count
    sizes_ = code_lengths(lane, counts[image, place], lanes)
    lane_, value_, number_ = say_codes(lane, place - _AT[stage], sizes_, lanes)
    words, numbers = np.zeros(count * SPAN, dtype=np.uint64), np.zeros(count * SPAN, dtype=np.int64)
    words[image * SPAN + place], numbers[image * SPAN + place] = code_words(lane, sizes_, lanes)
    for i, w in enumerate(writers):
        w.put(1 | int(bits[i]) << 1 if use[i] else 0, 5 if use[i] else 1)
        if main:
            w.put(0, 1)
    value, bits_ = np.zeros(len(px), dtype=np.uint64), np.zeros(len(px), dtype=np.int64)
    base = mine * SPAN
    first = base + np.where(hit, 280 + key, green)
    v, b = words[first], numbers[first]
    for k, c in ((1, red), (2, blue), (3, alpha)):
        place = base + _AT[k] + c
        v |= np.where(literal, words[place], 0).astype(np.uint64) << b.astype(np.uint64)
        b = b + np.where(literal, numbers[place], 0)
    value[single], bits_[single] = v, b
    if len(at):
        s, extra, more = lengths_
        first, place = whose * SPAN + 256 + s, whose * SPAN + _AT[4] + distances[0]
        v, b = words[first], numbers[first]
        for x, k in ((extra, more), (words[place], numbers[place]), distances[1:]):
            v = v | x.astype(np.uint64) << b.astype(np.uint64)
            b = b + k
        value[at], bits_[at] = v, b
    some = np.flatnonzero(bits_)
    whose = np.concatenate([lane_ // 5, owner[some]])
    order = np.argsort(whose.astype(np.uint16), kind="stable")
    return _append(writers, np.concatenate([value_, value[some]])[order], np.concatenate([number_, bits_[some]])[order], whose[order])


def _append(writers: list[Writer], value: np.ndarray, bits: np.ndarray, owner: np.ndarray) -> list[bytes]:
    """Each writer's bits and behind them those of its values; every image begins at a word of 64 bits."""
    upto = np.cumsum(bits)
    after = upto[np.searchsorted(owner, np.arange(len(writers)), side="right") - 1]
    before = np.r_[0, after[:-1]]
    for w, n in zip(writers, (after - before).tolist()):
        w.end = w.n + n
    size = np.array([(w.end >> 6) + 2 for w in writers])
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint64)
    raw = out.view(np.uint8)
    for w, k in zip(writers, (8 * begin).tolist()):
        head = w.bytes()
        raw[k : k + len(head)] = np.frombuffer(head, dtype=np.uint8)
    start = upto - bits + (64 * begin + np.array([w.n for w in writers]) - before)[owner]
    some = np.flatnonzero(bits)
    word, shift, value = start[some] >> 6, (start[some] & 63).astype(np.uint64), value[some]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    # What doesn't fit goes to the next word; a shift by 64 is two.
    out[word[first] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), first)
    return [raw[k : k + ((w.end + 7) >> 3)].tobytes() for w, k in zip(writers, (8 * begin).tolist())]


# Transforms


def _argb(rgb: np.ndarray, alpha: int = 255) -> np.ndarray:
    x = rgb.astype(np.uint32)
    return np.uint32(alpha << 24) | x[..., 0] << 16 | x[..., 1] << 8 | x[..., 2]


def cross_factors(rgb: np.ndarray) -> tuple[int, int, int]:
    """Factors (by 32) of green in red, and of green and red in blue, by least squares of signed values."""
    r, g, b = (rgb[..., k].astype(np.int8).astype(np.float64).ravel() for k in range(3))
    r, g, b = r - r.mean(), g - g.mean(), b - b.mean()
    clip = lambda x: int(np.clip(np.round(32 * x), -128, 127))
    red = clip(r @ g / max(g @ g, 1.0))
    a = np.array([[g @ g, g @ r], [g @ r, r @ r]]) + np.eye(2)
    green, from_red = np.linalg.solve(a, np.array([g @ b, r @ b]))
    return red, clip(green), clip(from_red)


def without_cross(rgb: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    red, green, from_red = factors
    r, g, b = (rgb[..., k].astype(np.int8).astype(np.int64) for k in range(3))
    return np.stack([r - (red * g >> 5) & 255, g & 255, b - (green * g >> 5) - (from_red * r >> 5) & 255], axis=-1).astype(np.uint8)


def predicted(rgb: np.ndarray, mode: int) -> np.ndarray:
    """Differences to the pixel at the left (1) or above (2); edges as the format has them."""
    out = rgb.copy()
    out[0, 1:] = rgb[0, 1:] - rgb[0, :-1]
    out[1:, 0] = rgb[1:, 0] - rgb[:-1, 0]
    out[1:, 1:] = rgb[1:, 1:] - (rgb[1:, :-1] if mode == 1 else rgb[:-1, 1:])
    return out


def subtracted(rgb: np.ndarray) -> np.ndarray:
    out = rgb.copy()
    out[..., 0] -= rgb[..., 1]
    out[..., 2] -= rgb[..., 1]
    return out


def _choices(flat: np.ndarray, owner: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each image the cheapest of: as it is, subtract green, left, above; and whether cross-colour looks worth a trial."""
    left, above = np.diff(flat, axis=0, prepend=flat[:1]), flat.copy()
    above[width:] -= flat[:-width]
    green = flat.copy()
    green[:, (0, 2)] -= flat[:, 1:2]
    cost = np.stack([sum(_bits(_table(owner, x[:, k].astype(np.int64), count, 256)) for k in range(3)) for x in (flat, green, left, above)])
    cost += np.array([[0], [3], [40], [40]])
    r, g, b = (flat[:, k].astype(np.int8).astype(np.float64) for k in range(3))
    n = np.bincount(owner, minlength=count)
    mean = lambda x: np.bincount(owner, x, count) / n
    spread = lambda x, y: mean(x * y) - mean(x) * mean(y)
    vr, vg, vb = spread(r, r), spread(g, g), spread(b, b)
    close = (spread(g, r) ** 2 > vg * vr / 2) | (spread(g, b) ** 2 > vg * vb / 2) | (spread(r, b) ** 2 > vr * vb / 2)
    return cost.argmin(axis=0), close & (vr + vg + vb > 0)


def encode_many(samples: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of height x width x (red, green, blue) bytes; at most 2^24 pixels together, of one width."""
    width, count = samples[0].shape[1], len(samples)
    pixels = [_argb(x).ravel() for x in samples]
    images = Images(pixels)
    writers = [header(x.shape[1], x.shape[0]) for x in samples]
    colours = np.sort(images.owner << 24 | (images.px & 0xFFFFFF).astype(np.int64))
    colours = colours[np.diff(colours, prepend=-1) > 0]
    first = np.searchsorted(colours, np.arange(count + 1) << 24)
    many = np.diff(first)
    choice, cross = _choices(np.concatenate([x.reshape(-1, 3) for x in samples]), images.owner, count, width)
    widths = [width] * count
    # A table pays where indices share bytes, or colours come often.
    with_palette = [i for i in range(count) if many[i] <= 16 or many[i] <= 256 and 8 * many[i] <= len(pixels[i])]
    for i in set(range(count)) - set(with_palette):
        if choice[i] or cross[i]:
            pixels[i] = _transformed(writers[i], samples[i], int(choice[i]), bool(cross[i]))
        writers[i].put(0, 1)
    if with_palette:
        tables = [(colours[first[i] : first[i + 1]] & 0xFFFFFF | 255 << 24).astype(np.uint32) for i in with_palette]
        _put_palettes(writers, pixels, widths, with_palette, tables)
    return [container(x) for x in put_images(writers, pixels, widths, True)]


def _one_bits(rgb: np.ndarray) -> float:
    return float(sum(_bits(_table(np.zeros(rgb[..., k].size, dtype=np.int64), rgb[..., k].ravel().astype(np.int64), 1, 256))[0] for k in range(3)))


def _transformed(w: Writer, rgb: np.ndarray, choice: int, cross: bool) -> np.ndarray:
    """Writes the image's transforms; the pixels that are left."""
    steps, out = [], rgb
    if choice >= 2:
        steps, out = [(PREDICTOR, choice - 1)], predicted(rgb, choice - 1)
    plain, least = out, _one_bits(out) if cross or choice >= 2 else np.inf
    if choice and (bits := _one_bits(green := subtracted(plain)) + 3) < least:
        steps, out, least = [*steps, (SUBTRACT_GREEN, None)], green, bits
    if cross and any(factors := cross_factors(plain)) and _one_bits(fewer := without_cross(plain, factors)) + 60 < least:
        steps, out = [*(s for s in steps if s[0] == PREDICTOR), (CROSS_COLOR, factors)], fewer
    for kind, x in steps:
        w.put(1 | kind << 1, 3)
        if kind != SUBTRACT_GREEN:
            tile = 255 << 24 | x << 8 if kind == PREDICTOR else 255 << 24 | (x[2] & 255) << 16 | (x[1] & 255) << 8 | (x[0] & 255)
            w.put(TILE_BITS - 2, 3)
            # Tiles of one value, without a cache: every code has a lone symbol, and no bits follow.
            w.put(0, 1)
            for symbol in (tile >> 8 & 255, tile >> 16 & 255, tile & 255, tile >> 24, 0):
                w.put(1 | 4 | symbol << 3, 11)
    # Alpha is the same everywhere, also before the first pixel, so its differences are 0.
    return _argb(out, 0 if steps and steps[0][0] == PREDICTOR else 255).ravel()


def _put_palettes(writers: list[Writer], pixels: list[np.ndarray], widths: list[int], which: list[int], tables: list[np.ndarray]) -> None:
    """Writes colour tables, and leaves the pixels' places in them."""
    subs = [Writer() for _ in which]
    deltas = [np.diff(t.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)).astype(np.uint8).view(np.uint32).ravel() for t in tables]
    for i, table, sub, data in zip(which, tables, subs, put_images(subs, deltas, [len(t) for t in tables], False, seek=False)):
        w, n = writers[i], len(table)
        w.put(1 | PALETTE << 1, 3)
        w.put(n - 1, 8)
        w.put(int.from_bytes(data, "little"), sub.end)
        w.put(0, 1)
        index = np.searchsorted(table, pixels[i]).reshape(-1, widths[i])
        bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        if bundle:
            each, depth = 1 << bundle, 8 >> bundle
            index = np.pad(index, ((0, 0), (0, -widths[i] % each))).reshape(len(index), -1, each)
            index = (index << (np.arange(each) * depth)).sum(axis=-1)
        widths[i] = index.shape[1]
        pixels[i] = np.uint32(255 << 24) | index.astype(np.uint32).ravel() << np.uint32(8)
