import hashlib
import html
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import html_text as ht
from segmill.llm import nearest as nn
from segmill.llm import webp
from segmill.llm import webp_write as ww
from segmill.llm.chat import Template, digests, format_chats, read_back

RNG = np.random.default_rng(0)


# A test's own encoder: every part of the format, one at a time.


def lengths_for(counts, size):
    """Code lengths of a complete prefix code for the symbols that occur."""
    import heapq

    used = [(n, s) for s, n in enumerate(counts) if n]
    out = [0] * size
    if len(used) == 1:
        out[used[0][1]] = 1
        return out
    heap = [(n, i, (s,)) for i, (n, s) in enumerate(used)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    return out


class Prefix:
    def __init__(self, w, counts, size):
        used = [s for s, n in enumerate(counts) if n]
        self.codes = {}
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            w.put(1, 1)
            w.put(len(used) - 1, 1)
            w.put(1, 1)
            for s in used:
                w.put(s, 8)
            self.codes = {s: (i, 1) for i, s in enumerate(used)} if len(used) == 2 else {used[0]: (0, 0)}
            return
        lengths = lengths_for(counts, size)
        assert max(lengths) <= 15
        w.put(0, 1)
        # Lengths one by one, with a flat code of 4 bits over 0 .. 15.
        w.put(15, 4)
        for s in webp.LENGTH_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for n in lengths:
            w.put(int(f"{n:04b}"[::-1], 2), 4)
        code = last = 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            self.codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code += 1
        if len([1 for n in lengths if n]) == 1:
            self.codes = {s: (0, 0) for s in self.codes}

    def write(self, w, s):
        w.put(*self.codes[s])


def amount_code(v):
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    extra = top - 1
    return 2 * top + second, v - ((2 + second) << extra), extra


def entropy_image(w, tokens, main=False, cache_bits=0, groups=None):
    """tokens: ('p', argb), ('b', length, distance code) or ('c', index); with groups a (prefix bits, image, token's group) triple."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n_groups = 1
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(groups[0] - 2, 3)
            entropy_image(w, [("p", 0xFF000000 | g << 8) for g in groups[1]])
            n_groups = max(groups[1]) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(n_groups)]
    group = [groups[2][i] if groups else 0 for i in range(len(tokens))]
    for g, t in zip(group, tokens):
        c = counts[g]
        if t[0] == "p":
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k][t[1] >> shift & 255] += 1
        elif t[0] == "b":
            c[0][256 + amount_code(t[1])[0]] += 1
            c[4][amount_code(t[2])[0]] += 1
        else:
            c[0][280 + t[1]] += 1
    codes = [[Prefix(w, c, n) for c, n in zip(cs, sizes)] for cs in counts]
    for g, t in zip(group, tokens):
        k = codes[g]
        if t[0] == "p":
            for j, shift in enumerate((8, 16, 0, 24)):
                k[j].write(w, t[1] >> shift & 255)
        elif t[0] == "b":
            for base, code, v in ((256, k[0], t[1]), (0, k[4], t[2])):
                s, extra, bits = amount_code(v)
                code.write(w, base + s)
                w.put(extra, bits)
        else:
            k[0].write(w, 280 + t[1])


def argb(px):
    return [(int(a) << 24) | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in px.reshape(-1, 4)]


def stream(width, height, body, transforms=()):
    w = ww.header(width, height)
    for t in transforms:
        w.put(1, 1)
        t(w)
    w.put(0, 1)
    body(w)
    return ww.container(w.bytes())


def image(h=7, w=9, colours=None):
    px = RNG.integers(0, 256, (h, w, 4)) if colours is None else np.array(colours)[RNG.integers(0, len(colours), (h, w))]
    return px.astype(np.int64)


def check(media, want):
    assert (webp.decode(media)[0].astype(int) == want).all()


def test_prefix_codes():
    px = image(11, 13)
    check(stream(13, 11, lambda w: entropy_image(w, [("p", v) for v in argb(px)], main=True)), px)


def test_back_references_and_cache():
    px = np.tile(image(1, 5), (4, 1, 1))
    flat = argb(px)
    # The row above has distance code 1; further ones lie 120 above their distance.
    body = [("p", v) for v in flat[:5]] + [("b", 5, 1), ("b", 10, 10 + 120)]
    check(stream(5, 4, lambda w: entropy_image(w, body, main=True)), px)
    index = (webp.CACHE_HASH * flat[3] & 0xFFFFFFFF) >> (32 - 6)
    four = np.concatenate([px[0], px[0][3:4]]).reshape(1, 6, 4)
    check(stream(6, 1, lambda w: entropy_image(w, [("p", v) for v in flat[:5]] + [("c", index)], main=True, cache_bits=6)), four)


def test_groups():
    px = image(4, 8)
    which = [0, 1]
    group = [which[(i % 8) >> 2] for i in range(32)]
    check(stream(8, 4, lambda w: entropy_image(w, [("p", v) for v in argb(px)], main=True, groups=(2, which, group))), px)


def test_subtract_green_and_cross_colour():
    px = image()
    coded = px.copy()
    coded[..., 1] = (px[..., 1] - px[..., 2]) & 255
    coded[..., 3] = (px[..., 3] - px[..., 2]) & 255
    check(stream(9, 7, lambda w: entropy_image(w, [("p", v) for v in argb(coded)], main=True), [lambda w: w.put(2, 2)]), px)
    s8 = lambda v: (int(v) & 255 ^ 128) - 128
    tiles = [(int(a) << 16) | int(b) << 8 | int(c) for a, b, c in RNG.integers(0, 256, (6, 3))]
    coded = px.copy()
    for y in range(7):
        for x in range(9):
            t = tiles[(y >> 2) * 3 + (x >> 2)]
            g, r = s8(px[y, x, 2]), s8(px[y, x, 1])
            coded[y, x, 1] = (px[y, x, 1] - (s8(t) * g >> 5)) & 255
            coded[y, x, 3] = (px[y, x, 3] - (s8(t >> 8) * g >> 5) - (s8(t >> 16) * r >> 5)) & 255

    def transform(w):
        w.put(1, 2)
        w.put(0, 3)
        entropy_image(w, [("p", 0xFF000000 | t) for t in tiles])

    check(stream(9, 7, lambda w: entropy_image(w, [("p", v) for v in argb(coded)], main=True), [transform]), px)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = image(6, 7)
    half = lambda a, b: (a + b) >> 1

    def predicted(y, x):
        if not x and not y:
            return np.array([255, 0, 0, 0])
        if not y:
            return px[y, x - 1]
        if not x:
            return px[y - 1, x]
        L, T, TL = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
        TR = px[y - 1, x + 1] if x < 6 else px[y, 0]
        if mode == 11:
            return L if abs(T - TL).sum() < abs(L - TL).sum() else T
        if mode == 12:
            return np.clip(L + T - TL, 0, 255)
        if mode == 13:
            a = half(L, T)
            return np.array([min(255, max(0, int(v) + int((int(v) - int(t)) / 2))) for v, t in zip(a, TL)])
        return [np.array([255, 0, 0, 0]), L, T, TR, TL, half(half(L, TR), T), half(L, TL), half(L, T), half(TL, T), half(T, TR), half(half(L, TL), half(T, TR))][mode]

    coded = np.array([[(px[y, x] - predicted(y, x)) & 255 for x in range(7)] for y in range(6)])

    def transform(w):
        w.put(0, 2)
        w.put(0, 3)
        entropy_image(w, [("p", 0xFF000000 | mode << 8)] * 4)

    check(stream(7, 6, lambda w: entropy_image(w, [("p", v) for v in argb(coded)], main=True), [transform]), px)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 40])
def test_palettes(n):
    table = RNG.integers(0, 256, (n, 4))
    at = RNG.integers(0, n, (5, 11))
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    depth = 8 // per
    packed = [sum(int(at[y, x + k]) << (k * depth) for k in range(per) if x + k < 11) for y in range(5) for x in range(0, 11, per)]

    def transform(w):
        w.put(3, 2)
        w.put(n - 1, 8)
        delta = np.diff(np.vstack([np.zeros((1, 4), dtype=int), table]), axis=0) & 255
        entropy_image(w, [("p", v) for v in argb(delta)])

    check(stream(11, 5, lambda w: entropy_image(w, [("p", 0xFF000000 | v << 8) for v in packed], main=True), [transform]), table[at])


def test_bad_media():
    good = webp.store(b"\x07" * 576)
    for bad in (b"RIFX" + good[4:], good[:40], b"RIFF\x10\0\0\0WEBPVP8 \x04\0\0\0abcd"):
        with pytest.raises((ValueError, IndexError)):
            if not webp.decode(bad):
                raise ValueError


def test_payloads(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "long " * 40000, "dup", "dup"]
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)] + [(None, "q", b"m")], "doc_id long, text string, media binary")
    stored = webp.store_texts(docs)
    got = {r.doc_id: r for r in webp.read_media(stored).collect()}
    media = {r.doc_id: r.media for r in stored.collect()}
    for i, t in [*enumerate(texts), (None, "q")]:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert b"".join(im[..., 1:].tobytes() for im in webp.decode(media[i])) == pay
    assert got[7][1:] == got[8][1:]
    px = webp.pixels(stored.filter("doc_id = 5")).first()
    assert (px.width, px.height, len(px.rgb)) == (192, 2, 1152)
    assert webp.read_media(webp.store_texts(docs.limit(0))).collect() == []


def test_tall_payload_takes_several_files():
    pay = bytes(RNG.integers(0, 256, 576, dtype=np.uint8)) * (webp.MOST_ROWS + 3)
    media = webp.store(pay)
    assert len(webp.decode(media)) == 2 and webp.load(media).tobytes() == pay


# Pages


def test_held_out_pages():
    odds, trees = ht.train()
    rng = np.random.default_rng(4321)
    good = 0
    for _ in range(150):
        source, truth = ht._page(rng)
        good += ht.extract([source], odds, trees)[0] == "\n".join(" ".join(html.unescape(t).split()) for t in truth)
    assert good >= 145


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Site name</a><nav><ul><li><a href=/a>Menu</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p>First   part<br>goes&nbsp;on &lt;here&gt;. <b>Bold</b> and <a href=x>link</a>.<p>Second<!-- no --> one, unclosed
<div class="ad">Buy now</div><ul><li>one</li><li>two</ul></article><aside class="sidebar"><p>Other things to read here.</p></aside>
<div id="comments"><div class="comment"><p>I think this is wrong. Very wrong.</p></div></div><form><p>Sign up</p><input></form><footer>&copy; me</footer></body></html>"""


def test_page_and_edges(spark):
    rows = [(1, "u", PAGE, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", PAGE[: PAGE.index("Second") + 3], "c"), (None, "u", "plain < text & more", "c"), (1, "u", PAGE, "c"), (6, "u", "<p" * 3000, "c"), (7, "u", "<div>" * 5000 + "deep", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & line\nFirst part goes on <here>. Bold and link.\nSecond one, unclosed\none\ntwo"
    assert by[4].text.endswith("\nSec") and by[4].text.startswith("Head & line\n")
    assert by[2].text == by[3].text == "" and by[2].url is None and all(r.n_chars == len(r.text) for r in got)
    assert ht.main_text(pages.limit(0)).collect() == []


def test_decoding_is_hierarchical():
    page = ht.Page("<div><section><p>a</p><p>b</p></section><aside><p>c</p></aside></div>")
    kept = ht.decode(page, [0.0, 1.0, -5.0, 4.0, 4.0, -1.0, 0.5])
    for k in range(1, len(kept)):
        assert not kept[k] or kept[page.parents[k]]
    assert kept == [True, True, True, True, True, False, False]


# Chats


TURNS = [
    (1, 0, "system", "be\\nice"), (1, 1, "user", "### User: </turn>\n\\h \\\\e ####"), (1, 2, "assistant", "\\### Assistant: </turn> ok\\"), (1, 3, "user", ""), (1, 4, "assistant", "ünïcode 😀"),
    (2, 0, "assistant", "first"), (3, 0, "user", None), (3, None, None, "null role"), (4, 0, "od:d: role\\c", "x"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", "nobody"),
    (5, 0, "user", "long " * 20000), (5, 1, "assistant", "</turn>" * 3000 + "#" * 5000), (6, 0, "User", "case"), (6, 1, "=user", "eq"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, 1, "s") for t in TURNS], "conv_id long, turn long, role string, text string, at int, loss string")
    chats = format_chats(rows).cache()
    got = {r.conv_id: r for r in digests(chats).collect()}
    back = {r.conv_id: r for r in read_back(chats).collect()}
    full = {r.conv_id: r for r in chats.collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for c in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == c), key=order)
        said = [(t[2] or "", t[3] or "") for t in mine]
        loss = "".join(x for role, x in said if role == "assistant")
        assert [(t.role, t.text) for t in back[c].turns] == said
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(full[c].formatted) == sum(len(s.text) for s in full[c].segments)
        masked = "".join(full[c].formatted[m.start : m.start + m.length] for m in full[c].loss_mask)
        assert masked == "".join(s.text for s in full[c].segments if s.loss)
    assert {c: (full[c].valid, full[c].error_turn) for c in (1, 2, 3, 5)} == {1: (True, None), 2: (False, 0), 3: (False, 0), 5: (True, None)}
    assert digests(format_chats(rows.limit(0))).collect() == []
    plan = chats._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Template().labels["user"] == "User"


# Neighbours


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(v).tolist())), np.array(np.float32(v), dtype=float))
    out = []
    for (q, _), a in good.items():
        if q % 100 == 0:
            c = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for (i, _), b in good.items() if i != q and len(b) == len(a))
            out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(c[:k])]
    return sorted(out)


def test_nearest_equals_brute_force(spark):
    v = RNG.standard_normal((500, 16)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(500)]
    rows += [(1000 + i, v[7].tolist()) for i in range(120)] + [(700, v[7].tolist()), (800, (v[3] * 1e-3).tolist()), (801, (v[3] * 1e3).tolist())]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (None, v[0].tolist()), (100, v[100].tolist()), (600, [1.0, 2.0]), (601, [1.0, 2.5]), (905, [float("inf")] * 16), (5, v[9].tolist())]
    frame = spark.createDataFrame([(i, x, 3, 4) for i, x in rows], "vec_id long, embedding array<float>, dim int, block int")
    for block, group in ((4096, 4096), (64, 2)):
        got = nn.nearest(frame, F.col("vec_id") % 100 == 0, 10, block, group).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == brute(rows, 10)
    assert nn.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_quantised_bounds_hold():
    x, y = RNG.standard_normal((50, 64)), RNG.standard_normal((20, 64)) * 100
    qx, sx, nx, ex = nn.quantise(x)
    qy, sy, ny, ey = nn.quantise(y)
    dot = nn.tile_product(qy, qx) * (sy[:, None] * sx[None])
    slack = ny[:, None] * ex + ey[:, None] * nx + ey[:, None] * ex
    assert (np.abs(dot - y @ x.T) <= slack + 1e-9).all() and qx.dtype == np.int8


def test_text_below_the_root_counts_if_nothing_else_does():
    odds, trees = ht.train()
    bare = "<html><body>First line of <b>the story</b>.<br>Second &amp; last.<nav><a href=/>Menu</a></nav></body></html>"
    full = "Stray words" + PAGE
    assert ht.extract([bare, "", "<body></body>"], odds, trees) == ["First line of the story. Second & last.", "", ""]
    # Beside an article such text is a block like others: kept or not, it changes nothing about the article.
    assert ht.extract([full], odds, trees)[0].endswith(ht.extract([PAGE], odds, trees)[0]) and ht.extract([PAGE], odds, trees) != [""]
