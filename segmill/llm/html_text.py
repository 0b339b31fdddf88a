"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of block elements with runs of text. Each block has features of its subtree's
text and link density, its attributes' tokens and its ancestors', its depth and its
siblings. Gradient-boosted trees give the probability that a block belongs to the article or
holds parts of it; they are trained here, on pages that a seeded generator composes from
common layouts, with the article known. Decoding chooses the likeliest set of blocks in which
no block is kept below one that isn't.

Text right below the root or body is a block of its own, from one block tag to the next.

Defined results: a null or empty page and one without article have an empty text (null ids and urls stay), but
text right below the root or body is taken where nothing else is; a page cut off in the middle is read as far as it goes;
very long pages are read whole, in time that grows with their length; repeated rows give a row each, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label output ruby rt rp math mi mn mo mrow msup msub mfrac msqrt object video audio canvas picture button select option optgroup textarea datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes svg".split())
#: These never hold a page's text.
UNSEEN = frozenset(("head", "title", "textarea", "select", "button", "datalist"))
CONTROLS = frozenset("input textarea select button option label".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag on the left ends an open element on the right, up to the named borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}


class Page:
    """Block elements in page order (0 is the root) and runs of text."""

    __slots__ = ("tags", "parents", "depths", "tokens", "links", "inner", "controls", "runs")

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.tokens = ["#root"], [-1], [0], [()]
        self.links, self.inner, self.controls = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("#root", 0)]
        text: list[str] = []
        at, links, unseen = 0, 0, 0

        def flush() -> None:
            if text:
                joined = " ".join("".join(text).split())
                text.clear()
                if joined:
                    if not stack[-1][1]:
                        # What root gathered since the last block is this run's.
                        self.tags.append("#text")
                        self.parents.append(0)
                        self.depths.append(1)
                        self.tokens.append(("#text",))
                        for x in (self.links, self.inner, self.controls):
                            x.append(x[0])
                    self.runs.append((stack[-1][1] or len(self.tags) - 1, joined))
            if not stack[-1][1]:
                self.links[0] = self.inner[0] = self.controls[0] = 0

        def pop(k: int) -> None:
            nonlocal links, unseen
            for tag, _ in stack[k:]:
                links -= tag == "a"
                unseen -= tag in UNSEEN
            if any(tag not in INLINE for tag, _ in stack[k:]):
                flush()
            del stack[k:]

        find = TOKEN.finditer
        skip_to = 0
        for m in find(source):
            if m.start() < skip_to:
                continue
            if m.start() > at and not unseen:
                part = html.unescape(source[at : m.start()])
                text.append(part)
                if links:
                    self.links[stack[-1][1]] += len(part.strip())
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            self.inner[stack[-1][1]] += 1
            if tag in CONTROLS:
                self.controls[stack[-1][1]] += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at) if not m[3].endswith("/") else None
                if end:
                    at = skip_to = end.end()
                elif tag in ("script", "style"):
                    at = skip_to = len(source)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in ("td", "th", "table", "button"):
                        break
            if tag in ENDS:
                ends, borders = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in borders:
                        break
                    if stack[k][0] in ends:
                        pop(k)
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in ("html", "body"):
                pop(1)
                continue
            if tag in INLINE:
                links += tag == "a"
                unseen += tag in UNSEEN
                stack.append((tag, stack[-1][1]))
                continue
            flush()
            parent = stack[-1][1]
            found = [tag]
            if m[3]:
                for a in ATTRIBUTE.finditer(m[3]):
                    # A name of several pieces stays together.
                    found += [tuple(x.lower() for x in PIECE.findall(name)) for name in (a[2] or a[3] or a[4] or "").split()]
            unseen += tag in UNSEEN
            stack.append((tag, len(self.tags)))
            self.tags.append(tag)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.tokens.append(tuple(found))
            for x in (self.links, self.inner, self.controls):
                x.append(0)
        if at < len(source) and not unseen:
            text.append(html.unescape(source[at:]))
        flush()


FEATURES = 22
#: Features of a wide range, taken as logarithms.
_LARGE = (1, 3, 18, 20, 21)


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    n = len(page.tags)
    own, points = [0] * n, [0] * n
    begin, total = [-1] * n, 0
    for k, t in page.runs:
        if begin[k] < 0:
            begin[k] = total
        own[k] += len(t)
        points[k] += t.count(".") + t.count(",")
        total += len(t)
    parents = page.parents
    chars, links, inner, controls = own[:], page.links[:], page.inner[:], page.controls[:]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        chars[p] += chars[k]
        links[p] += links[k]
        inner[p] += inner[k]
        controls[p] += controls[k]
        points[p] += points[k]
        if begin[k] >= 0 and (begin[p] < 0 or begin[k] < begin[p]):
            begin[p] = begin[k]
        children[p].append(k)
    low, high = [0.0] * n, [0.0] * n
    rows = [[0.0] * FEATURES]
    place, kin = [0] * n, [0] * n
    for c in children:
        c.reverse()
        same: dict[str, int] = defaultdict(int)
        for i, k in enumerate(c):
            place[k] = i
            same[page.tags[k]] += 1
        for k in c:
            kin[k] = same[page.tags[k]]
    get = odds.get
    for k in range(1, n):
        p = parents[k]
        # A name counts by the mean of its pieces.
        own_odds = [sum(get(t, 0.0) for t in name) / len(name) for name in page.tokens[k][1:] if name] or [0.0]
        tag = get("<" + page.tags[k], 0.0)
        lo, hi = min(own_odds), max(own_odds)
        low[k], high[k] = min(low[p], lo, tag), max(high[p], hi, tag)
        size, many = chars[k], len(children[p])
        # The siblings before and behind; none counts as an empty one.
        a, b = children[p][place[k] - 1] if place[k] else 0, children[p][place[k] + 1] if place[k] + 1 < many else 0
        rows.append([
            page.depths[k], size, links[k] / size if size else 0.0, size / (1 + inner[k]), size / total if total else 0.0,
            own[k] / size if size else 0.0, begin[k] / total if total and begin[k] >= 0 else 1.0, place[k], many, kin[k],
            lo, hi, sum(own_odds), low[p], high[p], tag, points[k] / size if size else 0.0, controls[k],
            chars[p] / many, get("<" + page.tags[p], 0.0), chars[a] if a else 0, chars[b] if b else 0,
        ])
    x = np.array(rows, dtype=np.float32)
    x[:, _LARGE] = np.log1p(x[:, _LARGE])
    return x


@dataclass
class Trees:
    """Complete trees of one depth: a split's feature and threshold, and the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; every tree finds its splits on half of the rows, at random."""
    rng = np.random.default_rng(0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    splits = 2**depth - 1
    feature, threshold, leaves = [], [], []
    margin = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(x), dtype=np.int64)
        f, t = np.zeros(splits, dtype=np.int64), np.full(splits, np.inf, dtype=np.float32)
        some = np.flatnonzero(rng.random(len(x)) < 1 / 2)
        few, fg, fh = binned[some].T.copy(), g[some], h[some]
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            node_key = (at[some] - first) * bins
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node_key + few[j]
                gs = np.bincount(key, fg, count * bins).reshape(count, bins).cumsum(axis=1)
                hs = np.bincount(key, fh, count * bins).reshape(count, bins).cumsum(axis=1)
                gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain = gain[:, : len(c)]
                k = gain.argmax(axis=1)
                for node in range(count):
                    if gain[node, k[node]] > best[node] + 1e-6:
                        best[node], f[first + node], t[first + node] = gain[node, k[node]], j, c[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        at -= splits
        leaf = rate * np.bincount(at, g, splits + 1) / (np.bincount(at, h, splits + 1) + ridge)
        margin += leaf[at]
        feature.append(f)
        threshold.append(t)
        leaves.append(leaf)
    return Trees(np.array(feature), np.array(threshold), np.array(leaves), depth)


def decode(page: Page, margin: list[float]) -> list[bool]:
    """The likeliest set of kept blocks in which no kept block has a dropped ancestor."""
    n = len(page.tags)
    keep, drop = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        # Log-probabilities, up to what they share.
        keep[k] += margin[k]
        p = page.parents[k]
        keep[p] += max(keep[k], drop[k])
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parents[k]] and keep[k] > drop[k]
    return kept


# Training pages


@functools.lru_cache(maxsize=1)
def _words(n: int = 30_000) -> list[str]:
    """Words of one to three syllables."""
    rng = np.random.default_rng(1)
    syllables = "ba ke lo mi nu ra se to vi za el or an ist ung tion que ment ado ing".split()
    return ["".join(syllables[j] for j in js[:k]) for js, k in zip(rng.integers(len(syllables), size=(n, 3)).tolist(), rng.integers(1, 4, n).tolist())]


def _page(rng: np.random.Generator, kinds: list[str] | None = None, mixed: bool = True) -> tuple[str, list[str]]:
    """A page and its article's blocks; ``kinds`` names the kinds of article to choose from (all by default).

    ``mixed`` pages also have lists of other kinds, larger tables, articles of one such part, controls inside lines, and names that mislead.
    """
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    pool = _words()
    word = lambda: pick(pool)

    def phrase(a: int, b: int) -> str:
        """Words from anywhere in the pool on."""
        n, at = rng.integers((a, 0), (b, len(pool) - 20)).tolist()
        return " ".join(pool[at : at + n])

    chance = lambda p: rng.random() < p
    sentence = lambda: phrase(3, 20).capitalize() + pick([".", ".", ".", "!", "?", "", "***", "%%%"])
    prose = lambda a, b: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    truth: list[str] = []

    def attr(*names: str) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(names)}"' if chance(0.9) else ""

    def said(tag: str, text: str, a: str = "") -> str:
        truth.append(text)
        if mixed and chance(0.01):
            # A control inside its line is left out of it.
            return f"<{tag}{a}>{text} {control()}</{tag}>"
        inner = text if chance(0.8) else re.sub(r"^(\S+)", r"<b>\1</b>", text) if chance(0.5) else re.sub(r"(\S+)$", r'<a href="/x">\1</a>', text)
        return f"<{tag}{a}>{inner}</{tag}>"

    def links(n: int, tag: str = "ul", a: str = "") -> str:
        return f"<{tag}{a}>" + "".join(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>' for _ in range(n)) + f"</{tag}>"

    def menu() -> str:
        n = int(rng.integers(2, 12))
        return pick([f"<nav>{links(n)}</nav>", f"<div{attr('menu', 'nav', 'navbar', 'main-menu', 'navigation', 'breadcrumb', 'breadcrumbs', 'topnav')}>{links(n)}</div>", links(n, a=' class="menu"'), f'<div role="navigation">{links(n)}</div>'])

    def advert() -> str:
        return f"<{(t := pick(['div', 'div', 'aside', 'section']))} class=\"{pick(['ad', 'ads', 'advert', 'ad-box', 'banner', 'sponsor', 'sponsored', 'promo', 'advertisement', 'ad-slot'])}\">{pick(['', '<p>'])}{prose(1, 4)}</{t}>"

    def notice() -> str:
        return f"<div{pick([' class=', ' id='])}\"{pick(['cookie', 'cookie-banner', 'notice', 'gdpr', 'alert', 'consent', 'newsletter', 'popup', 'modal', 'subscribe'])}\"><p>{prose(1, 4)}</p><button>{word()}</button></div>"

    def form() -> str:
        return f"<form{attr('search', 'login', 'signup', 'newsletter-form')}><label>{phrase(1, 4)}</label><input type=text>{pick(['', f'<p>{sentence()}</p>'])}<button>{word()}</button></form>"

    def control() -> str:
        return pick(["<button>", "<button type=button>"]) + word() + "</button>"

    def misled() -> str:
        """A name that speaks of what the page has beside the article, or of a part of it."""
        part = pick("comments sidebar header footer menu nav ads share related banner widget comment breadcrumb newsletter social tools".split())
        return pick([f"{pick(['has', 'no', 'with', 'without', 'hide', 'show', 'is'])}-{part}", f"{part}-{pick(['off', 'on', 'closed', 'open', 'hidden', 'left', 'enabled'])}", f"{pick(['post', 'article', 'content', 'entry', 'page'])}-{part}-{word()}"])

    def share() -> str:
        return pick([links(3, a=f' class="{pick(["share", "social", "sharing", "tags", "social-links"])}"'), f'<div class="{pick(["share", "social", "byline-share", "tools"])}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>'])

    def sidebar() -> str:
        inner = f"<h3>{phrase(1, 4)}</h3>" + pick([links(5), f"<p>{prose(1, 5)}</p>", links(3) + f"<p>{prose(1, 3)}</p>"])
        return pick([f"<aside{attr('sidebar', 'widget', 'right')}>{inner}</aside>", f'<div class="{pick(["sidebar", "widget", "side", "rail", "related", "recommended", "more-stories"])}">{inner}</div>', f"<aside>{inner}</aside>"])

    def comments() -> str:
        each = "".join(f'<{(t := pick(["div", "li", "article"]))} class="{pick(["comment", "reply", "comment-body"])}"><p>{pick(["", "<b>" + word() + "</b> "])}{prose(1, 5)}</p></{t}>' for _ in range(int(rng.integers(1, 8))))
        return f'<{(t := pick(["div", "section", "ol", "ul"]))} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "responses", "disqus", "replies"])}"><h3>{phrase(1, 3)}</h3>{each}</{t}>'

    def head() -> str:
        inner = pick(["", f"<h1>{phrase(1, 4)}</h1>", f'<a href="/">{phrase(1, 3)}</a>']) + pick(["", f"<p>{sentence()}</p>"]) + pick(["", menu()])
        return pick([f"<header{attr('header', 'site-header')}>{inner}</header>", f'<div {pick(["class", "id"])}="{pick(["header", "masthead", "site-header", "top", "topbar", "branding"])}">{inner}</div>'])

    def foot() -> str:
        inner = f"&copy; {phrase(1, 4)} &middot; {prose(1, 4)}" + pick(["", links(4), f"<p>{prose(1, 3)}</p>"])
        return pick([f"<footer>{inner}</footer>", f"<footer{attr('footer')}>{inner}</footer>", f'<div {pick(["class", "id"])}="{pick(["footer", "site-footer", "copyright", "bottom", "colophon"])}">{inner}</div>'])

    def loose() -> str:
        """Text without a block of its own, lines apart by breaks."""
        text = prose(1, 6)
        truth.append(text)
        return pick([text, text.replace(". ", ".<br>"), f"<b>{text}</b>", f"<span>{text}</span>", re.sub(r"(\S+)$", r'<a href="/x">\1</a>', text)])

    def article() -> str:
        parts = []
        # Pages by hand have no container, one without a name, or one whose name says nothing.
        kind = pick(kinds or [*["named"] * 8, "bare", "bare", "plain", "plain", "odd", "odd", "loose", "loose", "loose"])
        if kind == "loose":
            for _ in range(int(rng.integers(1, 5))):
                parts.append(loose())
                if chance(0.5):
                    parts.append(said(pick(["h2", "h3", "p"]), prose(1, 3)))
                else:
                    parts.append(said("h2", phrase(1, 5)) if chance(0.25) else pick(["<hr>", "<p></p>", "<div></div>"]))
            body = "".join(parts)
            return pick([body, f"<div>{body}</div>", f"<main>{body}</main>", f"<center>{body}</center>"])
        if chance(0.8):
            parts.append(pick([lambda: said("h1", phrase(1, 12)), lambda: "<header>" + said("h1", phrase(1, 12)) + "</header>"])())
        # An article may be a list, a table or a few lines from end to end.
        only = pick([0.78, 0.79, 0.81, 0.87, 0.885]) if mixed and chance(0.08) else 0.0
        for _ in range(1 if only and chance(0.6) else int(rng.integers(1, 16))):
            r = only or rng.random()
            if r < 0.6:
                parts.append(said("p", prose(1, pick([2, 2, 8, 12]))))
            elif r < 0.7:
                text = prose(1, 3)
                truth.append(text)
                parts.append(f"<p><b>{text}<br>")
            elif r < 0.76:
                parts.append(said(pick(["h2", "h3"]), phrase(1, 8)))
            elif r < 0.82 and not mixed:
                parts.append("<ul>" + "".join(said("li", phrase(2, 15)) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif r < 0.80:
                item = pick([lambda: phrase(1, 4), lambda: phrase(2, 15), lambda: prose(1, 3)])
                wrapped = chance(0.2)
                each = "".join("<li>" + said("p", item()) + "</li>" if wrapped else said("li", item()) for _ in range(int(rng.integers(2, 8))))
                parts.append(f"<{(t := pick(['ul', 'ol', 'ol']))}>{each}</{t}>")
            elif r < 0.82:
                parts.append("<dl>" + "".join(said("dt", phrase(1, 5)) + said("dd", prose(1, 3)) for _ in range(int(rng.integers(2, 5)))) + "</dl>")
            elif r < 0.86:
                parts.append("<blockquote>" + said("p", prose(1, 4)) + "</blockquote>")
            elif r < 0.89 and not mixed:
                parts.append("<table><tr>" + "".join(said("td", phrase(1, 5)) for _ in range(4)) + "</tr></table>")
            elif r < 0.88:
                parts.append("<table>" + "".join("<tr>" + "".join(said(pick(["td", "td", "th"]), phrase(1, 5)) for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>")
            elif r < 0.89:
                parts.append(f'<div class="{pick([misled(), "header-block", "post-header", "entry-header", "article-header", "intro", "lead"])}">' + said("p", prose(1, 6)) + said("p", prose(1, 4)) + "</div>")
            elif r < 0.91:
                parts.append("<figure><img src=x>" + said("figcaption", sentence()) + "</figure>")
            elif r < 0.93:
                parts.append(said("pre", phrase(3, 20)))
            elif r < 0.95:
                parts.append("<section>" + said("h2", phrase(1, 5)) + said("p", prose(1, 6)) + "</section>")
            elif r < 0.97:
                parts.append(advert())
            elif r < 0.985:
                parts.append(share())
            else:
                parts.append(pick([sidebar, form])())
        inner = "".join(parts)
        if kind != "named":
            name = "" if kind == "plain" else f' class="{word()}-{word()}"' if chance(0.5) else f' id="{word()}"'
            inner = inner if kind == "bare" else f"<div{name}>{inner}</div>"
            return inner if chance(0.7) or kind == "bare" else f"<div>{inner}</div>"
        more = f" {misled()}" if mixed and chance(0.2) else ""
        if chance(0.6):
            name = attr("post", "article", "story", "entry", "h-entry") if chance(0.4) else ""
            inner = f"<article{name[:-1] + more + name[-1:] if name else f' class={chr(34)}{more.strip()}{chr(34)}' if more else ''}>{inner}</article>"
        else:
            inner = f"<{(t := pick(['div', 'div', 'section']))} {pick(['class', 'class', 'id'])}=\"{pick(['content', 'post', 'entry-content', 'article-body', 'story', 'main-text', 'post-content', 'body-text', 'article', 'text'])}{more}\">{inner}</{t}>"
        if chance(0.3):
            inner = f"<main{f' class={chr(34)}{misled()}{chr(34)}' if mixed and chance(0.25) else ''}>{inner}</main>"
        return inner

    before = [f() for f in (menu, head, advert, notice, form, share) if chance(0.45)]
    after = [f() for f in (foot, comments, sidebar, advert, share, notice, form, menu) if chance(0.4)]
    if chance(0.7):
        after.append(foot())
    rng.shuffle(before)
    furnished = chance(0.8)
    if not furnished:
        before, after = [], []
    middle = [article()] if chance(0.96) or not furnished else []
    if chance(0.2):
        middle = [f'<div class="{pick(["wrapper", "container", "page", "row", "columns"])}{" " + misled() if mixed and chance(0.3) else ""}">', *middle, *([sidebar()] if chance(0.5) else []), "</div>"]
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join([*before, *middle, *after]) + "</body></html>", truth


@functools.lru_cache(maxsize=2)
def train(pages: int = 1600, seed: int = 7) -> tuple[dict[str, float], Trees]:
    """Tokens' log-odds and the trees, from generated pages."""
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        source, truth = _page(rng, mixed=rng.random() < 0.5)
        page, wanted = Page(source), 0
        good = [False] * len(page.tags)
        for k, t in page.runs:
            if wanted < len(truth) and t == " ".join(html.unescape(truth[wanted]).split()):
                wanted += 1
                while k >= 0 and not good[k]:
                    good[k] = True
                    k = page.parents[k]
        if wanted == len(truth):
            made.append((page, good))
    yes: dict[str, float] = defaultdict(float)
    no: dict[str, float] = defaultdict(float)
    for page, good in made:
        for k in range(1, len(page.tags)):
            for t in {"<" + page.tags[k], *(t for name in page.tokens[k][1:] for t in name)}:
                (yes if good[k] else no)[t] += 1
    odds = {t: float(np.log((yes[t] + 1) / (no[t] + 1))) for t in sorted({*yes, *no})}
    # Some pages lose names of what is kept at random, so that no good name is needed.
    for page, good in made:
        if rng.random() < 0.3:
            page.tokens = [t[:1] if g and rng.random() < 0.6 else t for t, g in zip(page.tokens, good)]
    x = np.concatenate([features(p, odds)[1:] for p, _ in made])
    y = np.concatenate([np.array(g[1:], dtype=float) for _, g in made])
    return odds, boost(x, y)


def extract(sources: list[str], odds: dict[str, float], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    tables = [features(p, odds) for p in pages]
    margin = trees.margin(np.concatenate(tables)).tolist()
    out, at = [], 0
    for page, table in zip(pages, tables):
        kept = decode(page, margin[at : at + len(table)])
        at += len(table)
        # Text right below the root counts in any case if nothing else does.
        runs = [t for k, t in page.runs if kept[k]] or [t for k, t in page.runs if page.tags[k] == "#text"]
        out.append("\n".join(runs))
    return out


def _batches(batches: Iterator[pa.RecordBatch], odds: dict[str, float], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = extract([s or "" for s in part.column("html").to_pylist()], odds, trees)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def main_text(pages: DataFrame, training_pages: int = 1600, seed: int = 7) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    odds, trees = train(training_pages, seed)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(lambda b: _batches(b, odds, trees), "page_id long, url string, text string, n_chars long")
