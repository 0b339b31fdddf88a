"""Pages written by hand: lists, definitions, tables, misleading names, controls inside lines; alone and among a site's furniture."""

import pytest

from segmill.llm import html_text as ht

LINES = [
    "The first thing to know is that the river floods in spring.", "Second, boats are kept on the northern bank, where the ground is higher.",
    "Third, nobody builds below the old mark on the church wall.", "A fourth rule, seldom written down, is to help whoever asks.",
]
HEAD = "<h1>Life by the river</h1>"
TITLE = "Life by the river\n"
WHOLE = "\n".join(LINES)
PAIRS = "\n".join(y for i, x in enumerate(LINES) for y in (f"Rule {i}", x))
P = "".join(f"<p>{x}</p>" for x in LINES)
OL = "<ol>" + "".join(f"<li>{x}</li>" for x in LINES) + "</ol>"
BODIES = {
    "p": (P, WHOLE), "ol": (OL, WHOLE), "ul": (OL.replace("ol>", "ul>"), WHOLE), "ol of p": ("<ol>" + "".join(f"<li><p>{x}</p></li>" for x in LINES) + "</ol>", WHOLE),
    "dl": ("<dl>" + "".join(f"<dt>Rule {i}</dt><dd>{x}</dd>" for i, x in enumerate(LINES)) + "</dl>", PAIRS),
    "table": ("<table>" + "".join(f"<tr><th>Rule {i}</th><td>{x}</td></tr>" for i, x in enumerate(LINES)) + "</table>", PAIRS),
}
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
SITE = f'<header class="site-header"><a href="/">The Daily Bank</a>{NAV}</header>'
FOOT = "<footer><p>&copy; 2024 The Daily Bank. All rights reserved.</p><ul><li><a href=/p>Privacy</a></li><li><a href=/t>Terms</a></li></ul></footer>"
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten ways to cook an eel</a></li><li><a href=/2>The mayor speaks</a></li></ul></aside>'
COMMENTS = '<section id="comments"><h3>2 comments</h3><div class="comment"><p>I never liked the church wall, to be honest.</p></div><div class="comment"><p>Very true, my uncle says the same.</p></div></section>'
ADVERT = '<div class="ad-box"><p>Buy our boots now, they are dry.</p></div>'
COOKIE = '<div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>'
FORM = '<form class="newsletter-form"><label>Your mail</label><input type=email><button>Subscribe</button></form>'
NAMES = ("post has-comments", "no-sidebar", "content-header-x", "post-with-ads", "article widget-off", "entry hide-footer", "story related-on")


def page(inner, furnished=True, before=SITE, after=SIDE + COMMENTS + FOOT):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{before if furnished else ''}{inner}{after if furnished else ''}</body></html>"


@pytest.fixture(scope="module")
def model():
    return ht.train()


def read(model, source):
    return ht.extract([source], *model)[0]


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("shape", ["<article>{}</article>", '<div id="content">{}</div>'])
@pytest.mark.parametrize("furnished", [True, False])
def test_kinds_of_bodies(model, body, shape, furnished):
    inner, want = BODIES[body]
    assert read(model, page(shape.format(HEAD + inner), furnished)) == TITLE + want


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("shape", ['<article class="{}">{}</article>', '<main class="{}">{}</main>', '<div class="page {}"><article>{}</article></div>'])
@pytest.mark.parametrize("furnished", [True, False])
def test_names_that_mislead(model, name, shape, furnished):
    assert read(model, page(shape.format(name, HEAD + P), furnished)) == TITLE + WHOLE


@pytest.mark.parametrize("source,want", [
    (page('<article class="post has-comments"><p>%s</p><p>%s</p></article>' % tuple(LINES[:2]), False), "\n".join(LINES[:2])),
    (page('<article class="content-header-x"><div class="header-block"><p>%s</p><p>%s</p></div></article>' % tuple(LINES[:2]), False), "\n".join(LINES[:2])),
    (page(f'<article><div class="header-block">{HEAD}<p>{LINES[0]}</p></div><p>{LINES[1]}</p></article>'), TITLE + "\n".join(LINES[:2])),
    (page(f"<article>{HEAD}<p>{LINES[0]}</p>{OL}<p>{LINES[1]}</p></article>", False), "\n".join([TITLE + LINES[0], WHOLE, LINES[1]])),
    (page(f"<article>{HEAD}<p>{LINES[0]}</p>{ADVERT}<p>{LINES[1]}</p></article>"), TITLE + "\n".join(LINES[:2])),
    (page(f"<article>{HEAD}{P}</article>", True, COOKIE + SITE, FORM + FOOT), TITLE + WHOLE),
    (page(f"<article>{HEAD}<p>{LINES[0]} <button>Copy</button> {LINES[1]}</p></article>"), TITLE + " ".join(LINES[:2])),
    (page(f"<article>{HEAD}<p>{LINES[0]} <select><option>a<option>b</select> {LINES[1]}</p></article>"), TITLE + " ".join(LINES[:2])),
    (page(f"<article>{HEAD}<p>{LINES[0]}</p><blockquote><p>{LINES[1]}</p></blockquote><figure><img src=a><figcaption>{LINES[2]}</figcaption></figure></article>"), TITLE + "\n".join(LINES[:3])),
    (page(f"<main>{HEAD}<section><h2>One</h2><p>{LINES[0]}</p></section><section><h2>Two</h2>{OL}</section></main>"), TITLE + "\n".join(["One", LINES[0], "Two", WHOLE])),
    (page(f"<article>{HEAD}<p>{LINES[0]}</p><pre>x = 1\n  y = 2</pre></article>"), TITLE + LINES[0] + "\nx = 1 y = 2"),
    (page(f'<article>{HEAD}<p>See <a href=/a>the church</a> and <a href=/b>its wall</a>, both are old.</p>{P}</article>'), TITLE + "See the church and its wall, both are old.\n" + WHOLE),
    (page(f"<article>{HEAD}<ul><li>{LINES[0]}<ul><li>{LINES[1]}</li><li>{LINES[2]}</li></ul></li></ul></article>"), TITLE + "\n".join(LINES[:3])),
    (page("<article><h1>Notice.</h1><p>Closed.</p></article>"), "Notice.\nClosed."),
    (page("", True, SITE, FOOT), ""),
    (page("", True, SITE + COOKIE, SIDE + FOOT), ""),
    ("plain < text & more", "plain < text & more"),
])
def test_pages(model, source, want):
    assert read(model, source) == want
