"""HTML extraction against plain versions, and on pages of kinds that the training pages don't copy."""

import html
import itertools

import numpy as np
import pytest

from segmill.llm import html_text as ht

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def model():
    return ht.train()


@pytest.mark.parametrize("kind,least", [("named", 0.97), ("bare", 0.93), ("plain", 0.95), ("odd", 0.95), ("loose", 0.93)])
def test_held_out_kinds(model, kind, least):
    rng, good = np.random.default_rng(4242), 0
    for _ in range(100):
        source, truth = ht._page(rng, [kind], mixed=False)
        good += ht.extract([source], *model)[0] == "\n".join(" ".join(html.unescape(t).split()) for t in truth)
    assert good >= 100 * least


@pytest.mark.parametrize("kind", ["named", "bare", "plain", "odd", "loose"])
def test_held_out_kinds_with_harder_parts(model, kind):
    rng, good = np.random.default_rng(4242), 0
    for _ in range(100):
        source, truth = ht._page(rng, [kind])
        good += ht.extract([source], *model)[0] == "\n".join(" ".join(html.unescape(t).split()) for t in truth)
    assert good >= 90


PARAGRAPHS = [f"Paragraph number {i} tells something, and it ends here." for i in range(6)]
P = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
MENU = "<ul class=menu><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul>"
WHOLE = "\n".join(["The head", *PARAGRAPHS])


@pytest.mark.parametrize("source,want", [
    ("<body>Plain words of a page, and more.</body>", "Plain words of a page, and more."),
    ("Only text, no markup.", "Only text, no markup."),
    (f"<body><h1>The head</h1>{P}</body>", WHOLE),
    (f"<h1>The head</h1>{P}", WHOLE),
    (f"<body><div><h1>The head</h1>{P}</div></body>", WHOLE),
    (f'<body><div class="mw-parser-output"><h1>The head</h1>{P}</div></body>', WHOLE),
    (f"<body><x-story><h1>The head</h1>{P}</x-story></body>", WHOLE),
    (f"<html><body>{MENU}<div id=q7><h1>The head</h1>{P}</div><footer>&copy; 2020 Somebody</footer></body></html>", WHOLE),
    (f"<body><table><tr><td>{MENU}</td><td><div><h1>The head</h1>{P}</div></td></tr></table></body>", WHOLE),
    ("<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given, then.</p></body>", "Let x=2 be given, then."),
    ("<body><article><p>Seen in <object data=x>the object's own text</object> here, and so on.</p></article></body>", "Seen in the object's own text here, and so on."),
    (f"<body><article><h1>The head</h1>{P}</article><script>var x = '<p>no</p>';</script><style>p {{}}</style></body>", WHOLE),
])
def test_hand_written_pages(model, source, want):
    assert ht.extract([source], *model)[0] == want


def test_loose_text_beside_paragraphs(model):
    text = ht.extract(["<body><h1>Title</h1>loose text here, quite long and with an end.<p>para one, which ends.</p></body>"], *model)[0]
    assert text == "Title\nloose text here, quite long and with an end.\npara one, which ends."


def test_very_long_page(model):
    source = "<body><article>" + "".join(f"<p>Paragraph number {i}, and more of it.</p>" for i in range(20000)) + "</article></body>"
    text = ht.extract([source], *model)[0]
    assert text.count("\n") == 19999 and text.startswith("Paragraph number 0,") and text.endswith("19999, and more of it.")


def random_page(n):
    page = ht.Page("")
    page.tags, page.parents = ["#root"] + ["div"] * n, [-1] + [int(RNG.integers(0, k + 1)) for k in range(n)]
    return page


def test_decoding_equals_trying_every_set():
    for _ in range(60):
        n = int(RNG.integers(1, 9))
        page, margin = random_page(n), [0.0, *RNG.normal(0, 2, n).tolist()]
        best = max(
            (s for s in itertools.product([False, True], repeat=n) if all(not s[k - 1] or page.parents[k] == 0 or s[page.parents[k] - 1] for k in range(1, n + 1))),
            key=lambda s: sum(m for m, x in zip(margin[1:], s) if x),
        )
        assert ht.decode(page, margin)[1:] == list(best)


def test_trees_equal_walking_them(model):
    _, trees = model
    x = RNG.normal(0, 3, (50, ht.FEATURES)).astype(np.float32)

    def walk(row):
        total = 0.0
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    assert np.allclose(trees.margin(x), [walk(r) for r in x])


def test_features_equal_counting(model):
    odds, _ = model
    for _ in range(20):
        page = ht.Page(ht._page(RNG)[0])
        x = ht.features(page, odds)
        n = len(page.tags)
        under = [{k} for k in range(n)]
        for k in range(n - 1, 0, -1):
            under[page.parents[k]] |= under[k]
        size = [sum(len(t) for o, t in page.runs if o in under[k]) for k in range(n)]
        kids = [[c for c in range(1, n) if page.parents[c] == k] for k in range(n)]
        for k in range(1, n):
            row, brothers = x[k], kids[page.parents[k]]
            i = brothers.index(k)
            assert row[0] == page.depths[k] and np.isclose(row[1], np.log1p(size[k])) and row[7] == i and row[8] == len(brothers)
            assert np.isclose(row[2], sum(page.links[j] for j in under[k]) / size[k] if size[k] else 0.0)
            assert np.isclose(row[3], np.log1p(size[k] / (1 + sum(page.inner[j] for j in under[k]))))
            assert row[9] == sum(page.tags[b] == page.tags[k] for b in brothers)
            assert np.isclose(row[20], np.log1p(size[brothers[i - 1]]) if i else 0.0) and np.isclose(row[21], np.log1p(size[brothers[i + 1]]) if i + 1 < len(brothers) else 0.0)
