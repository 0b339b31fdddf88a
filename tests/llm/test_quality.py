"""op11: gradients, passages, parts of long texts, training and hold-out."""

import zlib

import numpy as np
import pytest

from segmill.llm import quality as ql


def test_gradient_matches_differences():
    net = ql.Network(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["one", "Two,", "3%", "four!"], n)).encode() for n in (5, 130, 60)] + [b""]
    x = ql.Passages(texts)
    d = rng.standard_normal(len(texts))
    loss = lambda: float((net.attend(net.encode(x), x.owner)[0] * d).sum())
    h, inner = net.encode(x, keep=True)
    _, w, kept = net.attend(h, x.owner, keep=True)
    g = net.gradient(x, d, h, w, kept, inner)
    for name, value in net.p.items():
        flat, slope = value.reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in np.argsort(-np.abs(slope))[:4].tolist() + [0]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-5 * max(1, abs(slope[k])), name


def test_passages_are_the_whole_text():
    texts = [b"", b" \n\t ", b"a", ("w " * ql.PASSAGE).encode(), ("w " * (ql.PASSAGE + 1)).encode(), b"x" * 100_000, b"\0 \0a"]
    x = ql.Passages(texts)
    assert np.bincount(x.owner).tolist() == [1, 1, 1, 1, 2, 1, 1]
    assert np.diff(x.first_word).sum() == 1 + ql.PASSAGE + ql.PASSAGE + 1 + 1 + 2
    some = x.some(np.array([4, 0, 3]))
    assert np.diff(some.first_word).tolist() == [48, 0, 48] and np.array_equal(some.form, x.form[[4, 0, 3]])


def test_equal_texts_score_alike_in_any_company():
    net = ql.Network(2)
    texts = [b"Some words, in a row.", b"", ("many words here " * 300).encode()]
    alone = [net.score([t])[0] for t in texts]
    assert net.score(texts * 3).tolist() == alone * 3


def test_long_texts_go_in_parts_of_whole_passages():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcde"), int(n))) for n in rng.integers(1, 9, 5000)).encode()
    parts = ql.cut_text(text, 2000)
    assert b"".join(parts) == text and len(parts) > 5
    assert all(len(p.split()) % ql.PASSAGE == 0 for p in parts[:-1])
    net = ql.Network(2)
    whole = net.logits([text])[0]
    old, ql._groups.__defaults__ = ql._groups.__defaults__, (2000,)
    try:
        assert abs(net.logits([text, b"short"])[0] - whole) < 1e-4
    finally:
        ql._groups.__defaults__ = old


def _documents(n, seed):
    """Good texts; bad ones have junk in a part of them only."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu"], int(rng.integers(1, 4))))
    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(20, 400)))]
        bad = int(rng.random() < 0.3)
        if bad:
            at, kind = int(rng.integers(len(words))), int(rng.integers(3))
            part = words[at : at + 60]
            words[at : at + 60] = [[w + "%%" for w in part], [w.upper() + "!!" for w in part], [part[0]] * len(part)][kind] if len(part) > 10 else ["%% !!"] * 30
        rows.append((i, " ".join(words), 1 - bad))
    return rows


def test_accuracy_on_held_out_documents(spark):
    rows = _documents(600, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, quality int, toxic int")
    found = ql.quality(docs, labels).collect()
    y = {i: v for i, _, v in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = _documents(200, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for turn in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if turn and held(i) else y) for i, _, y in rows], "doc_id long, quality int")
        scores.append({r.doc_id: r.score for r in ql.quality(docs, labels).collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(2, 1), (3, 1)], 0.75), ([(2, 0), (3, None), (None, 1)], 1 / 3)])
def test_without_both_classes(spark, labels, want):
    docs = spark.createDataFrame([(2, "a"), (3, None), (None, ""), (2, "a")], "doc_id long, text string").selectExpr("*", "1 as quality", "'x' as score")
    found = ql.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [(r.held_out, round(r.score, 9)) for r in found if r.doc_id is None] == [(False, round(want, 9))]
    assert len(found) == 4 and len({r.score for r in found}) == 1


def test_odd_rows_and_empty_table(spark):
    rows = _documents(120, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (500, None), (501, ""), (None, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (500, None), (rows[0][0], 0)], "doc_id long, quality int")
    found = ql.quality(docs, labels).collect()
    assert len(found) == 124 and len({r.score for r in found if r.doc_id in (500, 501)}) == 1
    assert ql.quality(docs.limit(0), labels).collect() == []
