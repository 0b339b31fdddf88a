"""op12 and op13 against plain loops and their SQL, with odd rows."""

import math
import re

import duckdb
import numpy as np
import pytest

from segmill.llm import negatives as ng
from segmill.llm import queries as q
from segmill.llm import ranked as rk

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, k=50):
    lists = [(d, terms(t)) for d, t in docs]
    lists = [(d, x) for d, x in lists if x]
    n_docs, total = len(lists), sum(len(x) for _, x in lists)
    df = {}
    for _, x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for d, x in lists:
            m = 100 - 50 + (50 * len(x) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * x.count(t)) // (1000 * x.count(t) + 20 * m)) for t in set(terms(text)) if t in df)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out |= {(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


DOCS = [
    (1, "Alpha beta, gamma beta"), (2, "beta BETA beta ÄÖ x1"), (3, None), (4, ""), (5, "... --- !!"), (6, "alpha"), (7, "alpha"), (7, "alpha"), (None, "alpha beta"),
    (8, "ünï cödé alpha_beta:gamma"), (9, "z" * 5000 + " beta"), (10, "alpha " * 3000 + "delta"), (11, "日本 語 alpha"), (12, "gamma delta epsilon"), (13, "Ä ä beta"),
]
ITEMS = [(1, "alpha BETA gamma"), (1, "alpha BETA gamma"), (1, "delta"), (2, None), (3, ""), (4, "nothing known"), (5, "alpha alpha ä 日本 z" + "z" * 4999), (None, "beta x1")]


@pytest.mark.parametrize("capacities", [(2_000, 64_000), (1, 2), (2,)])
@pytest.mark.parametrize("group_terms", [65_536, 3])
def test_ranked_equals_plain(spark, capacities, group_terms):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as score", "2 as row_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 as doc_id")
    for k in (50, 2):
        got = {tuple(r)[:4] for r in rk.ranked(docs, items, k, capacities, group_terms).collect()}
        assert got == plain_ranking(DOCS, ITEMS, k)


def test_tiers_are_used_and_exact(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=share / share.sum()))) for i in range(600)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(30)] + [(30, "w0"), (31, "w290 w291")]
    want, tiers = plain_ranking(docs, items, 5), set()
    for capacities in ((20, 80), (4, 8)):
        found = rk.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, capacities).collect()
        assert {tuple(r)[:4] for r in found} == want
        tiers |= {r.tier for r in found}
    assert tiers == {0, 1, 2}


def test_ranked_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rk.ranked(docs, items).count() == 0
    assert rk.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_long_texts_in_slices():
    text = ("word " * 50 + "x" * 300 + " ").encode() * 40
    known = rk.Dictionary([b"word", b"x" * 300, b"none"])
    old, rk._SLICE = rk._SLICE, 1000
    try:
        sliced = [s for s in rk.slices([b"a b", text, b""], 1000)]
        assert len(sliced) > 20 and all(len(c) <= 1400 for c, _, _ in sliced)
    finally:
        rk._SLICE = old
    n, owner, term, tf = rk.term_counts([b"a b", text, b""], known)
    assert n.tolist() == [2, 51 * 40, 0]
    assert list(zip(owner.tolist(), term.tolist(), tf.tolist())) == [(1, 0, 2000), (1, 1, 40)]


def test_equal_hashes_are_told_apart():
    known = rk.Dictionary([b"one", b"two", b"six"])
    known.hashes[:] = known.hashes[0]
    known.depth = 3
    real = rk.word_hashes
    rk.word_hashes = lambda code, a, b: np.full(len(a), known.hashes[0])
    try:
        code = rk._CODE[np.frombuffer(b"two six ten one", dtype=np.uint8)]
        assert known.find(code, *rk.word_spans(code)).tolist() == [1, 2, -1, 0]
    finally:
        rk.word_hashes = real


def plain_negatives(rows, every=100, positives=5, k=10, low=30, high=90):
    clean = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in clean:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in clean if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            hits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def made(spark, n, seed, dims=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    rows = []
    for i in range(n):
        v = centres[i % 6] + spread * rng.standard_normal(dims)
        rows.append((i, int(rng.integers(4)), [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    return rows


@pytest.mark.parametrize("block_rows,spread", [(4096, 0.3), (16, 0.3), (16, 0.05), (7, 2.0)])
def test_negatives_equal_plain(spark, block_rows, spread):
    rows = made(spark, 400, 3, spread=spread)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = ng.hard_negatives(df, LABEL, every=25, n_pivots=5, block_rows=block_rows, group_rows=6)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 25)


def test_negatives_odd_rows(spark):
    rows = made(spark, 120, 5)
    rows += [(200, 1, None), (201, None, [1.0] * 8), (202, 1, [1.0, None] + [0.0] * 6), (203, 2, [float("nan")] * 8), (204, 1, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    # Repeated rows, ties by id, one id with several vectors, a very common vector, zeros, another dimension, no dimension.
    rows += rows[:10] + [(0, 1, rows[7][2]), (300, 0, [0.0] * 8), (301, 0, [0.0] * 8), (100, 3, [0.5, 0.5]), (101, 3, [0.5, 0.25]), (102, 2, [0.5, 0.2]), (400, 1, []), (401, 2, [])]
    rows += [(1000 + i, i % 3, rows[12][2]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as pivot", "'x' as key", "2L as block", "3 as score")
    want = plain_negatives(rows, 25)
    assert want
    for size in (4096, 10):
        found = ng.hard_negatives(df, LABEL, every=25, n_pivots=4, block_rows=size, group_rows=3)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert ng.hard_negatives(df.limit(0), LABEL).count() == 0


def test_annuli_leave_blocks_out(spark):
    """In tight clusters most blocks are proven to be too far away."""
    rows = made(spark, 900, 9, spread=0.02)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    scanned = []
    real = ng._scan

    def spy(stored, requests, pairs, k, groups):
        scanned.append(pairs.count())
        return real(stored, requests, pairs, k, groups)

    ng._scan = spy
    try:
        found = ng.hard_negatives(df, "label", every=30, positives=2, low=95, high=100, n_pivots=12, block_rows=20, group_rows=50)
        found.count()
    finally:
        ng._scan = real
    # Two scans of home blocks and two of annuli; all pairs would be some 45 blocks for each request.
    assert scanned[1] < 30 * 45 / 2


def test_large_products():
    a = np.array([[2**40, -(2**40)], [3, 5]])
    assert ng.products(a, a // 2**20).tolist() == (a.astype(object) @ (a // 2**20).astype(object).T).tolist()


@pytest.mark.parametrize("name", ["op12_ranked", "op13_negatives"])
def test_queries_equal_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = q.queries()[name](spark, d)
    want = c.sql(q.oracle_sql()[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
