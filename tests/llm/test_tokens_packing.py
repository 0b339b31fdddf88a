import zlib
from collections import Counter

import numpy as np
import pytest

from segmill.llm.packing import configurations, make_plan, pack, placement, plan_runs
from segmill.llm.pieces import Pieces, load, vocabulary_path
from segmill.llm.token_counts import encode_chunk, token_counts

PATH = vocabulary_path("word_bpe_49k.json")
ODD = [
    "<|endoftext|>hi <|startoftext|> x<|endoftext|>", "ΣΑΣ İstanbul don't we'll I'M 123abc ..,! é é Ǻx \x1c a\x1cb \x85 q w ﬁ ß ẞ 你好。", "", "  ", "a.b.c ... !?",
    "don't. it's, 's 't", "word&&& x*** (ab) [c]d' é. Éa ́b", "A" * 300, "naïve Ünder—dash; x/y <|END|>", "café, CAFÉ.",
]


def library(text):
    return load(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_library():
    p = Pieces(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in p.ids([t.encode() for t in ODD])] == [library(t) for t in ODD]
    few = Pieces(PATH, remember=3)
    assert few.ids([t.encode() for t in ODD] * 2) == p.ids([t.encode() for t in ODD] * 2)


LONG = "Erste wörter und don't 12 more... " * 60


@pytest.mark.parametrize("chunk,overlap", [(32768, 1024), (200, 40), (64, 4)])
def test_counts(spark, chunk, overlap):
    texts = [*ODD, None, LONG, LONG, "x" * 900, "你好" * 400, LONG.replace(" ", "") + " " + "z" * 500]
    rows = [(i, t, "c", i) for i, t in enumerate(texts)] + [(None, LONG, "c", 0), (11, texts[11], "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, chunk int")
    got = sorted(map(tuple, token_counts(docs, PATH, chunk, overlap, limit=50).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(library(t)), len(library(t)) > 50) for i, t, *_ in rows), key=str)
    assert got == want


def test_counts_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_chunks_agree_on_shared_tokens():
    t = load(PATH)
    a = encode_chunk(LONG[:140], True, False, 100, 40, t)
    b = encode_chunk(LONG[100:240], False, False, 100, 40, t)
    assert (a["tail_at"], a["tail_crc"]) == (b["head_at"], b["head_crc"]) and a["tail_at"] >= 0


def test_configurations_cover_no_more_than_asked():
    plan = configurations([90, 60, 40], [10, 20, 30], 100)
    used = np.sum([np.array(c) * n for c, n in plan], axis=0)
    assert (used <= [10, 20, 30]).all() and all(np.dot(c, [90, 60, 40]) <= 100 for c, _ in plan)


@pytest.mark.parametrize("n,seed", [(0, 0), (7, 1), (800, 2), (20000, 3)])
def test_plan_packs_all(n, seed):
    lengths = np.minimum(2048, np.maximum(1, np.random.default_rng(seed).lognormal(6, 1.2, n).astype(int))).tolist()
    counts = Counter(lengths)
    for groups, large in ((16, 512), (3, 100), (0, 2048)):
        got = Counter()
        for content, k in plan_runs(counts, 2048, groups, large):
            assert sum(content) <= 2048
            for x in content:
                got[x] += k
        assert got == counts
    runs = make_plan(counts, 2048)
    assert sum(k for _, k in runs) <= -(-sum(lengths) // 2048) + 3 + max(0, Counter(x > 1024 for x in lengths)[True] - sum(lengths) // 2048)
    taken = Counter()
    for length, lo, hi, *_ in placement(runs):
        assert lo == taken[length]
        taken[length] = hi + 1
    assert taken == counts


def test_pack_round_trip(spark):
    rows = [(i, t, 1, "r") for i, t in enumerate([*ODD, None, LONG, LONG * 3, "same text", "same text"])] + [(3, ODD[3], 1, "r"), (None, "x y", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, part string")
    cap = 128
    found = pack(docs, PATH, cap).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library(t), 0]
        for k in range(0, len(ids), cap):
            cut = ids[k : k + cap]
            want[i, k // cap, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert pack(docs.limit(0), PATH).collect() == []
