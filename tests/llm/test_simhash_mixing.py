import re
from collections import Counter

import numpy as np
import xxhash

from segmill.llm.mixing import mix, repeated
from segmill.llm.simhash import components, fingerprint, forest, golay_words, near_duplicates, representatives, syndromes


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def closure(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for g in out.values() for i in g}


def test_golay_is_perfect():
    w = golay_words()
    x = np.random.default_rng(0).integers(0, 1 << 23, 500).astype(np.uint32)
    d = np.bitwise_count(x[:, None] ^ w[None, :])
    assert len(set(w.tolist())) == 4096 and (syndromes(w) == 0).all() and ((d <= 3).sum(axis=1) == 1).all()


def test_fingerprints():
    for t in ("", " \t\n", "one", "A b C d", "a b c d e", "É x \x1c y  Z\x0bq", "w " * 3000, "x" * 5000):
        assert fingerprint(t.encode()) == brute_fingerprint(t)


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    points = set()
    for _ in range(60):
        v = int(rng.integers(0, 1 << 63))
        for _ in range(6):
            points.add(v)
            for _ in range(int(rng.integers(0, 6))):
                v ^= 1 << int(rng.integers(0, 64))
    p = np.array(sorted(points), dtype=np.uint64)
    a, b = forest(p, p, 4)
    want = closure(list(range(len(p))), p.tolist())
    at = {int(v): i for i, v in enumerate(p)}
    parent = {}
    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 4
        parent[at[y]] = at[x]
    root = lambda i: root(parent[i]) if i in parent else i
    groups = {}
    for i in range(len(p)):
        groups.setdefault(root(i), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want
    assert len(a) == len(p) - len(groups)


def _docs(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5))
    rows = []
    for k in range(12):
        words = [word() for _ in range(int(rng.integers(1, 300)))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words[int(rng.integers(len(words)))] = word()
    rows += [(100, None), (101, ""), (102, " \n"), (103, "Same text HERE again and"), (104, "same text here AGAIN and"), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, "quite alone"), (200, "long " * 9000)]
    rows = [(i, t, "s", i or 0, "x", "y") for i, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, root string, key string")


def test_near_duplicates_brute(spark):
    rows, docs = _docs(spark)
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    by_place = closure(list(range(len(rows))), prints)
    groups = {}
    for i, g in by_place.items():
        groups.setdefault(g, []).append(rows[i][0])
    want = Counter((rows[i][0], f"{prints[i]:016x}", min((x for x in groups[by_place[i]] if x is not None), default=None)) for i in range(len(rows)))
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    kept = representatives(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert near_duplicates(docs.limit(0)).collect() == [] and representatives(docs.limit(0)).collect() == []


def test_tiles_lose_no_link(spark):
    from segmill.llm.simhash import links

    base = [(1 << 40) + k for k in range(64)]
    prints = spark.createDataFrame([(x,) for x in base], "fp long")
    edges = links(prints, 4, tile=4)
    roots = {r.root for r in components(edges).collect()}
    assert roots == {min(base)} and components(edges).count() == len(base) - 1


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {(r.v, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def _targets(sizes, total):
    out, left = {}, dict(sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while left:
        level = total / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 3 * sizes[s]]
        for s in full:
            out[s] = 3 * sizes[s]
            total -= out[s]
            del left[s]
        if not full:
            return out | {s: level * weight[s] for s in left}
    return out


def test_mix(spark):
    rng = np.random.default_rng(2)
    names = ["b", "a", None, "ü", "tiny", "Z"]
    rows = [(i, names[min(5, int(rng.exponential(1.2)))] if i % 3 else "a", "w " * int(rng.integers(0, 40)), i) for i in range(3000)]
    rows += [(5000, "tiny", "one", 1), (5000, "tiny", "one", 1), (None, "b", None, 2), (5001, "none", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = [r.asDict() for r in mix(docs).collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes, sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 45
    assert sum(taken.values()) <= sum(sizes.values())
    again = Counter((r["doc_id"], r["taken"]) for r in got)
    assert again == Counter((r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect())
    out = repeated(docs)
    assert out.columns == docs.columns
    assert abs(out.count() - sum(r["served"] for r in got)) <= 2


def test_mix_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")], "doc_id long, source string, text string")
    r = mix(docs).first()
    assert (r.size, r.target, r.taken) == (3, 3.0, 3)
    assert mix(docs.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mix(empty).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
