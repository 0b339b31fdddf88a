import zlib

import numpy as np
import pyarrow as pa

from segmill.llm import pseudo_lm as lm
from segmill.llm import toxicity as tx


def test_gradient_matches_differences():
    net = tx.Network(4)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((7, tx.WIDE))
    x[-1] = 0
    at = rng.integers(0, 7, (3, 5))
    d = rng.standard_normal(3)

    def loss():
        states = net.forward(x, at)
        return float((states * d).sum())

    _, kept = net.forward(x, at, keep=True)
    g, d_x = net.gradient(x, at, d, kept)
    for name in ("Wf", "Ub", "cf", "A", "a", "u", "o"):
        flat = net.p[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 2e-3 * max(1, abs(g[name].reshape(-1)[k])) + 2e-3, name
    old = x[2, 3]
    x[2, 3] = old + 1e-3
    up = loss()
    x[2, 3] = old - 1e-3
    assert abs((up - loss()) / 2e-3 - d_x[2, 3]) < 5e-3


def test_windows_cover_every_word():
    bounds = np.array([0, 0, 1, 33, 65, 200])
    at, owner = tx.place_windows(bounds, 200)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        seen = {int(v) for v in at[owner == i].ravel() if v != 200}
        assert seen == set(range(a, b)) and (owner == i).any()


def _made(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu"], int(rng.integers(1, 4))))
    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(3, 120)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = str(rng.choice(["vilezz", "vilezzak", "grubbo"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = _made(900, 1)
    extra = [(5000, None, None), (5001, "", None), (None, "ba vilezz ke", None), (5002, "ba ke lo " * 9000 + "vilezz grubbo vilezzak", None), (3, rows[3][1], None)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows + extra], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score and 0 <= by[5000].score <= 1 and by[5002].predicted == 1
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    kept = tx.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.7 for r in got)


def plain_score(net, text):
    """The network's score of one text, window by window, word by word."""
    import re

    p, h, wide = net.p, tx.HIDDEN, tx.WIDE
    sig = lambda v: 1 / (1 + np.exp(-v))
    data = tx._CODE[np.frombuffer(text, dtype=np.uint8)].tobytes() if text else b""
    spans = [m.span() for m in re.finditer(rb"[^\x00]+", data)]
    xs = []
    for lo, hi in spans:
        word, char, first = tx.inputs(np.frombuffer(data[lo:hi], dtype=np.uint8), np.array([0]), np.array([hi - lo]))
        xs.append(p["word"][word[0]] + p["char"][char].mean(axis=0))
    many, best = max(1, -(-(len(xs) - tx.STRIDE) // tx.STRIDE)), -np.inf
    for k in range(many):
        here = xs[k * tx.STRIDE : k * tx.STRIDE + tx.LENGTH]
        # A window is full length; places behind the text read zeros and get next to no attention.
        rows = here + [np.zeros(wide)] * (tx.LENGTH - len(here))
        states = []
        for side, order in (("f", range(tx.LENGTH)), ("b", range(tx.LENGTH - 1, -1, -1))):
            s, found = np.zeros(h), [None] * tx.LENGTH
            for t in order:
                a, b = rows[t] @ p[f"W{side}"] + p[f"c{side}"], s @ p[f"U{side}"]
                z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                new = np.tanh(a[2 * h :] + r * b[2 * h :])
                s = new + z * (s - new)
                found[t] = s
            states.append(found)
        H = np.array([np.r_[f, b] for f, b in zip(*states)])
        e = np.array([np.tanh(H[t] @ p["A"]) @ p["a"] if t < len(here) else -30.0 for t in range(tx.LENGTH)])
        w = np.exp(e - e.max())
        best = max(best, float((w / w.sum()) @ H @ p["u"] + p["o"][0]))
    return sig(net.scale[0] * best + net.scale[1])


def test_toxicity_equals_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = tx.Network(4)
    for k, v in net.p.items():
        v[...] = rng.normal(0, 0.4, v.shape)
    net.scale = np.array([0.7, -0.2], dtype=np.float32)
    words = ["alpha", "Beta", "gr\u00fc\u00dfe", "x1", "a-b", "omega", "\u65e5\u672c"]
    texts = ["", "one", *(" ".join(rng.choice(words, n)) for n in (5, 31, 32, 33, 47, 48, 49, 200)), "  ,;  "]
    # Many windows, more than a part holds.
    texts.append(" ".join(rng.choice([w for w in words if w != "a-b"], 16 * 2100)))
    data = [t.encode() for t in texts]
    assert np.allclose(net.score(data)[:-1], [plain_score(net, t) for t in data[:-1]], atol=1e-5)
    assert np.allclose(net.score(data[-1:]), net.score([b" ".join(data[-1].split()[i : i + 400]) for i in range(0, 16 * 2100, 16)]).max(), atol=1e-5)


def test_word_hashes_keep_the_order_of_all_bytes():
    from segmill.llm.words import word_hashes

    def one(data):
        return int(word_hashes(np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)]))[0])

    for n in (10, 5000, 20_000):
        data = bytes(np.random.default_rng(n).integers(97, 123, n, dtype=np.uint8))
        want = sum(b * pow(0x100000001B3, i + 1, 1 << 64) for i, b in enumerate(data)) * 0xD6E8FEB86659FD93 % (1 << 64)
        assert one(data) == want and one(data[:-2] + data[-1:] + data[-2:-1]) != want or data[-1] == data[-2]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(docs, none).first().score == 0.5
    assert tx.toxicity(docs.limit(0), none).collect() == []


def _plain_scores(texts, v, label, inside):
    """Token by token."""
    p = lm.shaped(v)
    out = []
    for t in texts:
        found, bounds = lm.slots([t])
        at = lm.windows(found, bounds)
        total = 0.0
        for i, s in enumerate(found):
            h = p["b"].astype(float).copy()
            for k in range(4):
                if at[i, k] < lm.INPUTS:
                    h += p["E"][at[i, k]].astype(float) @ p["W"][k]
            z = np.tanh(h) @ p["O"] + p["c"]
            total += z[label[s]] - np.log(np.exp(z).sum()) + inside[s]
        out.append((len(found), total))
    return out


def test_pseudo_likelihood_equals_plain():
    texts = [b"one two three two", b"", b"Two", "ä b\tc\n".encode() * 30, b"x"]
    found, _ = lm.slots(texts)
    label, inside = lm.classes_of(np.bincount(found, minlength=lm.SLOTS).astype(float))
    v = lm.flat(lm.start(3))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([t.decode() for t in texts])], ["doc_id", "text"])
    got = pa.Table.from_batches(lm._score_batches(iter([batch]), v, label, inside)).to_pylist()
    for r, (n, total) in zip(got, _plain_scores(texts, v, label, inside)):
        assert r["n_tokens"] == n and abs(r["log_likelihood"] - total) < 1e-3
    sums = np.exp(inside.astype(float))
    assert np.allclose(np.bincount(label, sums, lm.CLASSES)[np.unique(label)], 1, atol=1e-3)


def test_training_lowers_the_loss():
    texts = [b"red car stops at red light while blue bird sings" for _ in range(400)]
    found, bounds = lm.slots(texts)
    label, _ = lm.classes_of(np.bincount(found, minlength=lm.SLOTS).astype(float))
    p, at = lm.start(), lm.windows(found, bounds)
    memory = {k: np.full(s, 0.01, dtype=np.float32) for k, s in lm.SHAPES.items()}
    losses = [lm.train_step(p, memory, at[i : i + 256], label[found[i : i + 256]]) for i in range(0, len(found), 256)]
    assert losses[-1] < 0.3 * losses[0]


def test_lm_query(spark):
    rows = [(i, "the cat sat on the mat " * (1 + i % 5), "c") for i in range(60)] + [(90, None, "c"), (91, " ", "c"), (None, "zq xv", "c"), (3, "the cat sat on the mat " * 4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[90].n_tokens, by[90].log_likelihood, by[91].n_tokens) == (0, 0.0, 0)
    assert by[1].mean_log_likelihood > by[None].mean_log_likelihood
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, lm.score(docs).collect()), key=str)
    assert lm.score(docs.limit(0)).collect() == []


def test_rounds_train_on_every_position(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(1 + i % 40)) for i in range(300)] + [""]
    found, bounds = lm.slots([t.encode() for t in texts])
    seen = []
    monkeypatch.setattr(lm, "train_step", lambda p, memory, at, label, rate=0.08: seen.append(np.c_[at, label]))
    keyed = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    rows = pa.Table.from_batches(lm._slot_batches(iter([keyed])))
    rows = rows.append_column("copy", pa.array([1] * len(rows)))
    assert rows.num_rows == 300
    for turn in range(2):
        assert lm._train_part(0, rows, lm.flat(lm.start()), np.arange(lm.SLOTS), turn).num_rows
    want = np.c_[lm.windows(found, bounds), found]
    assert sorted(map(tuple, np.concatenate(seen).tolist())) == sorted(map(tuple, want.tolist()))
    for rounds in (1, 3):
        assert sorted(np.concatenate([lm.due(bounds, t, rounds) for t in range(rounds)])) == list(range(len(found)))


def test_scores_do_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART", 500)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 40) % 500)) for i in range(80)] + [(200 + i, "the same text again and again") for i in range(60)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, lm.score(docs.repartition(n)).collect())) for n in (2, 5))
    assert one == two and len({r[2] for r in one if 200 <= r[0] < 260}) == 1


def test_words_of_one_slot_are_told_apart(spark, monkeypatch):
    names, by = (f"w{i}" for i in range(10**6)), {}
    while True:
        w = next(names)
        other = by.setdefault(int(lm.slots([w.encode()])[0][0]), w)
        if other != w:
            break
    rows = [(i, " ".join([other] * 30 + ["plain"] * 5)) for i in range(40)] + [(100, other), (101, w), (102, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "head_of", lambda words, most=2, f=lm.head_of: f(words, most))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[100].log_likelihood == got[102].log_likelihood
    # Windows and class are the same, so the counts alone part the two.
    assert abs(got[100].log_likelihood - got[101].log_likelihood - np.log(1202)) < 1e-4
    few = {r.word: r.n for r in lm.vocabulary(docs.select("text")).collect()}
    assert sorted(few.values()) == [1, 200, 1202]


def test_inputs_follow_the_vocabulary():
    assert [lm.inputs_for(n) for n in (0, 60_000, 70_000, 300_000, 10**9)] == [8192, 8192, 16384, 65536, 65536]
    v = lm.flat(lm.start(size=16384))
    assert lm.shaped(v)["E"].shape == (16384, lm.WIDE) and (lm.flat(lm.shaped(v)) == v).all()


def test_parts_of_counts_add_up():
    texts = [" ".join(f"v{i * j % 97}" for j in range(50)) for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20])], ["text"]) for i in range(0, 200, 20)]
    total = {}
    for b in lm._count_batches(iter(batches), most=100):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[w] = total.get(w, 0) + n
    found, n = np.unique(lm.hashes([t.encode() for t in texts])[0], return_counts=True)
    assert total == dict(zip(found.view(np.int64).tolist(), n.tolist()))


def test_places_in_the_head():
    words = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1))
    for head in (words[::3], words[:0]):
        for bits in (4, 20):
            got = lm.places(head, bits)(words)
            assert got.tolist() == [{w: i for i, w in enumerate(head.tolist())}.get(w, -1) for w in words.tolist()]


def test_some_windows_equal_all():
    rng = np.random.default_rng(8)
    bounds = np.array([0, 1, 3, 40, 41])
    found = rng.integers(0, lm.SLOTS, 41).astype(np.int32)
    for turn in range(2):
        some = lm.due(bounds, turn, 2)
        assert (lm.windows_at(some, found, bounds, lm.INPUTS) == lm.windows(found, bounds)[some]).all()


def test_places_of_a_window_are_multiplied_at_once():
    """One row a window with the inputs of all places, and the same numbers as place by place."""
    rng = np.random.default_rng(3)
    p, at = lm.start(), rng.integers(0, lm.INPUTS + 1, (500, len(lm.PLACES))).astype(np.int32)
    x, h = lm._hidden(p, at)
    each = [np.where((at[:, k] == lm.INPUTS)[:, None], 0, p["E"][np.minimum(at[:, k], lm.INPUTS - 1)]) for k in range(len(lm.PLACES))]
    assert x.shape == (500, len(lm.PLACES) * lm.WIDE) and (x == np.concatenate(each, axis=1)).all()
    assert np.allclose(h, np.tanh(sum(e @ w for e, w in zip(each, p["W"])) + p["b"]), atol=1e-6)
