"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of letters, digits and bytes above 127, ASCII lower case) are looked up by hash in a
word table, and each of a word's characters, with both neighbours, in a character table; a word's
input is its word vector plus the mean of its character vectors. Windows of ``LENGTH`` words, each ``STRIDE`` words
after the one before, cover the whole text. Two gated recurrent networks read a window from either
side, attention weighs the words, and the largest window gives the document's score.

Training takes a bounded sample of labelled documents: at most ``sample`` of each class, chosen by a hash
of their ids, of at most ``max_chars`` characters. A toxic document need not be toxic everywhere: after a first round
on windows at random, it is its highest window that learns the label, and a clean document's highest that learns the opposite.
Words of a single training text have no vector of their own, so that few labels teach words, not texts; a vector's first number starts
from the word's share of toxic texts. Scores are probabilities for classes of equal weight; their scale comes from networks that haven't seen the texts.

Defined results: an empty table of documents gives no rows; null and empty texts have one empty window and get its score; very long texts are read whole, part by part; a null doc_id isn't held out; labels that
disagree count as toxic; null labels don't count; without labelled documents of both classes every score is
(toxic + 1) / (labelled + 2); repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import utf8_column
from .words import lower_table, word_hashes, word_spans

LENGTH, STRIDE = 32, 16
WORDS, CHARS, WIDE, HIDDEN, LOOK = 1 << 14, 1 << 13, 12, 8, 8
#: Letters, digits and bytes above 127 make words.
_CODE = lower_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def inputs(code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and the buckets of all words' characters in a row with each word's first place."""
    wide = np.concatenate([[0], code, [0]]).astype(np.uint64)
    three = (wide[:-2] * np.uint64(65599) + wide[1:-1]) * np.uint64(65599) + wide[2:]
    three = ((three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int32)
    sizes = stops - starts
    whole = word_hashes(code, starts, stops)
    return (whole >> np.uint64(64 - 14)).astype(np.int32), three[code > 0], np.cumsum(sizes) - sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values``' rows by ``index``."""
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters by name, all float32."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
        self.p = {"word": f(WORDS, WIDE, by=0.02), "char": f(CHARS, WIDE, by=0.02)}
        for side in "fb":
            self.p |= {f"W{side}": f(WIDE, 3 * HIDDEN, by=0.4), f"U{side}": f(HIDDEN, 3 * HIDDEN, by=0.3), f"c{side}": f(3 * HIDDEN, by=0.0)}
        self.p |= {"A": f(2 * HIDDEN, LOOK, by=0.4), "a": f(LOOK, by=0.4), "u": f(2 * HIDDEN, by=0.4), "o": f(1, by=0.0)}
        self.scale = np.array([1.0, 0.0], dtype=np.float32)

    def embed(self, word: np.ndarray, char: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row per word, and a last one of zeros for places without a word."""
        out = np.zeros((len(word) + 1, WIDE), dtype=np.float32)
        stop = np.append(first, len(char))
        for i in range(0, len(word), 20_000):
            j = min(len(word), i + 20_000)
            part = self.p["char"][char[stop[i] : stop[j]]]
            out[i:j] = np.add.reduceat(part, first[i:j] - stop[i], axis=0)
            out[i:j] /= np.diff(stop[i : j + 1])[:, None]
            out[i:j] += self.p["word"][word[i:j]]
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (places in x, a row each). With ``keep`` also what the gradient needs."""
        p, n, h = self.p, len(at), HIDDEN
        states, saved = np.empty((2, at.shape[1], n, h), dtype=np.float32), {}
        for side, name in enumerate("fb"):
            given = x @ p[f"W{name}"] + p[f"c{name}"]
            U, s = p[f"U{name}"], np.zeros((n, h), dtype=np.float32)
            steps = range(at.shape[1]) if side == 0 else range(at.shape[1] - 1, -1, -1)
            for t in steps:
                a, b = given[at[:, t]], s @ U
                gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                m = a[:, 2 * h :] + r * b[:, 2 * h :]
                m *= 2
                new = _sigmoid(m)
                new *= 2
                new -= 1
                old, s = s, new + z * (s - new)
                states[side, t] = s
                if keep:
                    saved[side, t] = (old, z, r, new, b[:, 2 * h :])
        H = np.concatenate([states[0], states[1]], axis=2)
        look = np.tanh(H.reshape(-1, 2 * h) @ p["A"])
        e = (look @ p["a"]).reshape(at.shape[1], n)
        e = np.where((at == len(x) - 1).T, np.float32(-30), e)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", w, H)
        logit = pooled @ p["u"] + p["o"]
        return (logit, (H, look, w, pooled, saved)) if keep else logit

    def gradient(self, x: np.ndarray, at: np.ndarray, d: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of x, for logits' gradients ``d``."""
        H, look, w, pooled, saved = kept
        p, n, h, T = self.p, len(at), HIDDEN, at.shape[1]
        g = {"u": pooled.T @ d, "o": np.array([d.sum()], dtype=np.float32)}
        d_pool = d[:, None] * p["u"]
        d_H = w[:, :, None] * d_pool[None]
        d_w = np.einsum("tnk,nk->tn", H, d_pool)
        d_e = (w * (d_w - (w * d_w).sum(axis=0))).reshape(-1)
        g["a"] = look.T @ d_e
        d_look = d_e[:, None] * p["a"] * (1 - look**2)
        g["A"] = H.reshape(-1, 2 * h).T @ d_look
        d_H += (d_look @ p["A"].T).reshape(T, n, 2 * h)
        d_x = np.zeros_like(x)
        for side, name in enumerate("fb"):
            U, W = p[f"U{name}"], p[f"W{name}"]
            d_s, dU = np.zeros((n, h), dtype=np.float32), np.zeros_like(U)
            D = np.empty((T, n, 3 * h), dtype=np.float32)
            steps = range(T - 1, -1, -1) if side == 0 else range(T)
            for t in steps:
                old, z, r, new, b = saved[side, t]
                d_s = d_s + d_H[t, :, side * h : (side + 1) * h]
                d_new = d_s * (1 - z) * (1 - new**2)
                d_z = d_s * (old - new) * z * (1 - z)
                d_r = d_new * b * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new], axis=1)
                d_b = np.concatenate([d_z, d_r, d_new * r], axis=1)
                dU += old.T @ d_b
                d_s = d_s * z + d_b @ U.T
                D[t] = d_a
            d_given = scatter(at.T.ravel(), D.reshape(-1, 3 * h), len(x))
            g[f"U{name}"], g[f"c{name}"], g[f"W{name}"] = dU, d_given.sum(axis=0), x.T @ d_given
            d_x += d_given @ W.T
        return g, d_x

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of UTF-8 texts, over all their windows."""
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.highest(texts) + self.scale[1], -700, 700)))

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's logit of each text."""
        out = np.empty(len(texts))
        for group in _chunks(texts, 200_000):
            word, char, first, bounds = _all_inputs([texts[i] for i in group])
            at, owner = place_windows(bounds, len(word))
            out[group] = np.maximum.reduceat(self.over_windows(word, char, first, at), np.flatnonzero(np.diff(owner, prepend=-1)))
        return out

    def over_windows(self, word: np.ndarray, char: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of windows in order; each part of them embeds its own words only, so time grows with the windows."""
        stop, out = np.append(first, len(char)), []
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            lo, hi = int(part.min()), int(part.max(where=part < len(word), initial=-1)) + 1
            lo, hi = min(lo, len(word)), max(hi, min(lo, len(word)))
            x = self.embed(word[lo:hi], char[stop[lo] : stop[hi]], first[lo:hi] - stop[lo])
            out.append(self.forward(x, np.where(part == len(word), hi - lo, part - lo)))
        return np.concatenate(out)


def place_windows(bounds: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with words [bounds[i], bounds[i + 1]): windows' places and owners; ``none`` stands for no word."""
    n = np.diff(bounds)
    many = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    owner = np.repeat(np.arange(len(n)), many)
    first = bounds[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    at = first[:, None] + np.arange(LENGTH)
    return np.where(at < bounds[1:][owner][:, None], at, none), owner


def _chunks(texts: list[bytes], size: int) -> Iterator[list[int]]:
    group, total = [], 0
    for i, t in enumerate(texts):
        if group and total + len(t) > size:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(t)
    if group:
        yield group


def _all_inputs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """inputs() of all texts and their bounds in words, made part by part to keep the arrays between small."""
    parts, sizes, chars = [], [np.zeros(1, dtype=np.int64)], 0
    for group in _chunks(texts, 500_000):
        some = [texts[i] for i in group]
        code = _CODE[np.frombuffer(b" ".join(some), dtype=np.uint8)]
        starts, stops = word_spans(code)
        word, char, first = inputs(code, starts, stops)
        parts.append((word, char, first + chars))
        chars += len(char)
        sizes.append(np.diff(np.r_[0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some]))]))
    word, char, first = (np.concatenate(x) for x in zip(*parts))
    return word, char, first, np.cumsum(np.concatenate(sizes))


def train(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 3, folds: int = 2) -> Network:
    """A network of all texts, whose scale comes from networks of the other folds' texts (its own texts for ``folds`` below 2)."""
    y = np.array(labels, dtype=np.float32)
    net = _learn(texts, y, epochs, batch, rate, seed)
    best, fold = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for k in (0, 1):
        # Dealt within each class, so that every fold has both.
        fold[y == k] = np.arange(int((y == k).sum())) % max(1, folds)
    for k in range(folds if folds > 1 else 0):
        mine, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(mine) and len({*y[others].tolist()}) == 2:
            part = _learn([texts[i] for i in others], y[others], epochs, batch, rate, seed + 1 + k)
            best[mine] = part.highest([texts[i] for i in mine])
        else:
            best[mine] = net.highest([texts[i] for i in mine])
    net.scale = _scale(best if folds > 1 else net.highest(texts), y)
    return net


def _scale(best: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two numbers that turn the highest logit into a probability, for classes of equal weight."""
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    middle, spread = float(np.average(best, weights=weight)), max(float(np.std(best)), 1e-6)
    x, a, b = (best - middle) / spread, 1.0, 0.0
    for _ in range(2000):
        e = (1 / (1 + np.exp(-(a * x + b))) - y) * weight
        a, b = max(1e-3, a - 0.5 * float((e * x).mean())), b - 0.5 * float(e.mean())
    return np.array([a / spread, b - a * middle / spread], dtype=np.float32)


def _learn(texts: list[bytes], y: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    word, char, first, bounds = _all_inputs(texts)
    # A word of a single text tells that text, not its label: only words of two or more have a vector.
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * WORDS + word)
    there, toxic = (np.bincount(pairs % WORDS, w, WORDS) for w in (None, y[pairs // WORDS]))
    shared = (there > 1)[:, None]
    net.p["word"] *= shared
    # The first number of a vector starts from how far the word's toxic texts are from their expected number, in deviations beyond two.
    expected = there * y.mean()
    far = (toxic - expected) / np.sqrt(expected + 1)
    net.p["word"][:, 0] = np.clip(np.sign(far) * np.maximum(np.abs(far) - 2, 0), -3, 3) * shared[:, 0]
    at, owner = place_windows(bounds, len(word))
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    stop = np.append(first, len(char))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    step = 0

    # Small samples go through more often, so that there are enough steps.
    epochs = max(epochs, min(40, -(-100 * batch // (2 * len(texts)))))
    for epoch in range(epochs):
        some = edges[:-1, None] + (rng.random((len(texts), 3)) * np.diff(edges)[:, None]).astype(int)
        if 3 * epoch < epochs:
            chosen = np.unique(some)
        else:
            logit = net.over_windows(word, char, first, at)
            best = np.array([i + int(logit[i:j].argmax()) for i, j in zip(edges, edges[1:])])
            clean = some[y == 0][:, :1].ravel()
            chosen = np.unique(np.concatenate([best, clean]))
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            picked = at[chosen[i : i + batch]]
            rows, local = np.unique(picked, return_inverse=True)
            local = local.reshape(picked.shape)
            rows = rows[rows < len(word)]
            local = np.where(picked == len(word), len(rows), local)
            sizes = stop[rows + 1] - stop[rows]
            begin = np.cumsum(sizes) - sizes
            chars = char[np.repeat(stop[rows] - begin, sizes) + np.arange(sizes.sum())]
            x = net.embed(word[rows], chars, begin)
            logit, kept = net.forward(x, local, keep=True)
            who = owner[chosen[i : i + batch]]
            d = (1 / (1 + np.exp(-logit)) - y[who]) * weight[who] / len(who)
            g, d_x = net.gradient(x, local, d.astype(np.float32), kept)
            d_x = d_x[:-1]
            g["word"] = scatter(word[rows], d_x, WORDS) * shared
            g["char"] = scatter(chars, np.repeat(d_x / np.maximum(sizes, 1)[:, None], sizes, axis=0), CHARS)
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, max_chars: int = 20_000) -> Network | float:
    """A network from the labelled documents that aren't held out, or the share of toxic ones."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # The bound: at most twice ``sample`` ids and texts, each text within ``max_chars``.
    short = docs.filter(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = marked.join(short, "doc_id", "left_semi")
    by = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(by, "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(by, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).orderBy("doc_id")
    found = [(r["r"]["text"].encode(), r["r"]["toxic"]) for r in rows.collect()]
    toxic = sum(y for _, y in found)
    if not toxic or toxic == len(found):
        return (toxic + 1) / (len(found) + 2)
    return train([t for t, _ in found], [y for _, y in found])


def _batches(batches: Iterator[pa.RecordBatch], net: Network | float, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        scores = net.score(texts) if isinstance(net, Network) else np.full(len(texts), net)
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]),
                pa.array(scores),
                pa.array((scores >= limit).astype(np.int32)),
            ],
            ["doc_id", "held_out", "score", "predicted"],
        )


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7, sample: int = 2000, max_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``limit``) of every document."""
    net = fit(docs, labels, sample, max_chars)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(lambda b: _batches(b, net, limit), "doc_id long, held_out boolean, score double, predicted int")


def _keep(batches: Iterator[pa.RecordBatch], net: Network | float, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        scores = net.score(texts) if isinstance(net, Network) else np.full(len(texts), net)
        yield batch.filter(pa.array(scores < limit))


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.7, sample: int = 2000, max_chars: int = 20_000) -> DataFrame:
    """The documents, all their columns, that score below ``limit``."""
    net = fit(docs, labels, sample, max_chars)
    return docs.mapInArrow(lambda b: _keep(b, net, limit), docs.schema)
