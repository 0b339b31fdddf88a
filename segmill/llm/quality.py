"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of ``PASSAGE`` words (runs without white space), which together are the whole text; the label
is the bag's. A passage is encoded from the mean vectors of its words and of its character trigrams, both by hash, and from measures of its form
(shares of kinds of characters, word lengths, how many words are new); two layers make its representation h. Gated attention
(tanh(V h) times sigmoid(U h), then a softmax over the document's passages) says how much each passage counts, and the weighted
sum of all representations gives the score. Gradients are by hand, steps by Adam.

Training takes a bounded sample of labelled documents: at most ``sample`` of each class, chosen by a hash of their ids, of at most ``max_chars``
characters, whatever the table's size. It runs in tasks, one for the network of all of them and two for networks of one half each; the other half's
results give the score's scale, so that it is a probability for classes of equal weight on texts not seen.

Defined results: null and empty texts have one empty passage and get its score; very long texts are read whole, passages scored part by part; an
empty table of documents gives no rows; without labelled documents of both classes every score is (good + 1) / (labelled + 2); labels that disagree count as
bad; null labels and null ids don't count; a null doc_id isn't held out; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import utf8_column
from .words import word_hashes, word_spans

PASSAGE = 48
WORD_BITS, GRAM_BITS, WIDE, HIDDEN, GATE = 14, 13, 8, 16, 8
FORM = 14
#: Bytes as codes: 0 for white space, 1 in place of the null byte.
_CODE = np.arange(256, dtype=np.uint8)
_CODE[0] = 1
_CODE[[9, 10, 11, 12, 13, 32]] = 0
#: Kinds of bytes inside words: small letters, capitals, digits, stops, other sentence marks, calls, quotes and brackets, other signs, beyond ASCII.
_KIND = np.full(256, 7, dtype=np.uint8)
for _kind, _which in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b";:-", b"!?", b"'\"()[]")):
    _KIND[list(_which)] = _kind
_KIND[128:] = 8
_SLICE = 1 << 20


class Passages:
    """Inputs of all passages of some texts: hashed words and trigrams with their passages, measures of form, and each passage's text."""

    def __init__(self, texts: list[bytes]):
        buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        code = _CODE[buffer]
        starts, stops = word_spans(code)
        ends = np.cumsum([len(t) + 1 for t in texts])
        n = np.diff(np.r_[0, np.searchsorted(starts, ends)])
        many = np.maximum(1, -(-n // PASSAGE))
        self.owner = np.repeat(np.arange(len(texts)), many)
        before = np.repeat(np.cumsum(n) - n, n)
        of_word = np.repeat(np.cumsum(many) - many, n) + (np.arange(len(starts)) - before) // PASSAGE
        P = len(self.owner)
        hashes = word_hashes(code, starts, stops)
        size = stops - starts
        inside = np.flatnonzero(code)
        of_byte = np.repeat(of_word, size)
        self.first_word, self.first_gram = np.searchsorted(of_word, np.arange(P + 1)), np.searchsorted(of_byte, np.arange(P + 1))
        self.words = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        wide = np.concatenate([[0], code, [0]]).astype(np.uint32)
        three = (wide[:-2] * np.uint32(65599) + wide[1:-1]) * np.uint32(65599) + wide[2:]
        self.grams = ((three * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)[inside]
        self.form = self._form(buffer, inside, of_byte, of_word, hashes, size, starts, P)

    def _form(self, buffer, inside, of_byte, of_word, hashes, size, starts, P) -> np.ndarray:
        words, letters = np.diff(self.first_word), np.diff(self.first_gram)
        out = np.zeros((P, FORM), dtype=np.float32)
        kinds = np.bincount(of_byte * 9 + _KIND[buffer[inside]], minlength=P * 9).reshape(P, 9)
        out[:, :9] = kinds / np.maximum(letters, 1)[:, None]
        out[:, 9] = np.log1p(words)
        out[:, 10] = letters / np.maximum(words, 1) / 8
        # Words that the passage has for the first time.
        keys = np.unique(of_word.astype(np.uint64) << np.uint64(34) | hashes >> np.uint64(30))
        out[:, 11] = np.bincount((keys >> np.uint64(34)).astype(np.int64), minlength=P) / np.maximum(words, 1)
        out[:, 12] = np.bincount(of_word, size == 1, P) / np.maximum(words, 1)
        # Words that begin with a capital.
        out[:, 13] = np.bincount(of_word, _KIND[buffer[starts]] == 1, P) / np.maximum(words, 1)
        return out

    def some(self, which: np.ndarray) -> "Passages":
        """Those passages, in that order; owners stay what they are."""
        out = object.__new__(Passages)
        out.owner, out.form = self.owner[which], self.form[which]
        for name, first in (("words", "first_word"), ("grams", "first_gram")):
            at = getattr(self, first)
            size = at[which + 1] - at[which]
            begin = np.cumsum(size) - size
            setattr(out, name, getattr(self, name)[np.arange(int(size.sum())) + np.repeat(at[which] - begin, size)])
            setattr(out, first, np.append(begin, size.sum()))
        return out


def _means(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean rows of consecutive runs; zeros for empty ones."""
    size = np.diff(first)
    out = np.zeros((len(size), rows.shape[1]), dtype=rows.dtype)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(rows, first[:-1][full], axis=0) / size[full, None]
    return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, row by row, so that equal passages get equal numbers in any company."""
    return np.einsum("pi,ij->pj", x, w)


def _spread(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values``' rows by index."""
    return np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], axis=1).astype(values.dtype)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters by name; ``scale`` turns a logit into a probability."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        wide = 2 * WIDE + FORM
        self.p = {
            "word": f(1 << WORD_BITS, WIDE, by=0.05), "gram": f(1 << GRAM_BITS, WIDE, by=0.2), "W": f(wide, HIDDEN, by=wide**-0.5), "b": f(HIDDEN, by=0),
            "H": f(HIDDEN, HIDDEN, by=HIDDEN**-0.5), "d": f(HIDDEN, by=0), "V": f(HIDDEN, GATE, by=0.25), "U": f(HIDDEN, GATE, by=0.25), "a": f(GATE, by=0.25),
            "c": f(HIDDEN, by=0.25), "o": f(1, by=0),
        }
        self.middle, self.spread = np.zeros(FORM, dtype=np.float32), np.ones(FORM, dtype=np.float32)
        self.scale = np.array([1.0, 0.0])

    def pack(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, middle=self.middle, spread=self.spread, scale=self.scale, **{f"p_{k}": v for k, v in self.p.items()})
        return to.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> "Network":
        net, z = object.__new__(cls), np.load(io.BytesIO(data), allow_pickle=False)
        net.p = {k[2:]: z[k] for k in z.files if k.startswith("p_")}
        net.middle, net.spread, net.scale = z["middle"], z["spread"], z["scale"]
        return net

    def encode(self, x: Passages, keep: bool = False):
        """The representation of every passage, from the passage alone."""
        p = self.p
        given = np.concatenate([_means(p["word"][x.words], x.first_word), _means(p["gram"][x.grams], x.first_gram), (x.form - self.middle) / self.spread], axis=1)
        one = np.tanh(_times(given, p["W"]) + p["b"])
        h = np.tanh(_times(one, p["H"]) + p["d"])
        return (h, (given, one)) if keep else h

    def attend(self, h: np.ndarray, owner: np.ndarray, keep: bool = False):
        """Logits of documents, whose passages are consecutive, and the weights of the passages."""
        p = self.p
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        run = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
        t, s = np.tanh(_times(h, p["V"])), _sigmoid(_times(h, p["U"]))
        e = (t * s * p["a"]).sum(axis=1)
        e = np.exp(e - np.maximum.reduceat(e, first)[run])
        w = e / np.add.reduceat(e, first)[run]
        z = np.add.reduceat(w[:, None] * h, first, axis=0)
        logit = (z * p["c"]).sum(axis=1) + p["o"]
        return (logit, w, (t, s, z, first, run)) if keep else (logit, w)

    def gradient(self, x: Passages, d: np.ndarray, h, w, kept, inner) -> dict[str, np.ndarray]:
        """Gradients of all parameters for the logits' gradients ``d``."""
        p, (t, s, z, first, run), (given, one) = self.p, kept, inner
        g = {"c": z.T @ d, "o": np.array([d.sum()])}
        d_z = (d[:, None] * p["c"])[run]
        d_w = (d_z * h).sum(axis=1)
        d_e = w * (d_w - np.add.reduceat(w * d_w, first)[run])
        g["a"] = (t * s).T @ d_e
        d_ts = d_e[:, None] * p["a"]
        d_t, d_s = d_ts * s * (1 - t**2), d_ts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ d_t, h.T @ d_s
        d_h = (w[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h**2)
        g["H"], g["d"] = one.T @ d_h, d_h.sum(axis=0)
        d_one = (d_h @ p["H"].T) * (1 - one**2)
        g["W"], g["b"] = given.T @ d_one, d_one.sum(axis=0)
        d_given = d_one @ p["W"].T
        for k, (name, index, at) in enumerate((("word", x.words, x.first_word), ("gram", x.grams, x.first_gram))):
            size = np.diff(at)
            rows = d_given[:, k * WIDE : (k + 1) * WIDE] / np.maximum(size, 1)[:, None]
            g[name] = _spread(index, np.repeat(rows, size, axis=0), len(p[name]))
        return g

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for group, parts in _groups(texts):
            done = [(x := Passages(part), self.encode(x)) for part in parts]
            h = np.concatenate([b for _, b in done])
            # Of a text in several parts, all passages are one document's.
            owner = done[0][0].owner if len(done) == 1 else np.zeros(len(h), dtype=np.int64)
            out[group] = self.attend(h, owner)[0]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.logits(texts) + self.scale[1])


def cut_text(text: bytes, size: int = _SLICE) -> list[bytes]:
    """Consecutive parts of whole passages; every part but the last has about ``size`` bytes."""
    code = _CODE[np.frombuffer(text, dtype=np.uint8)]
    starts = np.flatnonzero((code > 0) & ~np.r_[False, code[:-1] > 0])[::PASSAGE]
    edges, last = [0], 0
    for s in starts[1:].tolist():
        if s - last >= size:
            edges.append(s)
            last = s
    return [text[a:b] for a, b in zip(edges, [*edges[1:], len(text)])]


def _groups(texts: list[bytes], size: int = _SLICE) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Texts together up to ``size`` bytes; a larger one by itself, in parts."""
    group, total = [], 0
    for i, t in enumerate(texts):
        if len(t) > size:
            yield [i], [[part] for part in cut_text(t, size)]
            continue
        if group and total + len(t) > size:
            yield group, [[texts[j] for j in group]]
            group, total = [], 0
        group.append(i)
        total += len(t)
    if group:
        yield group, [[texts[j] for j in group]]


def learn(texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    x = Passages(texts)
    net.middle, net.spread = x.form.mean(axis=0), x.form.std(axis=0) + np.float32(0.02)
    edges = np.searchsorted(x.owner, np.arange(len(texts) + 1))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    epochs, step = max(epochs, min(60, -(-300 * batch // len(texts)))), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            size = edges[docs + 1] - edges[docs]
            begin = np.cumsum(size) - size
            part = x.some(np.arange(int(size.sum())) + np.repeat(edges[docs] - begin, size))
            h, inner = net.encode(part, keep=True)
            logit, w, kept = net.attend(h, np.repeat(np.arange(len(docs)), size), keep=True)
            d = ((_sigmoid(logit) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g = net.gradient(part, d, h, w, kept, inner)
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                # Weights, not offsets, are drawn towards 0.
                slope = g[k] + (1e-3 * v if v.ndim > 1 and k not in ("word", "gram") else 0)
                m += 0.1 * (slope - m)
                s += 0.01 * (slope**2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit_scale(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two numbers that turn a logit into a probability, for classes of equal weight; a little of either class everywhere keeps it finite."""
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    middle, spread = float(np.average(logit, weights=weight)), max(float(np.std(logit)), 1e-6)
    x, want, a, b = (logit - middle) / spread, 0.98 * y + 0.01, 1.0, 0.0
    for _ in range(3000):
        e = (_sigmoid(a * x + b) - want) * weight
        a, b = max(1e-3, a - 0.5 * float((e * x).mean())), b - 0.5 * float(e.mean())
    return np.array([a / spread, b - a * middle / spread])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _train(key, t: pa.Table) -> pa.Table:
    """The network of model 0 (all rows), or of the rows of another half than the model's, with the logits of its own half."""
    model = key[0].as_py()
    t = t.sort_by("doc_id")
    texts, y, half = utf8_column(t.column("text").combine_chunks()), t.column("good").to_numpy().astype(np.float32), t.column("half").to_numpy()
    mine = np.flatnonzero(half == model)
    used = np.flatnonzero(half != model)
    logits = np.zeros(0)
    if len({*y[used].tolist()}) < 2:
        packed = b""
    else:
        net = learn([texts[i] for i in used], y[used], seed=5 + model)
        packed, logits = net.pack(), net.logits([texts[i] for i in mine]) if len(mine) else logits
    return pa.table({"model": pa.array([model], pa.int32()), "net": pa.array([packed], pa.binary()), "logits": pa.array([logits.tolist()], pa.list_(pa.float64())), "good": pa.array([y[mine].tolist()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, max_chars: int = 20_000) -> Network | float:
    """A network from the labelled documents that aren't held out, or the share of good ones."""
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    known = marked.join(rows.select("doc_id"), "doc_id", "left_semi")
    by = F.xxhash64("doc_id")
    chosen = known.filter("good = 1").orderBy(by, "doc_id").limit(sample).unionByName(known.filter("good = 0").orderBy(by, "doc_id").limit(sample))
    # The bound: at most twice ``sample`` ids, and as many texts within ``max_chars``.
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "good")).alias("r")).select("doc_id", "r.text", "r.good")
    models = F.explode(F.array(*[F.lit(m) for m in range(3)])).alias("model")
    # Halves 1 and 2 by another hash than the sample's.
    half = (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) + 1).cast("int").alias("half")
    trained = found.select("doc_id", "text", "good", half, models).groupBy("model").applyInArrow(lambda key, t: _train(key, t), "model int, net binary, logits array<double>, good array<double>")
    out = {r["model"]: r for r in trained.collect()}
    if not out or not out[0]["net"]:
        total, good = chosen.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
        return (good + 1) / (total + 2)
    net = Network.unpack(bytes(out[0]["net"]))
    logits, y = (np.array([v for m in (1, 2) if m in out and out[m]["net"] for v in out[m][c]]) for c in ("logits", "good"))
    if len({*y.tolist()}) == 2:
        net.scale = fit_scale(logits, y)
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network | float, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        scores = net.score(texts) if isinstance(net, Network) else np.full(len(texts), net)
        ids = batch.column("doc_id")
        out = [pa.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]), pa.array(scores, pa.float64()), pa.array((scores >= limit).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([ids, *out], ["doc_id", "held_out", "score", "predicted"])


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, sample: int = 2000, max_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``limit``) of every document."""
    net = fit(docs, labels, sample, max_chars)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(lambda b: _score(b, net, limit), "doc_id long, held_out boolean, score double, predicted int")
