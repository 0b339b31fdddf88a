"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the two before and the two behind it, as if the token
itself were masked; a document's score is the sum of these conditional log-probabilities. Tokens are the
words between white space, ASCII lower case, told apart by 64-bit hashes. P(word) is P(class | window) from the network
times P(slot | class) and P(word | slot), which make P(word | class), from the counts of all documents. Slots (``SLOTS``,
by hash) only carry the classes, which are cut from them by falling count into equal shares of all tokens, as
far as single slots allow.

The counts are a distributed table of one row a word, so it grows with the vocabulary. At most ``HEAD`` of its most frequent
words go along with the tasks; every other word's count is joined. The network reads hashed context words, and
the number of these inputs follows the vocabulary, from ``INPUTS`` to ``SLOTS``.

All documents take part in counting and training. Texts are turned into slots once, two bytes a token, equal ones counted; a hash of the text and of the
copy's number deals them to parts of about ``PART`` tokens, which are read in the order of text and copy, so that neither files nor their splitting matter and
copies of one text are dealt to many parts. Every part trains its own copy of the network on the positions that are due in the round; copies are averaged, weighted by their tokens, and
go through a second round on the other positions, so that the rounds together predict every token once. The driver gets sums of bounded size.

Defined results: null and empty texts have no tokens, a sum and mean of 0; a corpus without words trains on nothing, an empty table gives no rows;
very long texts are read whole; repeated rows give a row each, with equal scores; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .pieces import utf8_column
from .words import lower_table, word_hashes, word_spans

SLOT_BITS, INPUT_BITS = 16, 13
SLOTS, INPUTS, WIDE, CLASSES = 1 << SLOT_BITS, 1 << INPUT_BITS, 16, 64
PLACES = (-2, -1, 1, 2)
HEAD = 1 << 17
#: Tokens of a training part, about; small corpora have up to eight parts of a quarter of that.
PART = 4_000_000
BLOCK = 1 << 15
#: Logarithms of counts are summed as integers, so that reruns agree.
FINE = 1 << 30
_CODE = lower_table(b for b in range(256) if b != 32 and not 9 <= b <= 13)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and the texts' bounds in them."""
    code = _CODE[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    starts, stops = word_spans(code)
    return word_hashes(code, starts, stops), np.r_[0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]


def slot_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts' words, and the texts' bounds in them."""
    words, bounds = hashes(texts)
    return slot_of(words), bounds


def inputs_for(words: int) -> int:
    """Network inputs for a vocabulary: a power of two, eight words to one at most, as far as slots go."""
    return min(SLOTS, max(INPUTS, 1 << max(0, (words - 1) // 8).bit_length()))


def windows_at(some: np.ndarray, found: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """As :func:`windows`, for some tokens only."""
    text = np.searchsorted(bounds, some, side="right") - 1
    low, high, out = bounds[text], bounds[text + 1], np.empty((len(some), len(PLACES)), dtype=np.int32)
    inputs = np.append(found & (size - 1), size)
    for k, d in enumerate(PLACES):
        place = some + d
        out[:, k] = inputs[np.where((place >= low) & (place < high), place, len(found))]
    return out


def windows(found: np.ndarray, bounds: np.ndarray, size: int = INPUTS) -> np.ndarray:
    """Inputs around every token; ``size`` stands for a place outside the text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n, out = len(found), np.full((len(found), len(PLACES)), size, dtype=np.int32)
    inputs = found & (size - 1)
    for k, d in enumerate(PLACES):
        lo, hi = max(0, -d), n - max(0, d)
        if hi > lo:
            same = owner[lo:hi] == owner[lo + d : hi + d]
            out[lo:hi, k] = np.where(same, inputs[lo + d : hi + d], size)
    return out


def due(bounds: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Positions to train in a round: every ``rounds``-th word of each text, another in each round."""
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.flatnonzero(place % rounds == turn)


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slot's class and log P(slot | class); unseen slots count as half a token."""
    mass = np.maximum(counts, 0.5)
    order = np.argsort(-mass, kind="stable")
    upto = np.cumsum(mass[order]) - mass[order] / 2
    label = np.empty(SLOTS, dtype=np.int32)
    label[order] = np.minimum(CLASSES - 1, upto / mass.sum() * CLASSES).astype(np.int32)
    total = np.bincount(label, mass, CLASSES)
    return label, np.log(mass / total[label]).astype(np.float32)


SHAPES = {"E": (INPUTS, WIDE), "W": (len(PLACES), WIDE, WIDE), "b": (WIDE,), "O": (WIDE, CLASSES), "c": (CLASSES,)}


def start(seed: int = 7, size: int = INPUTS) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    by = {"E": 0.3, "W": 0.25, "b": 0.0, "O": 0.1, "c": 0.0}
    return {k: (r.standard_normal(s) * by[k]).astype(np.float32) for k, s in (SHAPES | {"E": (size, WIDE)}).items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    size = (len(v) - sum(int(np.prod(s)) for k, s in SHAPES.items() if k != "E")) // WIDE
    for k, s in (SHAPES | {"E": (size, WIDE)}).items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _hidden(p: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows' inputs, those of all places beside one another, and the hidden layer."""
    x = p["E"].take(at, axis=0, mode="clip")
    none = at == len(p["E"])
    if none.any():
        x[none] = 0
    x = x.reshape(len(at), -1)
    return x, np.tanh(x @ p["W"].reshape(-1, WIDE) + p["b"])


def train_step(p: dict[str, np.ndarray], memory: dict[str, np.ndarray], at: np.ndarray, label: np.ndarray, rate: float = 0.08) -> float:
    """One Adagrad step on some windows; the mean loss before it. ``p["E"]`` may have a last row of zeros for places outside texts, which ``memory`` lacks."""
    n = len(at)
    x, h = _hidden(p, at)
    z = h @ p["O"] + p["c"]
    # One number for all rows is enough, unless they are so far apart that a row would vanish.
    top = z.max()
    z -= top if top - z.min() < 60 else z.max(axis=1, keepdims=True)
    right = np.arange(n), label
    mine = z[right]
    d = np.exp(z, out=z)
    total = d @ np.ones(CLASSES, dtype=np.float32)
    loss = float((np.log(total) - mine).mean())
    d *= (1 / (total * n))[:, None]
    d[right] -= np.float32(1 / n)
    g = {"O": h.T @ d, "c": d.sum(axis=0)}
    d_h = (d @ p["O"].T) * (1 - h * h)
    g["b"] = d_h.sum(axis=0)
    g["W"] = (x.T @ d_h).reshape(p["W"].shape)
    index = at.ravel()
    d_x = (d_h @ p["W"].reshape(-1, WIDE).T).reshape(-1, WIDE)
    # At most ``SLOTS`` inputs, which sixteen bits hold; a stable sort of those is linear.
    there = np.flatnonzero(index < len(memory["E"]))
    index = index[there]
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index, d_x = index[order], d_x[there[order]]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    rows, sums = index[first], np.add.reduceat(d_x, first, axis=0) if len(first) else d_x
    squares = memory["E"].take(rows, axis=0) + sums**2
    memory["E"][rows] = squares
    p["E"][rows] -= rate * sums / (np.sqrt(squares) + 1e-6)
    for k, v in g.items():
        memory[k] += v**2
        p[k] -= rate * v / (np.sqrt(memory[k]) + 1e-6)
    return loss


def _groups(batches: Iterator[pa.RecordBatch], size: int = 1 << 20):
    """(batch part, texts) of about ``size`` bytes."""
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        at = total = 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= size or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, total = i + 1, 0


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with the sum of its counts."""
    found, n = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(found)
    found = found[order]
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[first], np.add.reduceat(n[order], first)


def _count_batches(batches, most: int = 1 << 20):
    """(word, n) of a task; a word comes again where more than ``most`` are at hand."""
    words, counts, size = [], [], 0
    for _, texts in _groups(batches):
        found, n = np.unique(hashes(texts)[0], return_counts=True)
        words.append(found)
        counts.append(n)
        size += len(found)
        if size > most:
            found, n = _summed(words, counts)
            words, counts, size = [found], [n], len(found)
            if size > most // 2:
                yield _counted(found, n)
                words, counts, size = [], [], 0
    if size:
        yield _counted(*_summed(words, counts))


def _counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n): the count of every word of the corpus, by hash."""
    return materialise(texts.mapInArrow(_count_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def head_of(words: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words, ``most`` at most; equal counts stay together."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    # A few hundred rows.
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    t = words.filter(step >= least).toArrow()
    found, n = t.column("word").to_numpy().astype(np.int64).view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _slot_batches(batches):
    """(key, data): every text's slots as 16-bit numbers."""
    for part, texts in _groups(batches):
        found, bounds = slots(texts)
        size = np.diff(bounds)
        offsets = np.r_[0, np.cumsum(size)] * 2
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(found.astype("<u2").tobytes())])
        yield pa.RecordBatch.from_arrays([part.column("key"), data.cast(pa.binary())], ["key", "data"]).filter(pa.array(size > 0))


def slot_table(texts: DataFrame) -> DataFrame:
    """(key, data, copies): the slots of every text, equal texts once."""
    keyed = texts.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text")
    return materialise(keyed.mapInArrow(_slot_batches, "key long, data binary").groupBy("key", "data").agg(F.count(F.lit(1)).alias("copies")), "slots")


def _train_part(part: int, t: pa.Table, v: np.ndarray, label: np.ndarray, turn: int, rounds: int = 2, batch: int = 1024) -> pa.Table:
    """What a part's training changes, in blocks, with its number of tokens as the weight."""
    p = shaped(v)
    memory = {k: np.full_like(x, 0.01) for k, x in p.items()}
    size = len(p["E"])
    p["E"] = np.vstack([p["E"], np.zeros((1, WIDE), dtype=np.float32)])
    tokens, waiting, ready = 0, [], 0
    lists = t.sort_by([("key", "ascending"), ("copy", "ascending")]).column("data").to_pylist()
    for at in range(0, len(lists), 200):
        texts = [np.frombuffer(x, dtype="<u2") for x in lists[at : at + 200]]
        found, bounds = np.concatenate(texts).astype(np.int32), np.r_[0, np.cumsum([len(x) for x in texts])]
        some = due(bounds, turn, rounds)
        waiting.append((windows_at(some, found, bounds, size), label[found[some]]))
        tokens += len(found)
        ready += len(some)
        if ready >= 8 * batch:
            _pass(p, memory, waiting, batch)
            waiting, ready = [], 0
    _pass(p, memory, waiting, batch)
    # The change alone, which is 0 for inputs that the part doesn't hold.
    out = flat(p | {"E": p["E"][:-1]}) - v
    edges = range(0, len(out), BLOCK)
    return pa.table({
        "block": pa.array(range(len(edges)), pa.int32()), "part": pa.array([part] * len(edges), pa.int32()), "weight": pa.array([float(tokens)] * len(edges)),
        "data": pa.array([out[i : i + BLOCK].astype("<f4").tobytes() for i in edges], pa.binary()),
    })


def _trainer(v: np.ndarray, label: np.ndarray, turn: int, rounds: int):
    return lambda key, t: _train_part(key[0].as_py(), t, v, label, turn, rounds)


def _pass(p, memory, waiting, batch: int) -> None:
    at = np.concatenate([x for x, _ in waiting]) if waiting else np.zeros((0, len(PLACES)), dtype=np.int32)
    label = np.concatenate([y for _, y in waiting]) if waiting else np.zeros(0, dtype=np.int32)
    order = np.random.default_rng(len(at)).permutation(len(at))
    for i in range(0, len(at), batch):
        train_step(p, memory, at[order[i : i + batch]], label[order[i : i + batch]])


def _mean(t: pa.Table) -> pa.Table:
    """Weighted mean change of one block, in the order of the tasks, so that reruns agree."""
    t = t.sort_by("part")
    weight = t.column("weight").to_numpy()
    total = sum(w * np.frombuffer(d.as_py(), dtype="<f4").astype(np.float64) for w, d in zip(weight, t.column("data")))
    return pa.table({
        "block": t.column("block")[:1], "part": t.column("part")[:1], "weight": pa.array([float(weight.sum())]),
        "data": pa.array([(total / weight.sum()).astype("<f4").tobytes()], pa.binary()),
    })


def _score_batches(batches, v: np.ndarray, label: np.ndarray, inside: np.ndarray, known=None):
    """Scores of the slots; with ``known`` (head's hashes, its logarithms of counts, the slots') those of
    the words, short of the logarithms of counts of words outside the head, which are listed."""
    p = shaped(v)
    size = len(p["E"])
    E = np.vstack([p["E"], np.zeros((1, WIDE), dtype=np.float32)])
    given = [E @ p["W"][k] for k in range(len(PLACES))]
    seen = 0
    if known is not None:
        head, log_n, log_slot = known
        find, log_n = places(head), np.r_[log_n, 0.0]
    for part, texts in _groups(batches):
        words, bounds = hashes(texts)
        found = slot_of(words)
        at, logs = windows(found, bounds, size), np.zeros(len(found))
        for i in range(0, len(found), 8192):
            h = p["b"] + given[0][at[i : i + 8192, 0]]
            for k in range(1, len(PLACES)):
                h += given[k][at[i : i + 8192, k]]
            s = found[i : i + 8192]
            # Full blocks of rows, so that a window's numbers don't depend on how many others come with it.
            h = np.concatenate([h, np.zeros((-len(h) % 64, WIDE), dtype=np.float32)])
            z = (np.tanh(h) @ p["O"] + p["c"])[: len(s)]
            logs[i : i + 8192] = z[np.arange(len(s)), label[s]] - np.log(np.exp(z).sum(axis=1)) + inside[s]
        names, more = ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"], []
        if known is not None:
            place = find(words)
            rare = place < 0
            logs += np.where(rare, 0.0, log_n[place]) - log_slot[found]
            upto = np.r_[0, np.cumsum(rare)][bounds]
            names = ["doc_id", "n_tokens", "log_likelihood", "row", "rare"]
            row = (_part() << 40) + seen + np.arange(len(texts))
            more = [pa.array(row), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(words[rare].view(np.int64)))]
            seen += len(texts)
        # Each text's numbers are added up by themselves, so that the sum doesn't depend on its company.
        n, sums = np.diff(bounds), np.zeros(len(texts))
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(logs, bounds[:-1][full]) if len(full) else 0.0
        out = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, sums, 0.0))]
        yield pa.RecordBatch.from_arrays(out + (more or [pa.array(np.where(n > 0, sums / np.maximum(n, 1), 0.0))]), names)


def places(head: np.ndarray, bits: int = 20):
    """A function from hashes to their places in the sorted ``head``, -1 for others: by leading bits, then step by step."""
    shift = np.uint64(64 - bits)
    at = np.searchsorted(head >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
    deep = int(np.diff(at).max())

    def find(words: np.ndarray) -> np.ndarray:
        k = (words >> shift).astype(np.int32)
        low, high, out = at[k], at[k + 1], np.full(len(words), -1, dtype=np.int32)
        left = np.flatnonzero(low < high)
        for d in range(deep):
            left = left[low[left] + d < high[left]]
            same = head[low[left] + d] == words[left]
            out[left[same]] = low[left[same]] + d
            left = left[~same]
        return out

    return find


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def fit(docs: DataFrame, words: DataFrame, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, classes, log P(slot | class) and the slots' counts, from all documents and their vocabulary."""
    counts, size = np.zeros(SLOTS), 0
    # At most ``SLOTS`` rows.
    for r in words.groupBy(F.shiftrightunsigned("word", 64 - SLOT_BITS).alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        counts[r["slot"]] = r["n"]
        size += r["words"]
    label, inside = classes_of(counts)
    v = flat(start(size=inputs_for(size)))
    kind = "block int, part int, weight double, data binary"
    stored = slot_table(docs.select("text"))
    each = stored.select("key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "data")
    parts = max(1, min(8, -(-4 * int(counts.sum()) // PART)), -(-int(counts.sum()) // PART))
    dealt = each.withColumn("part", F.pmod(F.xxhash64("key", "copy", F.lit(1)), F.lit(parts)).cast("int"))
    for turn in range(rounds):
        copies = dealt.groupBy("part").applyInArrow(_trainer(v, label, turn, rounds), kind)
        some = copies.groupBy("block", (F.col("part") % 64).alias("salt")).applyInArrow(_mean, kind)
        found = some.groupBy("block").applyInArrow(_mean, kind).orderBy("block").collect()
        if found:
            v = v + np.concatenate([np.frombuffer(r["data"], dtype="<f4") for r in found])
    release(stored)
    return v, label, inside, counts


def score(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood."""
    words = vocabulary(docs.select("text"))
    v, label, inside, counts = fit(docs, words, rounds)
    head, n = head_of(words)
    known = head, np.log(n), np.log(np.maximum(counts, 0.5))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, n_tokens long, log_likelihood double, row long, rare array<long>"
    scored = materialise(source.mapInArrow(lambda b: _score_batches(b, v, label, inside, known), kind), "scores")
    rare = scored.select("row", F.explode("rare").alias("word")).join(words, "word")
    more = rare.groupBy("row").agg(F.sum(F.round(F.log("n") * FINE).cast("long")).alias("more"))
    total = F.col("log_likelihood") + F.coalesce(F.col("more") / FINE, F.lit(0.0))
    out = scored.drop("rare").join(more, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).otherwise(0.0))
