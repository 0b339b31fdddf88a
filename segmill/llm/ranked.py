"""Ranked lexical search over a tiered index, with exact results.

Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. A document's score for an item sums, over the
item's distinct terms, weight times impact, all in whole numbers (see :func:`weight` and :func:`impacts`).

One pass over the texts keeps, for every document, its number of terms and the frequencies of those terms that items ask for.
Counts of each term's impacts by level then deal its postings into tiers: the highest impacts, up to the tier's capacity, come first. Every term has,
below each tier, a residual bound: no posting further down has a higher impact. Only the upper tiers are stored as an
index; the lowest is the pass's own table, which holds everything. Tiers are read from the first on. An item is settled
in a tier when the k-th best score found there is above the sum of its terms' residual bounds: then only documents already seen, whose own score and
bounds of terms still missing reach that far, can be among its k best, and these get their whole score. Items without this
proof fall through to the next tier; the last one holds all that is left, where scores are whole and need none.

Items are dealt into groups of about ``group_terms`` terms, the only thing that goes to every task.

Defined results: null and empty texts, and texts without terms, don't count as documents; items without terms have no
rows; items of equal id and text count once, and items of one id but different texts have rows each; a null item id is an item like
others; documents with a null id count in all statistics but aren't returned; repeated documents are ranked one by one; equal scores go by
ascending id; very long texts are read whole, slice by slice; an empty table of documents or items gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .pieces import utf8_column
from .words import lower_table, word_hashes, word_spans

_CODE = lower_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_SLICE = 1 << 18
#: Impacts are below 10**6; a level is a span of 4096 of them.
_LEVEL_BITS = 12
_HITS = "item int, row_id long, doc_id long, score long"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(n, n_docs: int, total: int):
    """m of documents of n terms."""
    return 50 + (50 * n * n_docs) // max(1, total)


def impacts(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def slices(texts: list[bytes], size: int = _SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of joined texts, the places where texts start in them, and the texts' numbers; huge texts are cut between terms."""
    group, total = [], 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or total + len(t) > size):
            where = np.cumsum([0] + [len(texts[j]) + 1 for j in group[:-1]])
            yield _CODE[np.frombuffer(b" ".join(texts[j] for j in group), dtype=np.uint8)], where, np.array(group)
            group, total = [], 0
        if t is None:
            return
        if len(t) <= size:
            group.append(i)
            total += len(t) + 1
            continue
        view, at = np.frombuffer(t, dtype=np.uint8), 0
        while at < len(view):
            end = min(len(view), at + size)
            while end < len(view) and _CODE[view[end]]:
                gap = np.flatnonzero(_CODE[view[end : end + size]] == 0)
                end += int(gap[0]) if len(gap) else min(size, len(view) - end)
            yield _CODE[view[at:end]], np.zeros(1, dtype=np.int64), np.array([i])
            at = end


class Dictionary:
    """Numbers of known terms, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        joined = np.frombuffer(b" ".join(terms), dtype=np.uint8)
        code = _CODE[joined]
        starts, stops = word_spans(code)
        hashes = word_hashes(code, starts, stops)
        self.order = np.argsort(hashes, kind="stable")
        self.code, self.starts, self.sizes = code, starts[self.order], (stops - starts)[self.order]
        self.hashes = hashes[self.order]
        same = np.unique(self.hashes, return_counts=True)[1]
        self.depth = int(same.max()) if len(same) else 0

    def find(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for others."""
        out = np.full(len(starts), -1, dtype=np.int64)
        asked = word_hashes(code, starts, stops)
        first = np.searchsorted(self.hashes, asked)
        for shift in range(self.depth):
            place = np.minimum(first + shift, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[place] == asked) & (self.sizes[place] == stops - starts) & (out < 0))
            if not len(hit):
                continue
            place = place[hit]
            size = self.sizes[place]
            begin = np.cumsum(size) - size
            step = np.arange(int(size.sum()))
            wrong = code[step + np.repeat(starts[hit] - begin, size)] != self.code[step + np.repeat(self.starts[place] - begin, size)]
            fine = np.add.reduceat(wrong, begin, dtype=np.int64) == 0
            out[hit[fine]] = self.order[place[fine]]
        return out


def term_counts(texts: list[bytes], known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, known term, frequency) in order of text and term."""
    n, keys, counts = np.zeros(len(texts), dtype=np.int64), [], []
    size = max(1, len(known.hashes))
    for code, where, group in slices(texts):
        starts, stops = word_spans(code)
        owner = group[np.searchsorted(where, starts, side="right") - 1]
        n += np.bincount(owner, minlength=len(texts))
        term = known.find(code, starts, stops)
        found, c = np.unique(owner[term >= 0] * size + term[term >= 0], return_counts=True)
        keys.append(found)
        counts.append(c)
    if not keys:
        return n, *(np.zeros(0, dtype=np.int64) for _ in range(3))
    key, c = np.concatenate(keys), np.concatenate(counts)
    found, back = np.unique(key, return_inverse=True)
    return n, found // size, found % size, np.bincount(back, c, len(found)).astype(np.int64)


def _packed(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """Each row's numbers as 32-bit ones in a byte string, which costs the JVM less than an array."""
    ends = (np.searchsorted(owner, np.arange(rows + 1)) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of packed numbers."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
    found = np.frombuffer(data, dtype="<i4", count=int(ends[-1]))[ends[0] :] if data is not None else np.zeros(0, dtype="<i4")
    return np.repeat(np.arange(len(column)), np.diff(ends)), found.astype(np.int64)


def _forward(batches: Iterator[pa.RecordBatch], known: Dictionary) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            batch = whole.slice(at, 250)
            n, owner, term, tf = term_counts([t or b"" for t in utf8_column(batch.column("text"))], known)
            columns = [batch.column("row_id"), batch.column("doc_id"), pa.array(n), _packed(term, owner, len(n)), _packed(tf, owner, len(n))]
            out = pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))


def _postings(batch: pa.RecordBatch, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of each posting of a batch."""
    row, terms = _numbers(batch.column("terms"))
    return row, terms, _numbers(batch.column(of))[1]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        found = np.bincount(_numbers(batch.column("terms"))[1], minlength=len(total))
        found[: len(total)] += total
        total = found
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held].astype(np.int64))], ["term", "df"])


def _levels(batches: Iterator[pa.RecordBatch], n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """How many postings of each term have an impact of each level."""
    for batch in batches:
        row, term, tf = _postings(batch, "tfs")
        m = length_terms(batch.column("n").to_numpy(), n_docs, total)
        key, count = np.unique(term << 8 | impacts(tf, m[row]) >> _LEVEL_BITS, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key >> 8).astype(np.int32)), pa.array((key & 255).astype(np.int32)), pa.array(count)], ["term", "level", "postings"])


def _tiers(batches: Iterator[pa.RecordBatch], n_docs: int, total: int, limits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's postings, a row for each tier that it is in; ``limits[t, term]`` is the lowest level of tier t."""
    for batch in batches:
        row, term, tf = _postings(batch, "tfs")
        value = impacts(tf, length_terms(batch.column("n").to_numpy(), n_docs, total)[row])
        tier = (value >> _LEVEL_BITS < limits[:, term]).sum(axis=0)
        for t in range(len(limits)):
            mine = tier == t
            here = np.unique(row[mine])
            local = np.searchsorted(here, row[mine])
            kept = batch.take(pa.array(here))
            columns = [pa.array(np.full(len(here), t, dtype=np.int32)), kept.column("row_id"), kept.column("doc_id"), _packed(term[mine], local, len(here)), _packed(value[mine], local, len(here))]
            yield pa.RecordBatch.from_arrays(columns, ["tier", "row_id", "doc_id", "terms", "values"])


class Asked:
    """Items and their terms: for every term the items that hold it, and the terms' weights."""

    def __init__(self, pairs: np.ndarray, weights: np.ndarray, n_items: int):
        order = np.lexsort((pairs[:, 0], pairs[:, 1]))
        self.items, self.weights, self.n_items = pairs[order, 0], weights, n_items
        self.first = np.searchsorted(pairs[order, 1], np.arange(len(weights) + 1))
        self.pairs = pairs
        most = int(np.bincount(pairs[:, 0], minlength=1).max(initial=0)) * int(weights.max(initial=0)) * 1_000_000
        self.doubles = most < 1 << 53

    def sums(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """rows x items: the sum of ``value`` over postings whose term the item holds. Exact."""
        many = self.first[term + 1] - self.first[term]
        begin = np.cumsum(many) - many
        item = self.items[np.arange(int(many.sum())) + np.repeat(self.first[term] - begin, many)]
        cell = np.repeat(row, many) * self.n_items + item
        if self.doubles:
            out = np.bincount(cell, np.repeat(value, many), rows * self.n_items).astype(np.int64)
        else:
            out = np.zeros(rows * self.n_items, dtype=np.int64)
            np.add.at(out, cell, np.repeat(value, many))
        return out.reshape(rows, self.n_items)


class _Best:
    """The k best (score, id) of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.zeros(n_items, dtype=np.int64)
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, row: np.ndarray) -> None:
        self.rows.append(np.stack([item, score, doc, row]))
        self.held += len(item)
        if self.held > 200_000:
            self.squeeze()

    def squeeze(self) -> np.ndarray:
        if not self.rows:
            return np.zeros((4, 0), dtype=np.int64)
        item, score, doc, row = np.concatenate(self.rows, axis=1)
        order = np.lexsort((row, doc, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.floor) + 1))
        keep = order[np.arange(len(item)) - first[item] < self.k]
        last = first[:-1] + self.k - 1
        full = np.diff(first) >= self.k
        self.floor[full] = score[order[last[full]]]
        self.rows = [np.stack([item, score[order], doc[order], row[order]])[:, np.arange(len(item)) - first[item] < self.k]]
        self.held = len(keep)
        return self.rows[0]


def _by_document(batches: Iterator[pa.RecordBatch], n_items: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of at most some million cells, with the postings; a document's rows of several tiers come together, as they are sorted."""
    rows = max(1, min(1000, 2_000_000 // max(1, n_items)))
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = int(np.flatnonzero(np.diff(now.column("row_id").to_numpy(), prepend=-1))[-1])
        yield from _cut(now.slice(0, last), rows)
        rest = now.slice(last)
    if rest is not None:
        yield from _cut(rest, rows)


def _cut(rows: pa.Table, size: int):
    ids = rows.column("row_id").to_numpy()
    new = np.flatnonzero(np.diff(ids, prepend=-1)) if len(ids) else np.zeros(0, dtype=np.int64)
    for i in range(0, len(new), size):
        a, b = int(new[i]), int(new[i + size]) if i + size < len(new) else len(ids)
        part = rows.slice(a, b - a).combine_chunks().to_batches()[0]
        place = np.searchsorted(new[i : i + size], np.arange(a, b), side="right") - 1
        row, term, value = _postings(part, "values")
        yield part.take(pa.array(new[i : i + size] - a)), place[row], term, value


def _of_forward(batches: Iterator[pa.RecordBatch], n_items: int, n_docs: int, total: int):
    """Like :func:`_by_document`, from the table that holds all."""
    rows = max(1, min(1000, 2_000_000 // max(1, n_items)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            row, term, tf = _postings(part, "tfs")
            yield part, row, term, impacts(tf, length_terms(part.column("n").to_numpy(), n_docs, total)[row])


def _top(parts, asked: Asked, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(asked.n_items, k)
    for docs, row, term, value in parts:
        score = asked.sums(row, term, value * asked.weights[term], docs.num_rows)
        r, i = np.nonzero(score > 0)
        good = score[r, i] >= best.floor[i]
        r, i = r[good], i[good]
        best.add(i, score[r, i], docs.column("doc_id").to_numpy()[r], docs.column("row_id").to_numpy()[r])
    item, score, doc, row = best.squeeze()
    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(row), pa.array(doc), pa.array(score)], ["item", "row_id", "doc_id", "score"])


def _candidates(batches: Iterator[pa.RecordBatch], asked: Asked, bounds: np.ndarray, theta: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents whose score so far, with the residual bounds of the terms not seen in them, reaches the item's k-th best. ``theta`` below 0: not asked."""
    whole = np.zeros(asked.n_items, dtype=np.int64)
    np.add.at(whole, asked.pairs[:, 0], bounds[asked.pairs[:, 1]])
    for docs, row, term, value in _by_document(batches, asked.n_items):
        upper = whole + asked.sums(row, term, value * asked.weights[term] - bounds[term], docs.num_rows)
        r, i = np.nonzero((upper >= theta) & (theta >= 0))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), docs.column("row_id").take(pa.array(r))], ["item", "row_id"])


def _whole(batches: Iterator[pa.RecordBatch], asked: Asked, n_docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Whole scores of documents, each for the items it was found for."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            row, term, tf = _postings(part, "tfs")
            value = impacts(tf, length_terms(part.column("n").to_numpy(), n_docs, total)[row])
            score = asked.sums(row, term, value * asked.weights[term], part.num_rows)
            found = part.column("found")
            r = np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
            i = found.flatten().to_numpy()
            columns = [pa.array(i.astype(np.int32)), part.column("row_id").take(pa.array(r)), part.column("doc_id").take(pa.array(r)), pa.array(score[r, i])]
            yield pa.RecordBatch.from_arrays(columns, ["item", "row_id", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, keys, terms = utf8_column(batch.column("text")), [], [], []
        for i, t in enumerate(texts):
            mine = set()
            for code, _, _ in slices([t or b""]):
                mine.update(code.tobytes()[a:b] for a, b in zip(*word_spans(code)))
            ids += [i] * len(mine)
            terms += sorted(mine)
        take = pa.array(ids, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(take), batch.column("item_key").take(take), pa.array(terms, pa.binary())], ["item_id", "item_key", "term"])


def _leading(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_group(docs: DataFrame, items: list, k: int, capacities: tuple[int, ...]) -> list[tuple]:
    """Result rows of one group of items, which are (item_id, item_key, terms)."""
    terms = sorted({t for _, _, ts in items for t in ts})
    place = {t: j for j, t in enumerate(terms)}
    pairs = np.array([(i, place[t]) for i, (_, _, ts) in enumerate(items) for t in ts], dtype=np.int64).reshape(-1, 2)
    known = Dictionary(terms)
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row_id long, doc_id long, n long, terms binary, tfs binary"
    forward = materialise(source.mapInArrow(lambda b: _forward(b, known), schema), "ranked-forward")
    n_docs, total = forward.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    # At most a row for each term asked for.
    for t, c in forward.select("terms").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[t] = c
    weights = np.array([weight(n_docs, int(c)) for c in df], dtype=np.int64)
    asked = Asked(pairs, weights, len(items))

    from pyspark.sql import Window

    levels = forward.mapInArrow(lambda b: _levels(b, n_docs, total), "term int, level int, postings long").groupBy("term", "level").agg(F.sum("postings").alias("postings"))
    above = F.sum("postings").over(Window.partitionBy("term").orderBy(F.desc("level")))
    levels = levels.withColumn("above", above).groupBy("term").agg(
        *[F.min(F.when(F.col("above") <= c, F.col("level"))).alias(f"low{t}") for t, c in enumerate(capacities)],
        *[F.max(F.when(F.col("above") > c, F.col("level"))).alias(f"next{t}") for t, c in enumerate(capacities)],
    )
    # A tier takes the levels down to ``limits``; no posting below it has an impact above the residual.
    limits, residual = np.full((len(capacities), len(terms)), 256, dtype=np.int64), np.zeros((len(capacities) + 1, len(terms)), dtype=np.int64)
    for row in levels.collect():
        for t in range(len(capacities)):
            low, below = row[f"low{t}"], row[f"next{t}"]
            limits[t, row["term"]] = 256 if low is None else low
            residual[t, row["term"]] = 0 if below is None else ((below + 1) << _LEVEL_BITS) - 1
    listed = forward.filter("doc_id IS NOT NULL AND octet_length(terms) > 0")
    index = materialise(listed.mapInArrow(lambda b: _tiers(b, n_docs, total, limits), "tier int, row_id long, doc_id long, terms binary, values binary"), "ranked-index", by="tier")
    out, open_items = [], np.arange(len(items))
    for t in range(len(capacities)):
        part = Asked(pairs[np.isin(pairs[:, 0], open_items)], weights, len(items))
        bounds = residual[t] * weights
        # The sum that a document never seen so far can reach.
        unseen = np.zeros(len(items), dtype=np.int64)
        np.add.at(unseen, part.pairs[:, 0], bounds[part.pairs[:, 1]])
        read = index.filter(F.col("tier") <= t).select("row_id", "doc_id", "terms", "values")
        read = read.repartition("row_id").sortWithinPartitions("row_id") if t else read
        top = _leading(read.mapInArrow(lambda b, a=part: _top(_by_document(b, a.n_items), a, k), _HITS), k)
        theta = np.full(len(items), -1, dtype=np.int64)
        for i, s in top.filter(F.col("rank") == k).select("item", "score").collect():
            if s > unseen[i]:
                theta[i] = s
        settled = np.flatnonzero(theta >= 0)
        if len(settled):
            found = read.mapInArrow(lambda b, a=part, v=bounds, o=theta: _candidates(b, a, v, o), "item int, row_id long")
            found = found.groupBy("row_id").agg(F.collect_list("item").alias("found"))
            exact = listed.join(found, "row_id").mapInArrow(lambda b, a=part: _whole(b, a, n_docs, total), _HITS)
            out += [(items[r["item"]][0], r["rank"], r["doc_id"], r["score"], t) for r in _leading(exact.filter("score > 0"), k).collect()]
            open_items = np.setdiff1d(open_items, settled)
    if len(open_items):
        part = Asked(pairs[np.isin(pairs[:, 0], open_items)], weights, len(items))
        top = _leading(listed.mapInArrow(lambda b: _top(_of_forward(b, part.n_items, n_docs, total), part, k), _HITS), k)
        out += [(items[r["item"]][0], r["rank"], r["doc_id"], r["score"], len(capacities)) for r in top.collect()]
    release(index)
    release(forward)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, capacities: tuple[int, ...] = (2_000, 64_000), group_terms: int = 65_536) -> DataFrame:
    """item_id, rank, doc_id, score and the tier in which the item was settled: each item's k best documents."""
    spark = docs.sparkSession
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text").filter("text IS NOT NULL").dropDuplicates(["item_id", "text"])
    terms = source.mapInArrow(_item_terms, "item_id long, item_key long, term binary")
    terms = materialise(terms, "ranked-items")
    groups = max(1, -(-terms.count() // group_terms))
    schema = "item_id long, rank int, doc_id long, score long, tier int"
    out = []
    for g in range(groups):
        # The bound: about ``group_terms`` terms, or those of one item; and k rows for each item.
        mine = terms.filter(F.pmod(F.xxhash64("item_id", "item_key"), F.lit(groups)) == g)
        found = mine.groupBy("item_id", "item_key").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id", "item_key").collect()
        if found:
            rows = _search_group(docs, [(r[0], r[1], [bytes(t) for t in r[2]]) for r in found], k, capacities)
            out.append(materialise(spark.createDataFrame(rows, schema).coalesce(1), "ranked-out"))
    release(terms)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
