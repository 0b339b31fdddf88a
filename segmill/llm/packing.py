"""Best-fit packing by the linear grouping scheme.

Tokenised documents are cut into pieces of at most ``capacity`` tokens. What the packer
needs of the corpus is the count of pieces of each length, at most ``capacity`` numbers,
so the plan is made on the driver in space that doesn't grow with the corpus:

1. Large pieces are sorted by length and parted into groups of equal cardinality; each
   group's lengths are rounded up to its largest. That leaves few sizes.
2. For these sizes the configurations (ways to fill a sequence) are optimised: column
   generation, with a knapsack for the best new configuration.
3. Actual lengths take the rounded ones' places, which leaves exact gaps.
4. Small pieces go, longest first, to the sequence with the least gap that holds them.

All four steps work on (length, how many) runs. Pieces are then numbered within their
length, without a group in one task, and joined to the plan's runs.

Defined results: a null text is empty (its piece is the end id alone); very long texts are tokenised whole and cut into
full pieces and a rest; a null doc_id stays null; repeated rows are pieces of their own; an empty table packs into none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .pieces import pieces, utf8_column

_END = (0).to_bytes(4, "little")
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    p, wide = pieces(path), 4 * capacity
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        rows: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), p.ids(texts)):
            ids += _END
            for k in range(0, len(ids), wide):
                cut = ids[k : k + wide]
                for to, x in zip(rows, (doc_id, k // wide, k >> 2, len(cut) >> 2, zlib.crc32(cut))):
                    to.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """Few-size cutting plan: [(how many of each size in a sequence, sequences)], covering no more than the demand.

    Gilmore and Gomory's column generation: the master's basis is square, prices come from
    it, and an unbounded knapsack finds the configuration worth more than a sequence.
    """
    n = len(sizes)
    columns = [tuple(capacity // sizes[i] if j == i else 0 for j in range(n)) for i in range(n)]
    basis, need = np.array(columns, dtype=float).T, np.array(demand, dtype=float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            for i, s in enumerate(sizes):
                if s <= c and best[c - s] + price[i] > best[c] + 1e-12:
                    best[c], pick[c] = best[c - s] + price[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = [0] * n, capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        level, change = np.linalg.solve(basis, need), np.linalg.solve(basis, np.array(column, dtype=float))
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], columns[out] = column, tuple(column)
    level = np.maximum(np.linalg.solve(basis, need), 0)
    plan, left = [], list(demand)
    for k in np.argsort(-level):
        m = int(level[k] + 1e-9)
        m = min([m, *(left[i] // q for i, q in enumerate(columns[k]) if q)])
        if m > 0:
            plan.append((columns[k], m))
            left = [x - m * q for x, q in zip(left, columns[k])]
    return plan


class _Open:
    """Open sequences: (gap, how many alike, contents), found by least gap."""

    def __init__(self):
        self.gaps: list[int] = []
        self.at: dict[int, list[list]] = defaultdict(list)

    def add(self, gap: int, count: int, content: tuple) -> None:
        if not self.at[gap]:
            bisect.insort(self.gaps, gap)
        self.at[gap].append([count, content])

    def take(self, length: int, most: int) -> tuple[int, int, tuple] | None:
        k = bisect.bisect_left(self.gaps, length)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        run = self.at[gap][-1]
        n = min(most, run[0])
        run[0] -= n
        if not run[0]:
            self.at[gap].pop()
            if not self.at[gap]:
                self.gaps.pop(k)
        return gap, n, run[1]


def _best_fit(left: dict[int, int], box: _Open, capacity: int) -> None:
    """Each run of equal pieces, longest first, into the least gap that holds it."""
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            got = box.take(length, n)
            if got is None:
                each = capacity // length
                if n >= each:
                    box.add(capacity - each * length, n // each, (length,) * each)
                if n % each:
                    box.add(capacity - n % each * length, 1, (length,) * (n % each))
                n = 0
            else:
                gap, m, content = got
                fits = max(1, min(gap // length, n // m))
                box.add(gap - fits * length, m, content + (length,) * fits)
                n -= m * fits


def plan_runs(counts: dict[int, int], capacity: int, groups: int, large: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many sequences like it)] for the given pieces."""
    left = {k: v for k, v in counts.items() if v}
    box = _Open()
    big = [(k, left[k]) for k in sorted(left, reverse=True) if k > large and k < capacity]
    total = sum(n for _, n in big)
    if total >= 4 * groups and groups:
        # Linear grouping: equal numbers of pieces, each group as its largest length.
        runs: list[list[list[int]]] = [[]]
        room = share = -(-total // groups)
        for length, n in big:
            while n:
                m = min(n, room)
                runs[-1].append([length, m])
                n, room = n - m, room - m
                if not room:
                    runs.append([])
                    room = share
        runs = [r for r in runs if r]
        merged: dict[int, list[list[int]]] = {}
        for r in runs:
            merged.setdefault(r[0][0], []).extend(r)
        sizes = list(merged)
        stock = [merged[s] for s in sizes]
        demand = [sum(m for _, m in r) for r in stock]
        for config, times in configurations(sizes, demand, capacity):
            # Actual documents for the rounded ones; a run ends where any slot's length changes.
            slots = [i for i, q in enumerate(config) for _ in range(q)]
            while times:
                m, lengths = times, []
                for i in set(slots):
                    m = min(m, max(1, stock[i][0][1] // slots.count(i)))
                for i in slots:
                    if stock[i][0][1] >= m:
                        lengths.append(stock[i][0][0])
                        stock[i][0][1] -= m
                        if not stock[i][0][1]:
                            stock[i].pop(0)
                    else:
                        raise AssertionError("a run is shorter than planned")
                for k in lengths:
                    left[k] -= m
                box.add(capacity - sum(lengths), m, tuple(lengths))
                times -= m
    _best_fit({k: v for k, v in left.items() if v}, box, capacity)
    return [(content, n) for gap in sorted(box.at) for n, content in box.at[gap] if n]


def make_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with fewest sequences over a few groupings; ties to the first."""
    floor = -(-sum(k * v for k, v in counts.items()) // capacity)
    best: list | None = None
    for groups, large in ((16, capacity // 4), (24, capacity // 3), (12, capacity // 6), (32, capacity // 2), (0, capacity)):
        runs = plan_runs(counts, capacity, groups, large)
        if best is None or sum(n for _, n in runs) < sum(n for _, n in best):
            best = runs
        if sum(n for _, n in best) == floor:
            break
    return best or []


def placement(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): where ranks of a length go."""
    rows, used, sequence = [], defaultdict(int), 0
    for content, n in runs:
        offset = 0
        for length in content:
            rows.append((length, used[length], used[length] + n - 1, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = source.mapInArrow(lambda b: piece_batches(b, path, capacity), _PIECES)
    cut = materialise(cut, "pieces")
    # At most ``capacity`` rows, whatever the corpus holds.
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    rows = placement(make_plan(counts, capacity))
    plan = spark.createDataFrame(rows, "length int, lo long, hi long, sequence long, offset long")
    # Numbers within a length: parts of a length by hash, so that no length is one task's.
    parts = int(min(65536, max(16, sum(counts.values()) // 50_000)))
    key = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    sums = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*key)) - 1)
    ranked = ranked.join(sums.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    near = plan if len(rows) > 200_000 else F.broadcast(plan)
    placed = ranked.join(near, "length").filter("rank BETWEEN lo AND hi")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )
