"""Hard negatives by one-dimensional distance keys.

Vectors are whole numbers: floor(256 x) of every component. A vector x gets one more component, sqrt(M^2 - |x|^2), M being the longest
vector's length, and an anchor q gets 0: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are those of the largest
inner product. Each vector belongs to the nearest of some pivots (a bounded sample) and is stored sorted by (pivot, distance to it), in
blocks of ``block_rows``. By the triangle inequality all vectors of a block are at least as far from the anchor as the anchor's own distance to
the pivot is from the block's interval of keys. An anchor first scans the block that it lies in itself; what it finds there tells the
distance that others must beat, and the annuli around all pivots that reach below this distance are scanned next. Whatever is left is then
proven to be further away than the k-th best. So results are exact, however many annuli that takes.

Two searches run so: one for positives (the k best of the anchor's label), and one for negatives (the best of other labels within
a span of scores that the positive sets), which may also leave out blocks that are all too near.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; rows that are equal in id, label and
whole numbers count once; rows of one id but different vectors or labels are anchors and candidates of their own, but not of that id's
anchors; only vectors of one dimension are compared; empty and zero vectors score 0; equal scores go by ascending id; anchors without
positives, and positives without negatives in the span, have no rows; inner products must be within 63 bits; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release

_STORED = "vec_id long, label long, dim int, vector array<long>, key long, pivot int, distance double, reach array<double>, block long"


def whole_numbers(vectors: DataFrame, label) -> DataFrame:
    """vec_id, label, dim, key (a hash of what makes the row) and the vector's whole numbers, of rows that take part."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    vector = F.transform("embedding", lambda v: F.floor(256 * v.cast("double")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.size("embedding").alias("dim"), vector.alias("vector"))
    return rows.dropDuplicates(["vec_id", "label", "vector"]).withColumn("key", F.xxhash64("vec_id", "label", "vector"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(x: np.ndarray, pivots: np.ndarray, longest: float, anchor: bool) -> np.ndarray:
    """From the lengthened vectors to the lengthened pivots."""
    x = x.astype(np.float64)
    own = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    high = np.sqrt(np.maximum(longest**2 - (pivots**2).sum(axis=1), 0))
    squares = ((x[:, None, :] - pivots[None]) ** 2).sum(axis=2) if x.size * len(pivots) < 4_000_000 else None
    if squares is None:
        squares = np.concatenate([((part[:, None, :] - pivots[None]) ** 2).sum(axis=2) for part in np.array_split(x, -(-x.size * len(pivots) // 4_000_000))])
    return np.sqrt(squares + (own[:, None] - high[None]) ** 2)


def _place(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], longest: dict[int, float], every: int) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and the distance to it; an anchor's distances to all pivots are its reach."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = batch.filter(pa.array(dims == d))
            x, ids = _matrix(rows.column("vector")), rows.column("vec_id").to_numpy()
            x = x if d else np.zeros((len(ids), 0))
            far = distances(x, pivots[d], longest[d], anchor=False)
            best = far.argmin(axis=1)
            asks = ids % every == 0
            reach = [None] * len(ids)
            if asks.any():
                for i, r in zip(np.flatnonzero(asks), distances(x[asks], pivots[d], longest[d], anchor=True).tolist()):
                    reach[i] = r
            columns = [*rows.columns, pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(ids)), best]), pa.array(reach, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "pivot", "distance", "reach"])


def number_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one dimension and pivot, at most ``size``, make a block."""
    from pyspark import TaskContext

    block, held, last = TaskContext.get().partitionId() << 32, 0, None
    for batch in batches:
        numbers = np.empty(batch.num_rows, dtype=np.int64)
        for i, key in enumerate(zip(batch.column("dim").to_pylist(), batch.column("pivot").to_pylist())):
            if key != last or held == size:
                block, held, last = block + 1, 0, key
            numbers[i] = block
            held += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "block"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products, in doubles where those are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def _vectors(t: pa.Table, name: str) -> np.ndarray:
    return _matrix(t.column(name)) if t.num_rows else np.zeros((0, 0), dtype=np.int64)


def scan_tile(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each request.

    A request names an anchor, its label, whether that label is wanted or any other, and the span of scores (low and high, both included).
    """
    names = ("anchor", "slot", "vec_id", "score")
    out: list[list[np.ndarray]] = [[], [], [], []]
    if rows.num_rows and asked.num_rows:
        # By id, so that a stable order by score keeps equal scores by ascending id.
        rows = rows.sort_by("vec_id")
        ids, labels, x = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _vectors(rows, "vector")
        asked = asked.sort_by([("anchor", "ascending"), ("slot", "ascending")])
        anchors = asked.column("anchor").to_numpy()
        first = np.flatnonzero(np.diff(anchors, prepend=anchors[0] - 1 if anchors[0] > -(2**63) else anchors[0] + 1))
        stop = np.append(first[1:], len(anchors))
        own, mark, same = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "anchor_label", "same"))
        low, high, slots = (asked.column(c).to_numpy() for c in ("low", "high", "slot"))
        y = _vectors(asked.take(pa.array(first)), "asked")
        step = max(1, 4_000_000 // max(1, len(ids)))
        for at in range(0, len(first), step):
            scores = products(y[at : at + step], x)
            for s, i, j in zip(scores, first[at : at + step], stop[at : at + step]):
                for r in range(i, j):
                    good = np.flatnonzero(((labels == mark[r]) == same[r]) & (ids != own[r]) & (s >= low[r]) & (s <= high[r]))
                    if len(good) > 4 * k:
                        edge = np.partition(s[good], len(good) - k)[len(good) - k]
                        good = good[s[good] >= edge]
                    best = good[np.argsort(-s[good], kind="stable")][:k]
                    for to, v in zip(out, (np.full(len(best), anchors[r]), np.full(len(best), slots[r]), ids[best], s[best])):
                        to.append(v)
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32() if n == "slot" else pa.int64()) for n, c in zip(names, out)})


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(stored: DataFrame, requests: DataFrame, pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """Each request's k best over the blocks that ``pairs`` (anchor, slot, block) names; a tile for each block and group of anchors."""
    group = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(groups))
    asked = pairs.join(requests, ["anchor", "slot"]).withColumn("asked_group", group).withColumnRenamed("block", "asked_block")
    tiles = asked.select(F.col("asked_block").alias("block"), F.col("asked_group").alias("group")).distinct()
    left = stored.select("vec_id", "label", "vector", "block").join(tiles, "block")
    hits = left.groupBy("block", "group").cogroup(asked.groupBy("asked_block", "asked_group")).applyInArrow(lambda a, b: scan_tile(a, b, k), "anchor long, slot int, vec_id long, score long")
    return _best(hits, k)


def search(stored: DataFrame, blocks: DataFrame, requests: DataFrame, k: int, longest: dict[int, float], groups: int) -> DataFrame:
    """anchor, slot, vec_id, score, rank: each request's k best. ``requests`` is read several times, so it should be a table."""
    home = requests.select("anchor", "slot", F.col("home").alias("block"))
    near = materialise(_scan(stored, requests, home, k, groups), "negatives-near")
    # The distance that others must beat: the k-th best's, if there are k, or else that of the lowest score in the span.
    kth = near.filter(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
    m2 = F.lit(0.0)
    for d, m in longest.items():
        m2 = F.when(F.col("dim") == d, F.lit(float(m) ** 2)).otherwise(m2)
    squared = lambda score: F.col("square") + m2 - 2 * score.cast("double")
    slack = 1e-6 * (F.col("square") + m2 + 1)
    state = requests.join(kth, ["anchor", "slot"], "left")
    state = state.withColumn("beyond", F.sqrt(F.greatest(squared(F.greatest("low", F.coalesce("kth", F.col("low")))) + slack, F.lit(0.0))))
    state = state.withColumn("within", F.sqrt(F.greatest(squared(F.col("high")) - slack, F.lit(0.0))))
    reach = state.select("anchor", "slot", "home", F.col("dim").alias("d"), "beyond", "within", F.posexplode("reach").alias("p", "away"))
    gap = F.greatest(F.col("nearest") - F.col("away"), F.col("away") - F.col("furthest"))
    useful = (F.col("dim") == F.col("d")) & (F.col("pivot") == F.col("p")) & (gap <= F.col("beyond")) & (F.col("away") + F.col("furthest") >= F.col("within")) & (F.col("block") != F.col("home"))
    pairs = reach.join(blocks, useful).select("anchor", "slot", "block")
    found = _best(near.drop("rank").unionByName(_scan(stored, requests, pairs, k, groups).drop("rank")), k)
    out = materialise(found, "negatives-found")
    release(near)
    return out


def hard_negatives(
    vectors: DataFrame, label: str = "label", every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
    n_pivots: int = 32, block_rows: int = 4096, group_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``label`` is the SQL for a row's label. Negatives satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score. ``n_pivots`` bounds the sample of vectors that are pivots.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    clean = materialise(whole_numbers(vectors, label), "negatives-clean")
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sizes = clean.groupBy("dim").agg(F.sqrt(F.max(square)).alias("longest"), F.count("*").alias("n")).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    longest, total = {r["dim"]: r["longest"] for r in sizes}, sum(r["n"] for r in sizes)
    # Pivots: of every dimension the vectors whose hash is smallest.
    pivots = {}
    for d in longest:
        rows = clean.filter(F.col("dim") == d).select("vector", F.xxhash64("vector", F.lit(7)).alias("h")).distinct().orderBy("h", "vector").limit(n_pivots).collect()
        pivots[d] = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), d)
    placed = clean.mapInArrow(lambda b: _place(b, pivots, longest, every), _STORED.rsplit(",", 1)[0])
    key = ["dim", "pivot", "distance", "vec_id"]
    ordered = placed.repartitionByRange(max(1, -(-total // (4 * block_rows))), *key).sortWithinPartitions(*key)
    stored = materialise(ordered.mapInArrow(lambda b: number_blocks(b, block_rows), _STORED), "negatives-stored")
    release(clean)
    blocks = materialise(stored.groupBy("dim", "pivot", "block").agg(F.min("distance").alias("nearest"), F.max("distance").alias("furthest")), "negatives-blocks")
    groups = max(1, -(-(total // every) // group_rows))
    anchors = stored.filter(F.col("reach").isNotNull()).select(
        F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("asked"),
        "dim", "reach", F.col("block").alias("home"), square.alias("square"),
    )
    least, most = -(2**62), 2**62
    wanted = materialise(anchors.withColumns({"slot": F.lit(0), "same": F.lit(True), "low": F.lit(least), "high": F.lit(most)}), "negatives-anchors")
    near = search(stored, blocks, wanted, positives, longest, groups)
    spans = near.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole bounds of 100 s: up for the lower one, down for the upper.
    spans = spans.withColumns({"low": F.expr(f"-floor(cast(-{low} * positive_score as decimal(38,0)) / 100)").cast("long"), "high": F.expr(f"floor(cast({high} * positive_score as decimal(38,0)) / 100)").cast("long")})
    spans = spans.filter("low <= high")
    asked = materialise(wanted.drop("slot", "same", "low", "high").join(spans, "anchor").withColumn("same", F.lit(False)), "negatives-asked")
    found = search(stored, blocks, asked.drop("positive_id", "positive_score"), k, longest, groups)
    names = asked.select("anchor", "slot", "anchor_id", "positive_id", "positive_score")
    out = found.join(names, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out = materialise(out, "negatives-out")
    for t in (stored, blocks, wanted, near, asked, found):
        release(t)
    return out
