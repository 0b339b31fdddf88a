"""Approximate nearest neighbours as a block matrix join, here with exact results.

Vectors go to the nearest of some pivots (a bounded sample) and are stored sorted by (pivot, distance to it), in blocks; queries are dealt into groups; a (block,
group) pair that may hold a result is a tile. A tile multiplies the vectors' int8 forms. With x = s q + e the product's error is at most
|x'||f| + |e||y'| + |e||f|, which gives every distance a lower and an upper bound.
Pairs whose lower bound isn't above the k-th smallest upper bound survive, are computed anew in
double precision from the original vectors and go through a heap; the tiles' heaps are merged.

A query first meets the block that it lies in. By the triangle inequality, vectors of a block are at least as far from it as its own distance to the block's pivot is
from the block's distances, so blocks beyond the k-th distance found there are left out, with proof.

In a block, of vectors that are equal only the k + 1 smallest ids can be among a query's k
nearest, so a very common vector costs one column.

Defined results: an empty table gives no rows; equal distances go by ascending id; vectors null, zero, empty or with null or non-finite components take no part, as query or
candidate; only vectors of one dimension are compared; repeated rows count once; rows of one id but
different vectors are candidates of their own, and aren't candidates of that id's queries; a null id
takes no part; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .negatives import number_blocks

_HITS = "query_id long, query_key long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 form (as float32, in which its products are exact up to 1,040 dimensions), scale, |x'| and |e|."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((near**2).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    exact = np.float32 if a.shape[1] <= 1040 else np.float64
    return (a.astype(exact) @ b.astype(exact).T).astype(np.float64)


def search_tile(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, y: np.ndarray, k: int, step: int = 128) -> list[list[tuple[float, int]]]:
    """For each query the k nearest (score, id) of the block; rows of x may be repeated."""
    # Equal vectors: one column; the ids that can matter, smallest first.
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    same = np.r_[False, (ids[1:] == ids[:-1]) & ~new[1:]]
    ids, group = ids[~same], group[~same]
    first = np.searchsorted(group, np.arange(len(starts) + 1))
    place = np.arange(len(ids)) - first[group]
    x, few = x[starts], place <= k
    ids, group = ids[few], group[few]
    first = np.searchsorted(group, np.arange(len(starts) + 1))
    # Columns that may be the query's own row: one, or more where an id has several vectors.
    own_columns = int(np.unique(ids, return_counts=True)[1].max())
    qx, sx, nx, ex = quantise(x)
    xx = (x**2).sum(axis=1)
    found = []
    for at in range(0, len(y), step):
        part = y[at : at + step]
        qy, sy, ny, ey = quantise(part)
        yy = (part**2).sum(axis=1)
        dot = tile_product(qy, qx) * (sy[:, None] * sx[None, :])
        slack = ny[:, None] * ex[None, :] + ey[:, None] * nx[None, :] + ey[:, None] * ex[None, :]
        slack += 1e-9 * (xx[None, :] + yy[:, None])
        middle = xx[None, :] + yy[:, None] - 2 * dot
        upper, lower = middle + 2 * slack, middle - 2 * slack
        last = min(k + own_columns, upper.shape[1]) - 1
        bound = np.partition(upper, last, axis=1)[:, last]
        rows, cols = np.nonzero(lower <= bound[:, None])
        edges = np.searchsorted(rows, np.arange(len(part) + 1))
        for r in range(len(part)):
            c = cols[edges[r] : edges[r + 1]]
            # Summed from the first component to the last, as the plain definition does.
            exact = np.sqrt(np.cumsum((x[c] - part[r]) ** 2, axis=1)[:, -1])
            own, heap = int(query_ids[at + r]), []
            for d, j in sorted(zip(exact.tolist(), c.tolist())):
                if len(heap) == k and d > -heap[0][0]:
                    break
                for i in ids[first[j] : first[j + 1]].tolist():
                    if i == own:
                        continue
                    item = (-d, -i)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            found.append(sorted((-d, -i) for d, i in heap))
    return found


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def _tile(vectors: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    out: tuple[list, ...] = ([], [], [], [])
    if vectors.num_rows and asked.num_rows:
        query_ids, keys = asked.column("query_id").to_numpy(), asked.column("query_key").to_numpy()
        hits = search_tile(vectors.column("vec_id").to_numpy(), _matrix(vectors, "embedding"), query_ids, _matrix(asked, "asked"), k)
        for q, key, best in zip(query_ids.tolist(), keys.tolist(), hits):
            for d, i in best:
                for to, v in zip(out, (q, key, i, d)):
                    to.append(v)
    return pa.table(dict(zip(("query_id", "query_key", "vec_id", "score"), (*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.float64())))))


def _merge(hits: pa.Table, k: int) -> pa.Table:
    best = heapq.nsmallest(k, zip(hits.column("score").to_pylist(), hits.column("vec_id").to_pylist()))
    q, key = hits.column("query_id")[0].as_py(), hits.column("query_key")[0].as_py()
    return pa.table({
        "query_id": pa.array([q] * len(best), pa.int64()), "query_key": pa.array([key] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
        "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([d for d, _ in best], pa.float64()),
    })


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((part[:, None, :] - pivots[None]) ** 2).sum(axis=2)) for part in np.array_split(x, -(-x.size * len(pivots) // 4_000_000))])


def _place(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and the distance to it; a query's distances to all pivots are its reach."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = pa.Table.from_batches([batch.filter(pa.array(dims == d))])
            far = _far(_matrix(rows, "embedding"), pivots[d])
            best = far.argmin(axis=1)
            reach = [r if asks else None for r, asks in zip(far.tolist(), rows.column("asks").to_pylist())]
            columns = [*(c.combine_chunks() for c in rows.columns), pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(far)), best]), pa.array(reach, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "pivot", "distance", "reach"])


def _tiles(stored: DataFrame, asked: DataFrame, pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """The k nearest of each query in every block that ``pairs`` (query_id, query_key, block) names for it."""
    group = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int")
    right = pairs.join(asked, ["query_id", "query_key"]).select(F.col("block").alias("q_block"), group.alias("q_group"), "query_id", "query_key", "asked")
    tiles = right.select(F.col("q_block").alias("block"), F.col("q_group").alias("group")).distinct()
    left = stored.select("vec_id", "embedding", "block").join(tiles, "block")
    return left.groupBy("block", "group").cogroup(right.groupBy("q_block", "q_group")).applyInArrow(lambda a, b: _tile(a, b, k), _HITS)


def nearest(vectors: DataFrame, is_query, k: int = 10, block_rows: int = 4096, group_rows: int = 4096, n_pivots: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which ``is_query`` holds. ``n_pivots`` bounds the sample of pivots."""
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    fine &= F.exists("embedding", lambda v: v != 0)
    clean = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = materialise(clean.dropDuplicates(["vec_id", "embedding"]), "nearest-clean")
    out = "query_id long, rank int, vec_id long, score double"
    # A row for each dimension.
    sizes = clean.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    n, m = sum(r["n"] for r in sizes), sum(r["m"] for r in sizes)
    pivots = {}
    for r in sizes:
        some = clean.filter(F.col("dim") == r["dim"]).select("embedding", F.xxhash64("embedding", F.lit(7)).alias("h")).distinct().orderBy("h", "embedding").limit(n_pivots).collect()
        pivots[r["dim"]] = np.array([x["embedding"] for x in some], dtype=np.float64)
    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clean.schema.fields) + ", pivot int, distance double, reach array<double>"
    key = ["dim", "pivot", "distance", "vec_id"]
    ordered = clean.mapInArrow(lambda b: _place(b, pivots), held).repartitionByRange(max(1, -(-n // (4 * block_rows))), *key).sortWithinPartitions(*key)
    stored = materialise(ordered.mapInArrow(lambda b: number_blocks(b, block_rows), f"{held}, block long"), "nearest-stored")
    release(clean)
    blocks = materialise(stored.groupBy("dim", "pivot", "block").agg(F.min("distance").alias("low"), F.max("distance").alias("high")), "nearest-blocks")
    asked = stored.filter("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_key"), F.col("embedding").alias("asked"), F.col("dim").alias("d"), "reach", F.col("block").alias("home"))
    asked = materialise(asked, "nearest-asked")
    groups = max(1, -(-m // group_rows))
    home = asked.select("query_id", "query_key", F.col("home").alias("block"))
    merged = "query_id long, query_key long, rank int, vec_id long, score double"
    near = materialise(_tiles(stored, asked, home, k, groups).groupBy("query_id", "query_key").applyInArrow(lambda t: _merge(t, k), merged), "nearest-near")
    kth = near.filter(F.col("rank") == k).select("query_id", "query_key", F.col("score").alias("kth"))
    reach = asked.join(kth, ["query_id", "query_key"], "left").select("query_id", "query_key", "home", "d", "kth", F.posexplode("reach").alias("p", "away"))
    gap = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"))
    # The slack covers rounding in distances to pivots.
    within = F.col("kth").isNull() | (gap <= F.col("kth") + 1e-9 * (1 + F.col("kth") + F.col("away")))
    pairs = reach.join(blocks, (F.col("dim") == F.col("d")) & (F.col("pivot") == F.col("p")) & (F.col("block") != F.col("home")) & within).select("query_id", "query_key", "block")
    hits = near.drop("rank").unionByName(_tiles(stored, asked, pairs, k, groups))
    found = materialise(hits.groupBy("query_id", "query_key").applyInArrow(lambda t: _merge(t, k), merged).drop("query_key"), "nearest-out")
    for t in (stored, blocks, asked, near):
        release(t)
    return found
