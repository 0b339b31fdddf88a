"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are parted into three blocks of 22, 21 and 21 bits. Two
fingerprints that differ in at most ``threshold`` bits differ in at most a third of
them in some block. In each block the anchors are the 4096 words of the perfect
binary Golay code of 23 bits: every block lies within its covering radius 3 of exactly
one of them, its home. A fingerprint goes to every anchor within 3 + threshold // 3 bits
of its block, marked where it is at home. Any linked pair then meets at the home
of either one, and per anchor those at home are compared with all who came, over all 64
bits. Only distinct fingerprints are compared; copies join by their fingerprint.

An anchor's rows are dealt into tiles of bounded size, those at home once and the others to
each tile; a tile emits a forest of its links, never all its pairs.

Words are split at the bytes 09-0D and 20; h is XXH64 with seed 42. Defined results: a
null or wordless text has fingerprint zero and is linked like any other; repeated rows
stay, and share a component; a null doc_id is no candidate for a smallest one, and a component
of such rows alone has a null id; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .pieces import utf8_column

#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
RADIUS = 3
#: Rows at home in a tile.
TILE = 4096
_BYTES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, seed: int = 42, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = (stops - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], seed) for i, j in zip(starts, stops[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of ``h``: eight 8-bit counters at a time, in runs of 255."""
    ones = np.zeros(64, dtype=np.int64)
    edges = np.arange(0, len(h), 255)
    for j in range(8):
        packed = np.add.reduceat((h >> np.uint64(j)) & _BYTES, edges)
        ones[j::8] = packed.view(np.uint8).reshape(-1, 8).astype(np.int64).sum(axis=0)
    return int(np.sum(np.left_shift(np.uint64(1), np.flatnonzero(2 * ones > len(h)).astype(np.uint64)), dtype=np.uint64))


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t or b"") for t in utf8_column(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], ["doc_id", "key", "fp"])


@functools.lru_cache(maxsize=1)
def golay_words() -> np.ndarray:
    words = np.zeros(4096, dtype=np.uint32)
    for bit in range(12):
        rest = np.uint32(GOLAY << bit)
        words ^= np.where(np.arange(4096) >> bit & 1, rest, np.uint32(0)).astype(np.uint32)
    return words


@functools.lru_cache(maxsize=1)
def _covering(reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Anchor by syndrome helpers: syndromes of all blocks' errors of weight up to ``reach``."""
    from itertools import combinations

    errors = [sum(1 << b for b in c) for w in range(reach + 1) for c in combinations(range(23), w)]
    errors = np.array(errors, dtype=np.uint32)
    s = syndromes(errors)
    order = np.argsort(s, kind="stable")
    return errors[order], np.searchsorted(s[order], np.arange(2049))


def syndromes(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> np.uint32(bit) & 1, np.uint32(GOLAY << (bit - 11)), np.uint32(0)).astype(np.uint32)
    return x


def anchor_batches(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(anchor, fp, home): a fingerprint for every anchor that may hold a linked one at home."""
    errors, edges = _covering(reach)
    for batch in batches:
        everything = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(everything), 8192):
            fp = everything[at : at + 8192]
            for k, (lo, bits) in enumerate(BLOCKS):
                x = (fp >> np.uint64(lo) & np.uint64((1 << bits) - 1)).astype(np.uint32)
                s = syndromes(x)
                n = edges[s + 1] - edges[s]
                row = np.repeat(np.arange(len(fp)), n)
                e = errors[np.repeat(edges[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((x[row] ^ e).astype(np.int64) * len(BLOCKS) + k),
                        pa.array(fp[row].view(np.int64)),
                        pa.array(np.bitwise_count(e) <= RADIUS),
                    ],
                    ["anchor", "fp", "home"],
                )


def forest(home: np.ndarray, came: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that links of ``home`` with ``came`` (which holds ``home`` too) connect.

    Rows at home without a partner are found in blocks. From the others on, whoever is reached gives one
    edge and leaves the rest, so a group of near copies doesn't cost or give all of its pairs.
    """
    rest = np.unique(came)
    wide = max(1, (1 << 20) // max(1, len(rest)))
    paired = [
        (np.bitwise_count(home[i : i + wide, None] ^ rest[None, :]) <= threshold).sum(axis=1) > 1 for i in range(0, len(home), wide)
    ]
    a, b, reached = [], [], set()
    for root in home[np.concatenate(paired)].tolist() if paired else ():
        if root in reached:
            continue
        rest = rest[rest != np.uint64(root)]
        stack = [root]
        while stack:
            x = stack.pop()
            near = np.bitwise_count(rest ^ np.uint64(x)) <= threshold
            if near.any():
                hits = rest[near].tolist()
                rest = rest[~near]
                a += [x] * len(hits)
                b += hits
                stack += hits
                reached.update(hits)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _compare(group: pa.Table, threshold: int) -> pa.Table:
    anchor = group.column("anchor").to_numpy()
    fp = group.column("fp").to_numpy().view(np.uint64)
    home = group.column("home").to_numpy(zero_copy_only=False)
    order = np.argsort(anchor, kind="stable")
    anchor, fp, home = anchor[order], fp[order], home[order]
    edges = np.flatnonzero(np.diff(anchor)) + 1
    a, b = [], []
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(anchor)]):
        if j - i > 1 and home[i:j].any():
            x, y = forest(fp[i:j][home[i:j]], fp[i:j], threshold)
            a.append(x.view(np.int64))
            b.append(y.view(np.int64))
    none = [np.zeros(0, dtype=np.int64)]
    return pa.table({"u": np.concatenate(a or none), "v": np.concatenate(b or none)})


def links(prints: DataFrame, threshold: int = 4, tile: int = TILE) -> DataFrame:
    """Edges u, v whose components are those of all links between the distinct fingerprints ``fp``."""
    reach = RADIUS + threshold // len(BLOCKS)
    came = prints.select("fp").mapInArrow(lambda b: anchor_batches(b, reach), "anchor long, fp long, home boolean")
    # There are 4096 anchors in each of three blocks, however many fingerprints.
    at_home = came.filter("home").groupBy("anchor").count().agg(F.sum("count"), F.collect_list(F.when(F.col("count") > tile, F.struct("anchor", "count")))).first()
    n = (at_home[0] or 0) // len(BLOCKS)
    hot = {r["anchor"]: -(-r["count"] // tile) for r in at_home[1]}
    own = F.lit(0)
    if hot:
        spark = prints.sparkSession
        tiles = spark.createDataFrame(sorted(hot.items()), "anchor long, tiles int")
        came = came.join(F.broadcast(tiles), "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        came = came.withColumn("own", own).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        came = came.select("anchor", "fp", (F.col("home") & (F.col("tile") == F.col("own"))).alias("home"), "tile")
    else:
        came = came.withColumn("tile", F.lit(0))
    buckets = int(min(3 * 4096, max(12, n // 1000)))
    came = came.withColumn("bucket", F.pmod(F.xxhash64("anchor", "tile"), F.lit(buckets)).cast("int"))
    return came.groupBy("bucket", "tile").applyInArrow(lambda g: _compare(g, threshold), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of all vertices of ``edges`` (u, v): alternating large and small stars until nothing changes.

    Minima come from aggregation and a join, so a star's centre never gathers its rays in one task.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = materialise(small.filter("u <> v").distinct(), "edges")
        release(now)
        now, after = nxt, mark(nxt)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, fp), key being the text's hash; and per fp its component_id and the component's first (doc_id, key)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    prints = materialise(source.mapInArrow(fingerprint_batches, "doc_id long, key long, fp long"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    one = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(first).alias("first")), "distinct")
    stars = components(links(one, threshold)).select(F.col("v").alias("fp"), "root")
    one = one.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = one.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return prints, one.select("fp", "root").join(least, "root").select("fp", "component_id", "first")


def near_duplicates(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints, named = _grouped(docs, threshold)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """One row of each component, all its columns: that of the smallest doc_id (null last), then of the smallest hash of the text, then the first as JSON."""
    prints, named = _grouped(docs, threshold)
    mine = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    gone = prints.join(named, "fp").filter(~mine.eqNullSafe(F.col("first"))).select("doc_id", "key").distinct()
    # Rows repeated as they are stand for themselves once; the others needn't be shuffled for it.
    again = prints.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))

    def join(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("key_id"), F.col("key").alias("key_hash"))
        return left.join(k, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("hash") == F.col("key_hash")), how)

    kept = join(packed, gone, "left_anti")
    if not again.isEmpty():
        # Of rows that differ in other columns only, the first in their order as JSON.
        one = join(kept, again, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", "id", "hash")
        kept = join(kept, again, "left_anti").unionByName(one)
    return kept.select("row.*")
