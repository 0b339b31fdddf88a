"""Token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole. A huge text is dealt out as overlapping
chunks, each encoded with offsets in a task of its own. In the stretch that two chunks
share, both look for the first white space that follows the second chunk's start: the
vocabulary never joins characters across white space, so it is a boundary of either
encoding, proven from the text alone. Behind it the tokens up to the last shared white space must
agree in ids and places; then the counts are spliced there. Where there is no such
boundary or the tokens disagree, the document goes through again with a wider overlap,
at last as one chunk.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows give a
row each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .pieces import load, pieces, utf8_column

SPACE = " \t\n\r\x0b\x0c"
_CHUNK = "doc_id long, key long, n_bytes long, chunk long, chunks long, text string"
_PART = "doc_id long, key long, n_bytes long, chunk long, chunks long, head_at long, head_crc long, tail_at long, tail_crc long, before long, after long"


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    p = pieces(path)
    for batch in batches:
        texts = [t or b"" for t in utf8_column(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([len(x) >> 2 for x in p.ids(texts)], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def shared_boundaries(text: str, lo: int, hi: int) -> tuple[int, int]:
    """First and last place in [lo, hi) with white space; -1, -1 if there is none."""
    at = [i for i in range(lo, hi) if text[i] in SPACE]
    return (at[0], at[-1]) if at else (-1, -1)


def encode_chunk(text: str, first: bool, last: bool, stride: int, overlap: int, tokenizer) -> dict:
    """Splicing facts of one chunk, with places relative to the start of each shared stretch.

    ``before``: tokens from the chunk's own splice point to its end point; the crc covers
    ids and places between the shared boundaries.
    """
    e = tokenizer.encode(text, add_special_tokens=False)
    starts = np.array([o[0] for o in e.offsets], dtype=np.int64)
    ids = np.array(e.ids, dtype=np.int64)

    def stretch(lo: int) -> tuple[int, int, int]:
        a, z = shared_boundaries(text, lo, min(len(text), lo + overlap))
        if a < 0:
            return -1, -1, 0
        i, j = np.searchsorted(starts, [a, z])
        return a - lo, zlib.crc32(np.concatenate([ids[i:j], starts[i:j] - lo]).tobytes()), int(i)

    head_at, head_crc, begin = (0, 0, 0) if first else stretch(0)
    tail_at, tail_crc, end = (0, 0, len(ids)) if last else stretch(stride)
    return {"head_at": head_at, "head_crc": head_crc, "tail_at": tail_at, "tail_crc": tail_crc, "before": begin, "after": end}


def cut_batches(batches: Iterator[pa.RecordBatch], stride: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Every text's overlapping chunks, cut in one go; at most some 256 of them leave together."""
    names = [f.split()[0] for f in _CHUNK.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            doc, key, size = (batch.column(c)[row].as_py() for c in ("doc_id", "key", "n_bytes"))
            text = batch.column("text")[row].as_py()
            chunks = max(1, -(-(len(text) - overlap) // stride))
            for first in range(0, chunks, 256):
                some = range(first, min(chunks, first + 256))
                columns = [[doc] * len(some), [key] * len(some), [size] * len(some), list(some), [chunks] * len(some)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([text[k * stride : (k + 1) * stride + overlap] for k in some], pa.string())], names)


def chunk_batches(batches: Iterator[pa.RecordBatch], path: str, stride: int, overlap: int) -> Iterator[pa.RecordBatch]:
    t = load(path)
    for batch in batches:
        for row in batch.to_pylist():
            found = encode_chunk(row["text"], row["chunk"] == 0, row["chunk"] == row["chunks"] - 1, stride, overlap, t)
            del row["text"]
            yield pa.RecordBatch.from_pylist([row | found], schema=pa.schema([(k.split()[0], pa.int64()) for k in _PART.split(", ")]))


def _splice(parts: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, copies, n_tokens or null where a splice isn't proven)."""
    one = parts.groupBy("doc_id", "key", "n_bytes", "chunk", "chunks").agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("head_at", "head_crc", "tail_at", "tail_crc", "before", "after")],
    )
    # Each inner boundary gives the same key to the chunk on its left (tail) and on its right (head).
    sides = one.select(
        "doc_id", "key", "n_bytes", "chunks", "copies", (F.col("after") - F.col("before")).alias("n"),
        F.explode(F.array(
            F.struct(F.col("chunk").alias("at"), F.col("head_at").alias("place"), F.col("head_crc").alias("crc")),
            F.struct((F.col("chunk") + 1).alias("at"), F.col("tail_at").alias("place"), F.col("tail_crc").alias("crc")),
        )).alias("s"),
    )
    joint = sides.groupBy("doc_id", "key", "n_bytes", "chunks", "s.at").agg(
        F.max("copies").alias("copies"),
        (F.min("s.place") == F.max("s.place")).alias("same_place"),
        (F.min("s.crc") == F.max("s.crc")).alias("same_tokens"),
        (F.min("s.place") >= 0).alias("found"),
        F.sum("n").alias("n"),
    )
    edge = (F.col("at") == 0) | (F.col("at") == F.col("chunks"))
    good = edge | (F.col("same_place") & F.col("same_tokens") & F.col("found"))
    # Each chunk's tokens stand at both of its boundaries: half of the sum is the document's count.
    return joint.groupBy("doc_id", "key", "n_bytes").agg(
        F.max("copies").alias("copies"), F.when(F.bool_and(good), F.sum("n") / 2).cast("long").alias("n_tokens")
    )


def token_counts(docs: DataFrame, path: str, chunk_chars: int = 32768, overlap: int = 1024, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.filter(F.length("text") <= chunk_chars)
    done = [whole.mapInArrow(lambda b: count_batches(b, path), "doc_id long, n_bytes long, n_tokens long")]
    huge = docs.filter(F.length("text") > chunk_chars).withColumn("key", F.xxhash64("text"))
    failed: DataFrame | None = None
    while True:
        left = huge if failed is None else huge.join(failed, "key", "left_semi")
        step, wide = chunk_chars, overlap
        sized = left.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        rows = sized.mapInArrow(lambda b, s=step, w=wide: cut_batches(b, s, w), _CHUNK)
        # As many parts as the session deals out, which aren't put together again: encoding costs more than bytes tell. Copies of a text go by their ids too.
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "key", "chunk")
        parts = rows.mapInArrow(lambda b, s=step, w=wide: chunk_batches(b, path, s, w), _PART)
        found = materialise(_splice(parts), "token-counts")
        done.append(found.filter("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy"))
        bad = found.filter("n_tokens IS NULL").select("key").distinct()
        if bad.isEmpty():
            break
        failed = bad
        # A wider overlap and longer strides; in the end no text has a second chunk.
        overlap, chunk_chars = overlap * 16, chunk_chars * 8
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
