"""The mix's queue and the pipeline's stages against plain versions."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segmill.llm import pipeline as pl
from segmill.llm.mixing import mix, repeated
from segmill.llm.pieces import vocabulary_path
from segmill.llm.toxicity import toxicity
from tests.llm.test_simhash_mixing import brute_fingerprint, closure

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: The parts of a source, which follow one another, for tables of fewer than 256,000 rows.
PARTS = 64


def plain_queue(rows, epochs=3):
    """Served times by (doc_id, size, shuffled), document by document: rows have rank, target and source_size too."""
    turns, budget = [], sum(r.size for r in rows)
    for rank in {r.rank for r in rows}:
        mine = sorted((r for r in rows if r.rank == rank), key=lambda r: ((r.shuffled >> 32) % PARTS, r.shuffled, r.doc_id is not None, r.doc_id or 0, r.size))
        upto = 0
        for r in mine:
            upto += r.size
            for k in range(epochs):
                turns.append(((upto + k * r.source_size) / r.target if r.target else 0.0, rank, k, r.shuffled, r.doc_id or 0, r.size, r.doc_id))
    served, used = Counter(), 0
    for finish, rank, k, shuffled, _, size, doc_id in sorted(t[:6] + (t[6],) for t in turns if t[5]):
        used += size
        if used > budget:
            break
        served[doc_id, size, shuffled] += 1
    return served


def test_queue_equals_serving_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("w" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(0, 60)))), "en", str(rng.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.15, 0.05])), 1) for i in range(400)]
    rows += [(1000, "the same row again", "en", "a", 1)] * 30 + [(2000 + i, None if i % 2 else "", "en", "b", 1) for i in range(4)] + [(3000, "null source here", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).withColumn("rank", F.when(F.col("source").isNull(), 4).otherwise(F.ascii("source") - 97)).collect()
    want = plain_queue(got)
    found = Counter()
    for r in got:
        found[r.doc_id, r.size, r.shuffled] += r.served if r.size else 0
    assert +found == +want and len(want) > 200


def test_repeated_rows_get_exactly_their_turns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "some words " * int(rng.integers(1, 20)), "en", "ab"[i % 2], 1) for i in range(60)]
    # One row many times, and rows that differ only in a column that the mix doesn't read.
    rows += [(900, "again and again and again", "en", "b", 1)] * 5001 + [(901, "twins", f"l{i % 3}", "b", 1) for i in range(7)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    served = {r[0]: r[1] for r in mix(docs).groupBy("doc_id").agg(F.sum("served")).collect()}
    found = Counter(r.doc_id for r in repeated(docs).select("doc_id").collect())
    assert {k: n for k, n in served.items() if n} == dict(found)
    assert repeated(docs).schema == docs.schema and repeated(docs.limit(0)).collect() == []


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    clean = [" ".join(rng.choice(words, int(rng.integers(20, 120)))) for _ in range(120)]
    bad = [" ".join([*rng.choice(words, 30), *rng.choice(["vile", "nasty", "rotten"], 8), *rng.choice(words, 10)]) for _ in range(60)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(clean + bad)]
    rows += [(500 + i, clean[i % 4], "en", "abc"[i % 3], 1) for i in range(40)] + [(600, None, None, None, None), (601, "", "en", "a", 0), (602, "ü" * 9000, "en", "a", 9000), (3, clean[3], "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    assert [n for n, _ in pl.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    columns = SCHEMA.replace(" long", "").replace(" string", "").split(", ")

    kept = pl.drop_toxic(spark, docs, sf).cache()
    scores = {(r.doc_id, r.score) for r in toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    low = {i for i, s in scores if s < 0.7}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == low
    assert sum(i >= 120 for i in low if i < 180) <= 6 and sum(i < 120 for i in low) >= 114

    single = pl.drop_near_duplicates(spark, kept, sf).cache()
    found = kept.collect()
    part = closure(list(range(len(found))), [brute_fingerprint(r.text) for r in found])
    groups = {}
    for i, r in enumerate(found):
        groups.setdefault(part[i], []).append(r.doc_id)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups.values())

    mixed = pl.mix_sources(spark, single, sf).cache()
    times = {r.doc_id: r.served for r in mix(single).collect() if r.served}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == times

    packed = pl.pack_sequences(spark, mixed, sf).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in single.collect()}
    size = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert Counter(p.doc_id for p in packed if p.piece == 0) == times
    total = Counter()
    for p in packed:
        total[p.doc_id] += p.length
    assert total == {i: size[i] * n for i, n in times.items()}
    sequences = {}
    for p in packed:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048

    whole = pl.run(spark, sf).collect()
    key = lambda p: (p.doc_id, p.piece, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pl.run(spark, str(tmp_path)).collect() == []
