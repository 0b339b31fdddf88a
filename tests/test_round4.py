"""Disk that holds little more than the file which is written and read: finding F1 of round 4."""

import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from segmill.session import settings
from segmill.sources import readers as rd
from segmill.sources import sinks as sk

DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _labels(spark, n):
    images = spark.range(n).select("id", F.lit('a"}{\\').alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    anns = spark.range(3 * n).select("id", (F.col("id") % n).alias("image_id"), F.lit(1).alias("category_id"), F.struct(F.array(F.lit(1)).alias("size"), F.concat(F.lit('}"{\\'), "id").alias("counts")).alias("segmentation"))
    return images, anns, spark.range(1).select(F.lit(1).alias("id"), F.lit("x").alias("name"), F.lit("y").alias("supercategory"))


def _files(spark):
    return {f.getPath() for f in _list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


@contextmanager
def _splits(spark, size, rows=10_000):
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


def test_writing_leaves_no_shuffle_and_small_parts(spark, tmp_path, monkeypatch):
    sizes, keep = {}, sk.write_bundle

    def spy(path, *rest, **options):
        keep(path, *rest, **options)
        sizes["parts"] = sum(f.stat().st_size for f in (tmp_path / path.rsplit("/", 1)[-1]).glob("part-*"))

    monkeypatch.setattr(sk, "write_bundle", spy)
    before, kept = _files(spark), spark.conf.get(DROP, None)
    sk.write_coco(str(tmp_path / "doc"), *_labels(spark, 3000))
    assert not _files(spark) - before and spark.conf.get(DROP, None) == kept
    assert sizes["parts"] < (tmp_path / "doc" / "part-00000.json").stat().st_size / 3 and not list(tmp_path.glob("doc-parts*"))


def test_text_is_neither_shuffled_nor_stored_twice(spark, tmp_path, monkeypatch):
    """But that of records which lie in several splits."""
    path, stored, keep = str(tmp_path / "doc"), [], rd.materialise

    def spy(df, label, by=None):
        out, plan = keep(df, label, by), df._jdf.queryExecution().optimizedPlan().toString()
        stored.append((any(x in plan for x in ("Window", "Aggregate", "Join", "Sort")), out.count()))
        return out

    sk.write_coco(path, *_labels(spark, 3000))
    monkeypatch.setattr(rd, "materialise", spy)
    with _splits(spark, 60_000):
        splits = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        found = rd.coco_split(spark, path)
    assert splits > 5 and [found[k].count() for k in ("images", "annotations", "categories")] == [3000, 9000, 1]
    assert sum(n for moved, n in stored if moved) <= splits and sum(n for _, n in stored) <= 3000 + 9000 + 2 + 3 * splits


@pytest.mark.parametrize(("size", "rows"), [(300, 3), (100_000, 1)])
def test_odd_files_in_splits(spark, tmp_path, size, rows):
    """Records that many splits hold, objects inside records, runs of backslashes, braces in strings, other kinds; two files, whose records don't mix."""
    names = ["", "}", "{", '"', "\\", '\\"', '\\\\"}', "\\" * 7 + '"' + "\\" * 8, "ä}€{🙂", "\n}\t{ ", "plain", 'x"' * 40, "}" * 60, "{" * 60 + '"']
    doc = lambda k, more: {
        "info": {"description": 'of "{tests}"', "more": {"a": [{"b": {}}]}}, "licenses": [{"id": 1, "name": "}", "url": "{"}],
        "images": [{"id": 100 * k + i, "file_name": x, "width": 2, "height": 3, "odd": {"a": [{}, {"b": x}]}} for i, x in enumerate(names)],
        "annotations": [{"id": 100 * k + i, "image_id": i, "segmentation": {"size": [1, 2], "counts": x}} for i, x in enumerate(names)] + more,
        "categories": [],
    }
    docs = [doc(1, []), doc(2, [{"image_id": 5, "id": 299, "segmentation": {"size": [1], "counts": "}{" * 500}}])]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text("\n " * k + json.dumps(d, indent=2 * k or None, ensure_ascii=bool(k)) + "\n" * k)
    with _splits(spark, size, rows):
        found = rd.coco_split(spark, str(tmp_path))
        assert sorted((r.id, r.file_name) for r in found["images"].collect()) == sorted((r["id"], r["file_name"]) for d in docs for r in d["images"])
        anns = sorted((r.id, r.image_id, r.segmentation.counts) for r in found["annotations"].collect())
    assert anns == sorted((r["id"], r["image_id"], r["segmentation"]["counts"]) for d in docs for r in d["annotations"]) and found["categories"].count() == 0
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_files_without_records(spark, tmp_path):
    for k, text in enumerate(("{}", '{"images":[]}', "", '{"images":[{"id":1,"file_name":"cut of')):
        (tmp_path / f"{k}.json").write_text(text)
        assert [f.count() for f in rd.coco_split(spark, str(tmp_path / f"{k}.json")).values()] == [0, 0, 0]
