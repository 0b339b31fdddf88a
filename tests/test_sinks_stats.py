"""Bundles with odd ids and fields, checkpoints of runs that stop, and order statistics with an outlier."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import evaluate as ev
from segmill.operators import stats as st
from segmill.sources import readers as rd
from segmill.sources import sinks as sk

IMAGES = "id long, file_name string, width int, height int"


def frames(spark, images, anns, columns="id, image_id, category_id, area, bbox"):
    a = spark.createDataFrame(anns, "id long, image_id long, category_id int, area double, bbox array<double>").select(*[c.strip() for c in columns.split(",")])
    return spark.createDataFrame(images, IMAGES), a, spark.createDataFrame([(1, "object", "object")], "id int, name string, supercategory string")


def whole(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


ROWS = ([(1, "a.jpg", 2, 3), (1, "a.jpg", 2, 3), (1, None, 4, 5), (None, 'q",{"id":9.jpg', None, None), (7, "line\nbreak.jpg", 1, 1)], [(5, 1, 1, 2.5, [0.0, 1.0, 2.0, 3.0]), (5, 1, 1, None, None), (None, None, None, None, None)])


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("columns", ["id, image_id, category_id, area, bbox", "bbox, area, category_id, id, image_id"])
def test_bundle_keeps_every_record(spark, tmp_path, parts, columns):
    path = tmp_path / "bundle"
    images, anns, cats = frames(spark, *ROWS, columns)
    sk.write_bundle(str(path), images, anns, cats, 'say "so"', parts)
    doc = whole(path)
    assert [len(doc[k]) for k in ("images", "annotations", "categories")] == [5, 3, 1] and doc["info"] == {"description": 'say "so"'}
    assert [i["id"] for i in doc["images"]] == [None, 1, 1, 1, 7] and [a["id"] for a in doc["annotations"]] == [None, 5, 5]
    back = rd.bundle(spark, str(path))
    assert sorted(back["images"].select("id", "file_name", "width", "height").collect(), key=str) == sorted(images.collect(), key=str)
    assert sorted(back["annotations"].select("id", "image_id", "category_id", "area", "bbox").collect(), key=str) == sorted(anns.select("id", "image_id", "category_id", "area", "bbox").collect(), key=str)
    assert back["categories"].count() == 1


def test_bundle_of_empty_sections(spark, tmp_path):
    images, anns, cats = frames(spark, *ROWS)
    sk.write_bundle(str(tmp_path / "b"), images.limit(0), anns.limit(0), cats, parts=3)
    assert whole(tmp_path / "b")["images"] == [] and rd.bundle(spark, str(tmp_path / "b"))["annotations"].count() == 0


def test_unknown_records_raise(spark, tmp_path):
    (tmp_path / "f").write_text('{"images":[\n{"id":1,"what":2}\n]}')
    with pytest.raises(Exception, match="no record of a bundle"):
        rd.bundle(spark, str(tmp_path / "f"))["images"].collect()


def test_checkpoint_resumes_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "done")
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(99, None)], "id int, class string")
    assert sk.finished(spark, path).collect() == []
    sk.append_checkpoint(path, rows.filter("class = 'a'"))
    with pytest.raises(Exception, match="stopped"):
        sk.append_checkpoint(path, rows.filter("class = 'b'").withColumn("id", F.when(F.col("id") > 20, F.raise_error(F.lit("stopped")).cast("int")).otherwise(F.col("id"))))
    left = sk.resume(path, rows)
    assert {r["class"] for r in left.collect()} == {"b", "c", None}
    sk.append_checkpoint(path, left)
    sk.append_checkpoint(path, rows.filter("class = 'c'"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(r.id for r in rows.collect())
    assert sk.resume(path, rows).count() == 0


def test_medians_with_an_outlier(spark):
    values = [float(v) for v in np.random.default_rng(2).permutation(20_001)] + [1e12]
    df = spark.createDataFrame([(v, int(v) % 3) for v in values], "v double, g int")
    assert st.median(df, "v").first().median == float(np.median(values))
    for r in st.median(df, "v", ["g"]).collect():
        assert r["median"] == float(np.median([v for v in values if int(v) % 3 == r.g]))
    # The outlier doesn't put all other values into one span.
    sizes = [r["count"] for r in st.with_spans(df, "v", []).groupBy("__span").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 3 * len(values) / 64
    assert st.median(df.limit(0), "v").first().median is None and st.median(df.limit(0), "v", ["g"]).count() == 0


def test_ap_takes_the_best_hundred(spark):
    box = "image_id long, ann_id long, ord int, l int, t int, r int, b int, area long, score double"
    gt = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10, 100, 0.0)], box)
    far = [(1, 10 + i, i, 50, 50, 60, 60, 100, 0.9) for i in range(120)]
    hit = [(1, 500, 500, 0, 0, 10, 10, 100, 0.5)]
    ap = lambda rows, **o: ev.coco_ap(gt, spark.createDataFrame(rows, box), **o).first().AP50
    assert ap(far + hit) == 0.0 and ap(far + hit, most=0) > 0 and ap(far[:50] + hit) > 0
