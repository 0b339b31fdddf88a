"""Work and memory that don't grow with a batch or a part, grids with missing cells, and comparisons at exact borders."""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from segmill.functions import geometry as g
from segmill.operators import graph as gr
from segmill.operators import windows as wn
from segmill.operators.areas import _partial_gradients, mean_gradients
from segmill.operators import runs as rn
from segmill.plans.run_queries import _ragged
from segmill.sources import sinks as sk
from segmill.session import dealt


def test_functions_get_slices(spark):
    seen = []

    @rn.arrow_udf("bigint")
    def total(a: pa.Array) -> pa.Array:
        seen.append((len(a), a.nbytes))
        return pa.array([sum(x) if x is not None else None for x in a.to_pylist()], pa.int64())

    lists = [list(range(k % 500)) if k % 7 else None for k in range(3000)] + [list(range(rn.SLICE))]
    got = total.func(pa.array(lists, pa.list_(pa.int32())))
    assert got.to_pylist() == [None if x is None else sum(x) for x in lists]
    assert len(seen) > 3 and all(size <= rn.SLICE for n, size in seen if n > 1)
    counts = rn.arrow_udf("array<int>", 200)(_ragged).func(pa.array(range(450), pa.int64()))
    assert len(counts) == 450 and all(sum(c) == 480 * 480 for c in counts.to_pylist())


def test_codec_of_long_and_odd_runs():
    rng = np.random.default_rng(1)
    lists = [[], [5], [0, 5], [1 << 30, 1, 2, 1 << 30, 0, 7]] + [rng.integers(0, 40_000, n).tolist() for n in range(1, 60)]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    counts = np.concatenate([np.array(x, dtype=np.int64) for x in lists])
    back = rn.unpacked(*rn.packed_bytes(row, counts))
    assert (back[0] == row).all() and (back[1] == counts).all()


def test_dealt_parts_follow_rows(spark):
    one = spark.range(5000).coalesce(1)
    parts = dealt(one, 100, "id")
    assert parts.rdd.getNumPartitions() == 50
    sizes = parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 200 and dealt(one, 10_000, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_boxes_that_just_touch_when_grown(spark):
    """In whole numbers: 20 * (rmin - rmax') against the extents, for every gap and extent up to 60."""
    ab = spark.range(61 * 61).select((F.col("id") % 61).alias("h"), F.floor(F.col("id") / 61).alias("k")).crossJoin(spark.range(8).select(F.col("id").alias("gap")))
    box = lambda t, h: F.struct(t.alias("rmin"), F.lit(0).alias("cmin"), (t + h).alias("rmax"), F.lit(9).alias("cmax"))
    x, y = box(F.lit(37), F.col("h")), box(37 + F.col("h") + F.col("gap"), F.col("k"))
    rows = ab.select("h", "k", "gap", g.overlap_expanded(x, y, 0.05).alias("near")).collect()
    assert all(r.near == (20 * r.gap < r.h + r.k) for r in rows)


def test_bipartition_of_a_grid_with_missing_cells(spark):
    v = [3.0, 1.0, 1.0, 1.0, 2.5, -0.5]
    df = spark.createDataFrame([(1, k // 5, k % 5, x) for k, x in enumerate(v)], "image_id int, y int, x int, v double")
    r = gr.bipartitions(df, (5, 5)).first()
    assert (list(r.bits), r.seed, r.corners) == ([1, 0, 0, 0, 1, 0], 0, 2)


def test_cut_of_a_grid_with_missing_cells(spark):
    rng = np.random.default_rng(3)
    feat = [([1.0, 0.0] if k in (0, 1, 5, 6) else [0.0, 1.0]) + rng.normal(0, 0.01, 2).tolist() for k in range(7)]
    df = spark.createDataFrame([(1, k // 5, k % 5, f) for k, f in enumerate(feat)], "image_id int, y int, x int, feat array<double>")
    rows = gr.cut_masks(df, rounds=2, shape=(5, 5)).collect()
    assert all(len(r.bits) == 25 and sum(r.bits) == r.area and not any(r.bits[7:]) for r in rows)
    assert [k for k, b in enumerate(rows[0].bits) if b] in ([0, 1, 5, 6], [2, 3, 4])


def test_boxes_over_no_cell_have_no_score(spark):
    cells = spark.createDataFrame([(1, 0, x, 0.5) for x in range(3)], "image_id int, y int, x int, heat double")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 20, 30, 30, 40)], "image_id int, ord int, l int, t int, r int, b int")
    boxes = boxes.withColumns({"gw": F.lit(5), "gh": F.lit(5), "width": F.lit(40), "height": F.lit(40)})
    assert [r.ord for r in wn.score_boxes(boxes, cells).collect()] == [1]


def test_gradients_beside_missing_pixels():
    rng = np.random.default_rng(5)
    full = rng.normal(size=(12, 9))
    boxes = np.array([[0, 0, 9, 12], [2, 3, 7, 11], [1, 1, 3, 3], [4, 4, 20, 20]])
    assert np.allclose(_partial_gradients(full, boxes), mean_gradients(full, boxes))
    cut = full.copy()
    cut[8:, 4:] = np.nan
    assert np.isclose(_partial_gradients(cut, np.array([[5, 5, 9, 12]]))[0], mean_gradients(full[:8], np.array([[5, 5, 9, 8]]))[0])


def test_one_json_file_from_parts(spark, tmp_path, monkeypatch):
    """No task gets the whole document."""
    monkeypatch.setattr(sk, "coco_document", None)
    images = spark.range(500).select("id", F.lit("a").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    anns = spark.range(500).select("id", F.col("id").alias("image_id"), F.lit(1).alias("category_id"))
    cats = spark.range(1).select(F.lit(1).alias("id"), F.lit("x").alias("name"), F.lit("y").alias("supercategory"))
    path = str(tmp_path / "doc")
    sk.write_coco(path, images, anns, cats, "t")
    files = [p for p in (tmp_path / "doc").iterdir() if not p.name.startswith(".")]
    assert len(files) == 1 and not list(tmp_path.glob("doc-parts*"))
    doc = json.loads(files[0].read_text())
    assert [a["id"] for a in doc["annotations"]] == list(range(500)) and len(doc["images"]) == 500 and doc["info"]["description"] == "t"
