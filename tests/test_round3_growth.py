"""Memory, shuffles and files that grow no faster than the input: findings F12 to F21 of round 3."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from segmill.operators import evaluate as ev
from segmill.operators import merge as mg
from segmill.operators import runs as rn
from segmill.operators import windows as wn
from segmill.plans import generator as gn
from segmill.plans import generator_queries as gq
from segmill.plans import more_queries as mq
from segmill.plans import queries as qs
from segmill.sources import readers as rd

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_an_image_stay_in_one_row(spark):
    keys = re.findall(r"Aggregate \[([^\]]*)\]", _plan(qs.q_range_join_points(spark, D)))
    assert keys and not any("px#" in k or "py#" in k for k in keys)


def test_precision_writes_a_row_a_score(spark, monkeypatch):
    """Not one for each of the 40 variants of every score."""
    written = {}
    keep = ev.materialise

    def spy(df, label, by=None):
        out = keep(df, label, by)
        written[label] = out.count()
        return out

    monkeypatch.setattr(ev, "materialise", spy)
    gt, pred = qs._gt_pred(spark, D)
    ev.coco_ap(gt, pred).collect()
    assert written["ap-steps"] == pred.select("score").distinct().count() and len(written) > 1


def test_log_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mq, "_path", lambda spark, label: str(tmp_path / label))
    assert mq.q_scan_log_tree(spark, D).count() == qs.table(spark, D, "supplier").count()
    files = list((tmp_path / "logs").glob("run=*/part-*"))
    assert len(files) == qs.table(spark, D, "supplier").count() and len({f.name.split("-")[1] for f in files}) > 1


def test_pixels_are_drawn_a_slice_at_a_time(monkeypatch):
    seen, keep = [], rn._to_lists
    monkeypatch.setattr(rn.F, "arrow_udf", lambda f, kind: f)
    monkeypatch.setattr(rn, "_to_lists", lambda row, *rest: seen.append(len(row)) or keep(row, *rest))
    got = rn.to_bits(pa.array([[k % 48, 48 * 48 - k % 48] for k in range(3000)] + [None], pa.list_(pa.int32())), 48)
    assert max(seen) <= rn.SLICE and sum(seen) == 3000 * 48 * 48
    assert got[-1].as_py() is None and [sum(got[k].as_py()) for k in (0, 5, 2999)] == [48 * 48 - k % 48 for k in (0, 5, 2999)]


def test_generator_keeps_run_lengths(spark, monkeypatch):
    """Pixels of whole canvases aren't stored, shuffled or put in batches."""
    stored, keep = {}, gn.materialise
    monkeypatch.setattr(gn, "materialise", lambda df, label, by=None: stored.setdefault(label, df.columns) and keep(df, label, by))
    gq.q_generator_counters(spark, D)
    assert {"full-masks", "candidates", "kept"} <= set(stored) and all("bits" not in c for c in stored.values())


def test_merge_takes_run_lengths(spark):
    """The same labels from run lengths as from pixels."""
    rows = [(1, k, [k % 3, 2 + k % 2, 16 - k % 3 - 2 - k % 2], float(k), k == 5) for k in range(6)]
    m = spark.createDataFrame(rows, "image_id long, mask_id long, counts array<int>, score double, protected boolean")
    bits = m.withColumn("bits", rn.to_bits("counts", 4)).drop("counts")
    got, want = (sorted(map(tuple, mg.merge_candidates(x, 4, max_ratio=1.0).collect())) for x in (m, bits))
    assert got == want and got


def test_a_line_is_parsed_once_for_its_kind(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"images":[\n{"id":1,"image_id":null}\n,{"id":2,"file_name":"a"}\n  ,{"id":3,"image_id":7,"bbox":[1.0]}\n]}\n')
    found = rd.bundle(spark, str(tmp_path))
    assert _plan(found["annotations"]).count("jsonObjectKeys") == 1
    assert [(r.id, r.image_id) for r in found["annotations"].orderBy("id").collect()] == [(1, None), (3, 7)] and [r.id for r in found["images"].collect()] == [2]


def test_paths_are_dealt_by_rows(spark):
    """Also before base names are grouped, which sorts what a task holds."""
    plan = _plan(mq.q_resolve_path(spark, D))
    assert plan.count("RepartitionByExpression") == 6 and re.search(r"Aggregate.*\n[^\n]*RepartitionByExpression", plan)


def test_pixels_meet_boxes_in_parts_of_bounded_size(spark, monkeypatch):
    """In one shuffle, dealt by pixels, and not in joins, whose side of pixels Spark broadcasts where the table they are made of is small."""
    monkeypatch.setattr(wn, "PIXELS", 4_000)
    boxes, covering, pixels = mq._canvas(spark, D)
    rows = pixels.select("image_id", F.inline("pixels"))
    found = [wn.box_terms(boxes, ["ord"], covering, p) for p in (pixels, rows)]
    for f in found:
        assert "Join" not in _plan(f) and f.rdd.getNumPartitions() == -(-rows.count() // 4_000) > 4
    assert sorted(found[0].collect()) == sorted(found[1].collect()) and found[0].count() == boxes.count()
    assert "Join" not in _plan(mq.q_ranked_grid(spark, D))


def test_terms_of_images_that_a_table_lacks(spark):
    boxes = spark.createDataFrame([(1, 7, 0, 0, 4, 2, "a"), (2, 7, 0, 0, 4, 2, "b"), (3, 8, 0, 0, 4, 2, None), (None, 9, 0, 0, 4, 2, "d")], "image_id int, k int, l int, t int, r int, b int, note string")
    covered = spark.createDataFrame([(2, 0, 0, 2, 2), (4, 0, 0, 4, 2), (None, 0, 0, 4, 2)], "image_id int, l int, t int, r int, b int")
    pixels = spark.createDataFrame([(i, y, x, 3.0 * x) for i in (1, 4, None) for y in range(2) for x in range(4)], "image_id int, y int, x int, v double")
    want = {1: ("a", 0.0, 3.0), 2: ("b", 0.5, 0.0), 3: (None, 0.0, 0.0)}
    for c, p in ((covered, pixels), (covered, None), (None, pixels), (None, None)):
        got = {r.image_id: r for r in wn.box_terms(boxes, ["k"], c, p).collect()}
        for i, (note, cover, edge) in want.items():
            assert (got[i].note, got[i].r, got[i].cover, got[i].edge) == (note, 4, cover if c else 0.0, edge if p else 0.0)
