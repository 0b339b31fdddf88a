"""The driver's queries of the reference's operators, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks as mk
from ..functions import scoring as sc
from ..operators import candidates as cd
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import greedy as gd
from ..operators import merge as mg
from ..operators import runs as rn
from ..operators import stats as st
from ..operators import windows as wn
from ..session import shared_dir, ship, table
from ..sources import readers as rd
from . import fixtures as fx
from . import merge_sql as ms
from . import presets as ps

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _box(c: str = ""):
    return F.struct(*[F.col(f"{c}{k}").alias(k) for k in "ltrb"])


def _inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t)))"


def _area(a: str) -> str:
    return f"(({a}.r - {a}.l) * ({a}.b - {a}.t))"


def _iou(a: str, b: str) -> str:
    return f"(CAST({_inter(a, b)} AS DOUBLE) / ({_area(a)} + {_area(b)} - {_inter(a, b)}))"


def _ios(a: str, b: str) -> str:
    return f"(CAST({_inter(a, b)} AS DOUBLE) / least({_area(a)}, {_area(b)}))"


def _inside(a: str, b: str) -> str:
    return f"(CAST({_inter(a, b)} AS DOUBLE) / {_area(a)})"


_STATS = f"""
WITH {fx.ANN}, c AS (SELECT o_orderkey, (SELECT count(*) FROM ann WHERE image_id = o_orderkey AND SRC) AS n FROM orders),
k AS (SELECT count(*) AS total_anns, avg(CAST(area AS DOUBLE)) AS mean_area, median(CAST(area AS DOUBLE)) AS med_area, count(*) FILTER (area < 1024) AS small_count,
  count(*) FILTER (area >= 1024 AND area < 9216) AS medium_count, count(*) FILTER (area >= 9216) AS large_count FROM ann WHERE SRC)
SELECT (SELECT count(*) FROM orders) AS total_images, total_anns, round(mean_area, 6) AS mean_area, round(med_area, 6) AS med_area, small_count, medium_count, large_count,
  round(100.0 * small_count / total_anns, 6) AS small_pct, round(100.0 * medium_count / total_anns, 6) AS medium_pct, round(100.0 * large_count / total_anns, 6) AS large_pct,
  round((SELECT avg(n) FROM c), 6) AS avg_masks, round((SELECT median(n) FROM c), 6) AS med_masks FROM k
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_STATS.replace("SRC", "true"))
def q_label_stats(spark, d):
    return _rounded(st.label_stats(fx.images(spark, d), fx.annotations(spark, d)))


@query(f"""WITH {fx.ANN}, c AS (SELECT o_orderkey, count(ann_id) AS n FROM orders LEFT JOIN ann ON image_id = o_orderkey GROUP BY 1)
SELECT CAST(k AS INTEGER) AS n_masks, count(o_orderkey) AS images FROM range(6) s(k) LEFT JOIN c ON least(n, 5) = k GROUP BY 1""")
def q_mask_hist(spark, d):
    return st.mask_histogram(fx.images(spark, d), fx.annotations(spark, d))


@query("SELECT p_partkey AS id, 1 AS category_id, (SELECT count(DISTINCT p_size) FROM part) AS before FROM part")
def q_collapse_categories(spark, d):
    one, _, before = st.collapse_categories(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("category_id")))
    return one.crossJoin(before)


@query(f"""WITH {fx.ANN}, s AS (SELECT area, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS size_bin FROM ann)
SELECT coalesce(size_bin, 'all') AS size_bin, count(*) AS anns, round(avg(area), 6) AS mean_area FROM s GROUP BY ROLLUP (size_bin)""")
def q_size_bin_rollup(spark, d):
    return _rounded(st.size_rollup(fx.annotations(spark, d)))


@query("SELECT (SELECT count(*) FROM orders) AS images, (SELECT count(*) FROM lineitem) AS annotations, round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders), 6) AS avg_masks_per_image")
def q_pseudo_stats(spark, d):
    return _rounded(st.pseudo_stats(fx.images(spark, d), table(spark, d, "lineitem")))


_GRID = """s AS (SELECT * FROM (VALUES (0, 160, 112), (1, 120, 84), (2, 80, 56)) v(scale, w, stride)),
ax AS (SELECT scale, w, unnest(list_sort(list_distinct(list_concat(range(0, 160 - w + 1, stride), [160 - w])))) AS v FROM s),
cells AS (SELECT a.scale, a.w, a.v AS y, b.v AS x FROM ax a JOIN ax b ON a.scale = b.scale),
win AS (SELECT CAST(row_number() OVER (ORDER BY scale, y, x) AS INTEGER) AS ord, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, w FROM cells)"""


@query(f"WITH {_GRID} SELECT o_orderkey AS image_id, ord, x, y, w, w AS h FROM orders CROSS JOIN win")
def q_grid_windows(spark, d):
    """The windows of every image."""
    return fx.images(spark, d).select(F.col("id").alias("image_id")).crossJoin(F.broadcast(wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5])))


@query(f"""WITH {_GRID}, o AS (SELECT o_orderkey AS id, 50 + o_orderkey % 700 AS ww, 50 + o_custkey % 500 AS hh FROM orders),
e AS (SELECT id, ord, ww, hh, round_even(CAST(x AS DOUBLE) / 160.0 * ww, 0) AS l, round_even(CAST(y AS DOUBLE) / 160.0 * hh, 0) AS t, round_even(CAST(x + w AS DOUBLE) / 160.0 * ww, 0) AS r, round_even(CAST(y + w AS DOUBLE) / 160.0 * hh, 0) AS b FROM o CROSS JOIN win),
f AS (SELECT *, greatest(0, least(l, ww - 1)) AS l2, greatest(0, least(t, hh - 1)) AS t2 FROM e)
SELECT id, ord, CAST(l2 AS INTEGER) AS l, CAST(t2 AS INTEGER) AS t, CAST(greatest(l2 + 1, least(r, ww)) AS INTEGER) AS r, CAST(greatest(t2 + 1, least(b, hh)) AS INTEGER) AS b FROM f""")
def q_project_window(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (50 + F.col("o_orderkey") % 700).cast("int").alias("ww"), (50 + F.col("o_custkey") % 500).cast("int").alias("hh"))
    win = wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5])
    both = o.crossJoin(F.broadcast(win))
    return both.select("id", "ord", g.project_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), fx.SIZE, F.col("ww"), F.col("hh")).alias("p")).select("id", "ord", "p.*")


def _square(cx: str, cy: str, size: str, w: str = "160", h: str = "160") -> tuple[str, str]:
    """CTE text that makes l, t, r, b from rows with id columns in ``base``."""
    s = f"CAST(greatest(2, least(round_even(CAST({size} AS DOUBLE), 0), greatest({w}, {h}))) AS INTEGER)"
    one = f"sq1 AS (SELECT *, {s} AS side, CAST({cx} AS DOUBLE) AS cx0, CAST({cy} AS DOUBLE) AS cy0 FROM base)"
    one += ", sq2 AS (SELECT *, CAST(round_even(cx0 - side / 2.0, 0) AS INTEGER) AS x0, CAST(round_even(cy0 - side / 2.0, 0) AS INTEGER) AS y0 FROM sq1)"
    one += ", sq3 AS (SELECT *, CASE WHEN x0 < 0 THEN side ELSE x0 + side END AS x1, CASE WHEN y0 < 0 THEN side ELSE y0 + side END AS y1 FROM sq2)"
    one += f", sq4 AS (SELECT *, greatest(0, CASE WHEN x1 > {w} THEN greatest(x0, 0) - (x1 - {w}) ELSE greatest(x0, 0) END) AS nl, greatest(0, CASE WHEN y1 > {h} THEN greatest(y0, 0) - (y1 - {h}) ELSE greatest(y0, 0) END) AS nt FROM sq3)"
    one += f", sq AS (SELECT *, greatest(nl + 1, least(x1, {w})) AS nr, greatest(nt + 1, least(y1, {h})) AS nb FROM sq4)"
    return one, "nl AS l, nt AS t, nr AS r, nb AS b"


_CLIP, _CLIP_COLS = _square("(l + r) / 2.0", "(t + b) / 2.0", "line * 31.5")


@query(f"WITH {fx.ANN}, base AS (SELECT ann_id, l, t, r, b, line FROM ann), {_CLIP} SELECT ann_id, {_CLIP_COLS} FROM sq")
def q_clip_square(spark, d):
    a, n = fx.annotations(spark, d), F.lit(fx.SIZE)
    return a.select("ann_id", g.clip_square((F.col("l") + F.col("r")) / 2.0, (F.col("t") + F.col("b")) / 2.0, F.col("line") * 31.5, n, n).alias("p")).select("ann_id", "p.*")


_EXPAND, _ = _square("(l + r) / 2.0", "(t + b) / 2.0", "CAST(greatest(r - l, b - t) AS DOUBLE) * 1.4")


@query(f"WITH {fx.ANN}, base AS (SELECT ann_id, l, t, r, b FROM ann), {_EXPAND} SELECT ann_id, {_CLIP_COLS} FROM sq")
def q_expand_box(spark, d):
    n = F.lit(fx.SIZE)
    return fx.annotations(spark, d).select("ann_id", g.expand_box(_box(), 1.4, n, n).alias("p")).select("ann_id", "p.*")


def _self_pairs(spark, d):
    a = fx.annotations(spark, d).select("image_id", "ann_id", _box().alias("x"))
    c = a.select(F.col("image_id").alias("other"), F.col("ann_id").alias("ann_id2"), F.col("x").alias("y"))
    return a.join(c, (F.col("image_id") == F.col("other")) & (F.col("ann_id") < F.col("ann_id2")))


@query(f"WITH {fx.ANN} SELECT x.ann_id, y.ann_id AS ann_id2, round({_iou('x', 'y')}, 6) AS iou, round({_ios('x', 'y')}, 6) AS ios FROM ann x JOIN ann y ON x.image_id = y.image_id AND x.ann_id < y.ann_id WHERE {_iou('x', 'y')} > 0.4")
def q_box_iou_pairs(spark, d):
    p = _self_pairs(spark, d).filter(g.boxes_overlap(F.col("x"), F.col("y")))
    return _rounded(p.select("ann_id", "ann_id2", g.box_iou(F.col("x"), F.col("y")).alias("iou"), g.box_ios(F.col("x"), F.col("y")).alias("ios")).filter("iou > 0.4"))


_GROWN = """(x.t - (x.b - 1 - x.t) * 0.05 < y.b - 1 + (y.b - 1 - y.t) * 0.05 AND y.t - (y.b - 1 - y.t) * 0.05 < x.b - 1 + (x.b - 1 - x.t) * 0.05
 AND x.l - (x.r - 1 - x.l) * 0.05 < y.r - 1 + (y.r - 1 - y.l) * 0.05 AND y.l - (y.r - 1 - y.l) * 0.05 < x.r - 1 + (x.r - 1 - x.l) * 0.05)"""


@query(f"WITH {fx.ANN} SELECT x.ann_id, y.ann_id AS ann_id2 FROM ann x JOIN ann y ON x.image_id = y.image_id AND x.ann_id < y.ann_id WHERE {_GROWN}")
def q_overlap_expanded(spark, d):
    a = fx.annotations(spark, d).select("image_id", "ann_id", g.grown(g.inclusive(_box()), 0.05).alias("x"))
    c = a.select(F.col("image_id").alias("other"), F.col("ann_id").alias("ann_id2"), F.col("x").alias("y"))
    near = (F.col("image_id") == F.col("other")) & (F.col("ann_id") < F.col("ann_id2")) & g.grown_overlap(F.col("x"), F.col("y"))
    return a.join(c, near).select("ann_id", "ann_id2")


_FRAGMENT = f"e AS (SELECT x.image_id, x.ann_id AS u, y.ann_id AS v FROM ann x JOIN ann y ON x.image_id = y.image_id AND x.ann_id < y.ann_id WHERE x.source = 'crop' AND y.source = 'crop' AND ({_iou('x', 'y')} > 0.5 OR {_ios('x', 'y')} > 0.85 OR {_GROWN}))"


@query(f"WITH {fx.ANN}, {_FRAGMENT} SELECT * FROM e")
def q_fragment_graph(spark, d):
    return gr.fragment_edges(fx.annotations(spark, d).filter("source = 'crop'"))


@query(f"""WITH RECURSIVE {fx.ANN}, {_FRAGMENT}, both_ways AS (SELECT image_id, u, v FROM e UNION ALL SELECT image_id, v, u FROM e),
reach(image_id, v, c) AS (SELECT image_id, ann_id, ann_id FROM ann WHERE source = 'crop' UNION SELECT r.image_id, b.v, r.c FROM reach r JOIN both_ways b ON r.image_id = b.image_id AND r.v = b.u WHERE b.v > r.c)
SELECT image_id, v, min(c) AS component FROM reach GROUP BY 1, 2""")
def q_components(spark, d):
    a = fx.annotations(spark, d).filter("source = 'crop'")
    return gr.image_components(a.select("image_id", F.col("ann_id").alias("v")), gr.fragment_edges(a))


def _greedy(candidates: str, hit: str, budget: str = "false") -> str:
    """Rows c(image_id, n, ann_id, l, t, r, b) in order -> kept ones, carried as a list."""
    return f"""c AS ({candidates}),
gr(image_id, n, kept) AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(ann_id BIGINT, l INTEGER, t INTEGER, r INTEGER, b INTEGER)[]) FROM c
  UNION ALL
  SELECT q.image_id, q.n + 1, CASE WHEN {budget} OR len(list_filter(q.kept, lambda k: {hit})) > 0 THEN q.kept
    ELSE list_append(q.kept, {{'ann_id': c.ann_id, 'l': c.l, 't': c.t, 'r': c.r, 'b': c.b}}) END
  FROM gr q JOIN c ON c.image_id = q.image_id AND c.n = q.n + 1
), fin AS (SELECT image_id, unnest(arg_max(kept, n)) AS k FROM gr GROUP BY image_id)"""


@query(f"""WITH RECURSIVE {fx.ANN}, {_greedy("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS n, ann_id, l, t, r, b FROM ann", _iou('k', 'c') + " > 0.4")}
SELECT image_id, k.ann_id AS ann_id FROM fin""")
def q_box_nms(spark, d):
    a = fx.annotations(spark, d)
    return gd.suppress(a, ["image_id"], [F.desc("score"), F.col("ord")], ["ann_id", "l", "t", "r", "b"], lambda x, y: g.box_iou(x, y) > 0.4).select("image_id", "ann_id")


@query(f"WITH {fx.ANN}, k AS (SELECT image_id, ann_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM ann) SELECT * FROM k WHERE rank <= 2")
def q_per_window_topk(spark, d):
    return gd.top_per_group(fx.annotations(spark, d), ["image_id"], [F.desc("score"), F.col("ord")], 2).select("image_id", "ann_id", "rank")


_DUP = f"({_iou('x', 'y')} >= 0.5 OR {_inside('x', 'y')} >= 0.7 OR {_inside('y', 'x')} >= 0.7)"
_DUP_K = f"({_iou('c', 'k')} >= 0.5 OR {_inside('c', 'k')} >= 0.7 OR {_inside('k', 'c')} >= 0.7)"
_COMBINE = f"""WITH RECURSIVE {fx.ANN}, rest AS (SELECT * FROM ann x WHERE source = 'crop' AND NOT EXISTS (SELECT 1 FROM ann y WHERE y.source = 'baseline' AND y.image_id = x.image_id AND {_DUP})),
{_greedy("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ORDERING ord) AS n, ann_id, l, t, r, b FROM rest", _DUP_K)},
al AS (SELECT image_id, ann_id, 'baseline' AS split FROM ann WHERE source = 'baseline' UNION ALL SELECT image_id, k.ann_id, 'crop' FROM fin)
SELECT image_id, ann_id, split, CAST(row_number() OVER (PARTITION BY image_id ORDER BY split, ann_id) AS INTEGER) AS new_id FROM al"""


def _combined(spark, d, by_area=False):
    a = fx.annotations(spark, d)
    return mg.combine_labels(a.filter("source = 'baseline'"), a.filter("source = 'crop'"), by_area=by_area)


@query(_COMBINE.replace("ORDERING", ""))
def q_combine_labels(spark, d):
    return _combined(spark, d).select("image_id", "ann_id", "split", "new_id")


@query(_COMBINE.replace("ORDERING", "area DESC,"))
def q_combine_labels_by_area(spark, d):
    return _combined(spark, d, True).select("image_id", "ann_id", "split", "new_id")


@query(f"WITH {fx.ANN} SELECT ann_id, row_number() OVER (ORDER BY source, ann_id) AS new_id FROM ann")
def q_renumber(spark, d):
    return mg.renumber(fx.annotations(spark, d).select("source", "ann_id"), ["source", "ann_id"], parts=8).select("ann_id", F.col("new_id").cast("long").alias("new_id"))


@query(f"""WITH {fx.ANN}, {_GRID}, pix AS (SELECT px.v AS x, py.v AS y FROM range(0, 160, 20) px(v), range(0, 160, 20) py(v)), base AS (SELECT * FROM ann WHERE source = 'baseline'),
under AS (SELECT DISTINCT f.image_id, p.x, p.y FROM base f JOIN pix p ON p.x >= f.l AND p.x < f.r AND p.y >= f.t AND p.y < f.b),
hit AS (SELECT u.image_id, w.ord, count(*) AS n FROM under u JOIN win w ON u.x >= w.x AND u.x < w.x + w.w AND u.y >= w.y AND u.y < w.y + w.w GROUP BY 1, 2)
SELECT i.image_id, w.ord, coalesce(h.n, 0) AS covered_points FROM (SELECT DISTINCT image_id FROM base) i CROSS JOIN win w LEFT JOIN hit h ON h.image_id = i.image_id AND h.ord = w.ord""")
def q_range_join_points(spark, d):
    """A lattice's points under baseline boxes, by window, of every image: the range join.

    The 64 points are the bits of a number, so an image is one row from the join on: rows of points never gather in a task.
    """
    base = fx.annotations(spark, d).filter("source = 'baseline'").select("image_id", "l", "t", "r", "b")
    win = wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5])
    pix = spark.range(64).select((F.col("id") % 8 * 20).alias("px"), (F.floor(F.col("id") / 8) * 20).alias("py"), F.expr("shiftleft(1L, CAST(id AS INT))").alias("bit"))
    in_window = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h"))
    inside = win.join(F.broadcast(pix), in_window, "left").groupBy("ord").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("inside"))
    in_box = (F.col("px") >= F.col("l")) & (F.col("px") < F.col("r")) & (F.col("py") >= F.col("t")) & (F.col("py") < F.col("b"))
    under = base.join(F.broadcast(pix), in_box, "left").groupBy("image_id").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("under"))
    return under.crossJoin(F.broadcast(inside)).select("image_id", "ord", F.bit_count(F.col("under").bitwiseAND(F.col("inside"))).cast("long").alias("covered_points"))


@query(f"""WITH {fx.PIXELS}, s AS (SELECT mask_id, sum(v) AS area, min(y) FILTER (v = 1) AS rmin, max(y) FILTER (v = 1) AS rmax, min(x) FILTER (v = 1) AS cmin, max(x) FILTER (v = 1) AS cmax, avg(x) FILTER (v = 1) AS mx, avg(y) FILTER (v = 1) AS my FROM p GROUP BY 1)
SELECT mask_id, CAST(area AS INTEGER) AS area, round(area / 64, 6) AS area_ratio, CAST(rmin AS INTEGER) AS rmin, CAST(cmin AS INTEGER) AS cmin, CAST(rmax AS INTEGER) AS rmax, CAST(cmax AS INTEGER) AS cmax,
  round(coalesce(area / ((rmax - rmin + 1) * (cmax - cmin + 1)), 0), 6) AS compactness, round(coalesce(greatest(rmax - rmin + 1, cmax - cmin + 1) / least(rmax - rmin + 1, cmax - cmin + 1), 1), 6) AS aspect, round(mx, 6) AS mx, round(my, 6) AS my FROM s""")
def q_mask_shape(spark, d):
    m = fx.masks(spark, d).withColumns({"bb": mk.bbox(F.col("bits"), 8), "ce": mk.centroid(F.col("bits"), 8)})
    return _rounded(m.select("mask_id", mk.area(F.col("bits")).alias("area"), mk.area_ratio(F.col("bits")).alias("area_ratio"), "bb.*", mk.compactness(F.col("bits"), F.col("bb")).alias("compactness"), mk.aspect_ratio(F.col("bb")).alias("aspect"), F.col("ce.x").alias("mx"), F.col("ce.y").alias("my")))


@query(f"""WITH {fx.MASKS}, q AS (SELECT a.mask_id, b.mask_id AS mask_id2, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: z[1] * z[2])) AS i, list_sum(a.bits) AS na, list_sum(b.bits) AS nb FROM m a JOIN m b ON a.image_id = b.image_id AND a.mask_id < b.mask_id)
SELECT mask_id, mask_id2, round(coalesce(i / nullif(na + nb - i, 0), 0), 6) AS iou, round(coalesce(i / nullif(least(na, nb), 0), 0), 6) AS ios, round(coalesce(i / nullif(na, 0), 0), 6) AS inside FROM q""")
def q_mask_iou_ios(spark, d):
    m = fx.masks(spark, d)
    o = m.select(F.col("mask_id").alias("mask_id2"), F.col("image_id").alias("oi"), F.col("bits").alias("ob"))
    p = m.join(o, (F.col("image_id") == F.col("oi")) & (F.col("mask_id") < F.col("mask_id2")))
    return _rounded(p.select("mask_id", "mask_id2", mk.iou(F.col("bits"), F.col("ob")).alias("iou"), mk.ios(F.col("bits"), F.col("ob")).alias("ios"), mk.inside(F.col("bits"), F.col("ob")).alias("inside")))


@query(f"WITH {fx.PIXELS}, u AS (SELECT image_id, y, x, max(v) AS v FROM p GROUP BY 1, 2, 3) SELECT image_id, CAST(sum(v) AS INTEGER) AS area FROM u GROUP BY 1")
def q_union_masks(spark, d):
    """The union of every mask of an image."""
    m = fx.masks(spark, d).groupBy("image_id").agg(F.collect_list("bits").alias("all"))
    return m.select("image_id", mk.area(mk.union_of(F.col("all"))).alias("area"))


@query(f"""WITH {fx.PIXELS}, s AS (SELECT mask_id, sum(v) AS area, sum(v) FILTER (y = 0) AS top, sum(v) FILTER (y = 7) AS bottom, sum(v) FILTER (x = 0) AS lft, sum(v) FILTER (x = 7) AS rgt FROM p GROUP BY 1)
SELECT mask_id, round(CASE WHEN area > 0 THEN least(1.0, (top + bottom + lft + rgt) / greatest(1.0, sqrt(area))) ELSE 0 END, 6) AS touch, CAST(CASE WHEN area > 0 THEN (top > 0)::INT + (bottom > 0)::INT + (lft > 0)::INT + (rgt > 0)::INT ELSE 0 END AS INTEGER) AS sides,
  round(CASE WHEN area > 0 THEN least(1.0, (CASE WHEN mask_id % 3 = 0 THEN 0 ELSE top END + bottom + CASE WHEN mask_id % 2 = 0 THEN 0 ELSE lft END + rgt) / greatest(1.0, sqrt(area))) ELSE 0 END, 6) AS in_touch,
  CAST(CASE WHEN area > 0 THEN (top > 0 AND mask_id % 3 <> 0)::INT + (bottom > 0)::INT + (lft > 0 AND mask_id % 2 <> 0)::INT + (rgt > 0)::INT ELSE 0 END AS INTEGER) AS in_sides FROM s""")
def q_border_metrics(spark, d):
    m = fx.masks(spark, d).withColumn("c", mk.border_counts(F.col("bits"), 8)).withColumn("n", mk.area(F.col("bits")))
    edge = {"top": F.col("mask_id") % 3 == 0, "left": F.col("mask_id") % 2 == 0, "bottom": F.lit(False), "right": F.lit(False)}
    m = m.withColumns({"a": mk.border_metrics(F.col("c"), F.col("n")), "i": mk.border_metrics(F.col("c"), F.col("n"), edge)})
    return _rounded(m.select("mask_id", F.col("a.touch").alias("touch"), F.col("a.sides").alias("sides"), F.col("i.touch").alias("in_touch"), F.col("i.sides").alias("in_sides")))


_PRIOR = "exp(-0.5 * pow((log10(area / 25600.0) - log10(0.004)) / 0.65, 2))"
_TERMS = "least(1.0, greatest(0.0, score / 20000.0 / 4.0))"
_ASPECT = "(CAST(greatest(r - l, b - t) AS DOUBLE) / least(r - l, b - t))"


@query(f"""WITH {fx.ANN} SELECT ann_id, round({_PRIOR}, 6) AS area_prior,
  round(1.4 * {_PRIOR} + 1.1 * 1.0 + 0.7 * {_TERMS} + 0.5 * least(1.0, greatest(0.0, 1 - tax)) - least(1.0, greatest(0.0, ({_ASPECT} - 3.0) / 4.0)) - 1.2 * greatest(discount * 5, (line % 4) / 4.0)
   - CASE WHEN line % 4 >= 2 AND tax * 12.5 > 0.75 THEN least(1.0, greatest(0.0, (tax * 12.5 - 0.75) / 0.25)) ELSE 0 END - 0.6 * discount, 6) AS score,
  round(1.4 * {_PRIOR} + 1.1 * 1.0 + 0.7 * {_TERMS} + 0.5 * least(1.0, greatest(0.0, 1 - tax)) - least(1.0, greatest(0.0, ({_ASPECT} - 3.0) / 4.0)) - 0.9 * greatest(discount * 5, (line % 4) / 4.0) - 0.6 * discount, 6) AS legacy FROM ann""")
def q_candidate_score(spark, d):
    a = fx.annotations(spark, d)
    ratio, one = F.col("area") / float(fx.SIZE**2), F.lit(1.0)
    aspect = F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t")) / F.least(F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    crop, sides, touch, fill = F.col("score") / 20000.0, F.col("line") % 4, F.col("discount") * 5, F.col("tax") * 12.5
    return _rounded(a.select("ann_id", sc.area_prior(ratio).alias("area_prior"), sc.candidate_score(ratio, one, crop, aspect, touch, sides, fill, F.col("discount"), 1 - F.col("tax")).alias("score"), sc.candidate_score_legacy(ratio, one, crop, aspect, touch, sides, F.col("discount"), 1 - F.col("tax")).alias("legacy")))


_GATE = "area / 25600.0 BETWEEN 0.0001 AND 0.2 AND score >= 10000 AND discount * 5 <= 0.4 AND line % 4 <= 1 AND tax * 12.5 <= 0.9"


@query(f"WITH {fx.ANN} SELECT image_id, count(*) FILTER ({_GATE}) AS passed, count(*) FILTER (NOT ({_GATE})) AS rejected, count(*) FILTER (tax * 12.5 >= 0.9 AND (discount * 5 >= 0.5 OR line % 4 >= 2)) AS crop_shaped FROM ann GROUP BY 1")
def q_quality_gate(spark, d):
    a = fx.annotations(spark, d)
    sides, touch, fill = F.col("line") % 4, F.col("discount") * 5, F.col("tax") * 12.5
    one = F.lit(1.0)
    good = sc.quality_gate(F.col("area") / 25600.0, F.col("score"), one, one, touch, sides, fill, one, max_ratio=0.2, min_score=10000.0, max_touch=0.4)
    shaped = sc.crop_shape_reject(fill, touch, sides, F.lit(True))
    return a.groupBy("image_id").agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("rejected"), F.count_if(shaped).alias("crop_shaped"))


_RETRY, _ = _square("(bx.l + bx.r) / 2.0", "(bx.t + bx.b) / 2.0", "CAST(greatest(bx.r - bx.l, bx.b - bx.t) AS DOUBLE) * scale")


@query(f"""WITH {fx.ANN}, best AS (SELECT image_id, source AS window_id, first({{'l': l, 't': t, 'r': r, 'b': b}} ORDER BY score DESC, ord) AS bx, first(discount * 5 ORDER BY score DESC, ord) AS touch, first(line % 4 ORDER BY score DESC, ord) AS sides FROM ann GROUP BY 1, 2),
base AS (SELECT *, unnest([1.4, 1.8]::DOUBLE[]) AS scale FROM best WHERE touch >= 0.5 OR sides >= 2), {_RETRY}
SELECT image_id, window_id, scale AS retry_scale, nl AS l, nt AS t, nr AS r, nb AS b FROM sq WHERE NOT (nl = bx.l AND nt = bx.t AND nr = bx.r AND nb = bx.b)""")
def q_border_retry(spark, d):
    a = fx.annotations(spark, d).select("image_id", F.col("source").alias("window_id"), _box().alias("box"), "score", "ord", (F.col("discount") * 5).alias("touch"), (F.col("line") % 4).alias("sides"))
    return wn.border_retry(a, [1.4, 1.8], fx.SIZE, fx.SIZE).select("image_id", "window_id", "retry_scale", "box.*")


_CONTRAST = f"""{fx.PATCHES}, nb AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dy, dx)),
raw AS (SELECT a.image_id, a.y, a.x, avg(1.0 - list_dot_product(a.feat, c.feat)) AS raw FROM pt a CROSS JOIN nb LEFT JOIN pt c ON c.image_id = a.image_id AND c.y = a.y + dy AND c.x = a.x + dx GROUP BY 1, 2, 3),
con AS (SELECT *, (raw - min(raw) OVER (PARTITION BY image_id)) / (max(raw) OVER (PARTITION BY image_id) - min(raw) OVER (PARTITION BY image_id)) AS contrast FROM raw)"""


@query(f"WITH {_CONTRAST} SELECT image_id, y, x, round(raw, 6) AS raw, round(contrast, 6) AS contrast FROM con")
def q_feature_contrast(spark, d):
    return _rounded(wn.feature_contrast(fx.patches(spark, d)))


@query(f"""WITH {_CONTRAST}, ed AS (SELECT image_id, unnest(feat) AS v, generate_subscripts(feat, 1) AS k FROM pt WHERE y IN (0, 4) OR x IN (0, 4)), mn AS (SELECT image_id, k, avg(v) AS v FROM ed GROUP BY 1, 2),
pr AS (SELECT image_id, list(v ORDER BY k) AS p FROM mn GROUP BY 1), fa AS (SELECT pt.image_id, y, x, 1.0 - list_dot_product(feat, p) / sqrt(list_dot_product(p, p)) AS far FROM pt JOIN pr ON pt.image_id = pr.image_id),
ds AS (SELECT image_id, y, x, (far - min(far) OVER w) / (max(far) OVER w - min(far) OVER w) AS d FROM fa WINDOW w AS (PARTITION BY image_id)), mx AS (SELECT image_id, y, x, 0.55::DOUBLE * contrast + 0.45::DOUBLE * d AS v FROM con JOIN ds USING (image_id, y, x))
SELECT image_id, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS objectness FROM mx WINDOW w AS (PARTITION BY image_id)""")
def q_objectness(spark, d):
    return _rounded(wn.objectness(fx.patches(spark, d)))


def _heat(spark, d):
    return wn.feature_contrast(fx.patches(spark, d)).select("image_id", "y", "x", F.round("contrast", 4).alias("heat"))


@query(f"""WITH {_CONTRAST}, {_GRID}, h AS (SELECT image_id, y, x, round(contrast, 4) AS heat FROM con),
bd AS (SELECT ord, x AS l, y AS t, x + w AS r, y + w AS b, greatest(0, least(4, floor(x / 160.0 * 5))) AS x1, greatest(0, least(4, floor(y / 160.0 * 5))) AS y1, ceil((x + w) / 160.0 * 5) AS x2r, ceil((y + w) / 160.0 * 5) AS y2r FROM win),
bx AS (SELECT *, greatest(x1 + 1, least(5, x2r)) AS x2, greatest(y1 + 1, least(5, y2r)) AS y2 FROM bd),
ag AS (SELECT image_id, ord, l, t, r, b, avg(heat) AS mean, max(heat) AS peak FROM bx JOIN h ON h.x >= x1 AND h.x < x2 AND h.y >= y1 AND h.y < y2 GROUP BY ALL)
SELECT image_id, ord, round(1.5 * mean + peak + 2.0 * mean - 0.1 * ((l = 0)::INT + (t = 0)::INT + (r = 160)::INT + (b = 160)::INT) + 1e-9, 5) AS score FROM ag""")
def q_heatmap_box_score(spark, d):
    heat = _heat(spark, d)
    win = wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5]).select("ord", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    boxes = heat.select("image_id").distinct().crossJoin(F.broadcast(win)).withColumns({"gw": F.lit(5), "gh": F.lit(5), "width": F.lit(fx.SIZE), "height": F.lit(fx.SIZE)})
    return wn.score_boxes(boxes, heat).select("image_id", "ord", F.round(F.col("score") + 1e-9, 5).alias("score"))


def _scored_boxes(t: str) -> str:
    """SQL: {t}sc, the boxes of {t}bx(image_id, key, l, t, r, b) with cover, edge, mean, peak and score, on images of 40 x 40 with 5 x 5 cells."""
    return f"""{t}cv AS (SELECT image_id, key, count(*) AS n FROM {t}bx JOIN cpx USING (image_id) WHERE x >= l AND x < r AND y >= t AND y < b GROUP BY 1, 2),
{t}gg AS (SELECT image_id, key, v, lag(v) OVER wy AS uy, lead(v) OVER wy AS dy, lag(v) OVER wx AS ux, lead(v) OVER wx AS dx FROM {t}bx JOIN pix USING (image_id) WHERE x >= l AND x < r AND y >= t AND y < b
  WINDOW wy AS (PARTITION BY image_id, key, x ORDER BY y), wx AS (PARTITION BY image_id, key, y ORDER BY x)),
{t}eg AS (SELECT image_id, key, avg(sqrt(pow(CASE WHEN uy IS NULL THEN dy - v WHEN dy IS NULL THEN v - uy ELSE (dy - uy) / 2 END, 2) + pow(CASE WHEN ux IS NULL THEN dx - v WHEN dx IS NULL THEN v - ux ELSE (dx - ux) / 2 END, 2))) AS edge FROM {t}gg GROUP BY 1, 2),
{t}bd AS (SELECT *, greatest(0, least(4, floor(l / 40.0 * 5))) AS x1, greatest(0, least(4, floor(t / 40.0 * 5))) AS y1, ceil(r / 40.0 * 5) AS xr, ceil(b / 40.0 * 5) AS yr FROM {t}bx),
{t}ht AS (SELECT q.image_id, key, avg(heat) AS mean, max(heat) AS peak FROM {t}bd q JOIN h ON h.image_id = q.image_id AND h.x >= x1 AND h.x < greatest(x1 + 1, least(5, xr)) AND h.y >= y1 AND h.y < greatest(y1 + 1, least(5, yr)) GROUP BY 1, 2),
{t}sc AS (SELECT q.*, coalesce(n, 0) / CAST((r - l) * (b - t) AS DOUBLE) AS cover, edge, mean, peak, 1.5 * mean + peak + 2.0 * mean * (1.0 - coalesce(n, 0) / CAST((r - l) * (b - t) AS DOUBLE)) + 0.5 * edge / 128.0
  - 0.1::DOUBLE * ((l = 0)::INT + (t = 0)::INT + (r = 40)::INT + (b = 40)::INT) AS score FROM {t}bx q JOIN {t}ht USING (image_id, key) JOIN {t}eg USING (image_id, key) LEFT JOIN {t}cv USING (image_id, key))"""


def _kept(t: str, items: str, start: str, budget: str, reason: str) -> str:
    """SQL: {t}fi(image_id, kept), where each of ``items`` (image_id, n, l, t, r, b, score) that hits none kept is added to what ``start`` (image_id, kept) has."""
    return f"""{t}st(image_id, n, most, kept) AS (SELECT image_id, CAST(0 AS BIGINT), {budget}, kept FROM {start} UNION ALL
  SELECT s.image_id, s.n + 1, s.most, CASE WHEN len(s.kept) >= s.most OR len(list_filter(s.kept, lambda k: {_iou('k', 'c')} > 0.4)) > 0 THEN s.kept
    ELSE list_append(s.kept, {{'l': c.l, 't': c.t, 'r': c.r, 'b': c.b, 'score': c.score, 'reason': '{reason}'}}) END FROM {t}st s JOIN {items} c ON c.image_id = s.image_id AND c.n = s.n + 1),
{t}fi AS (SELECT image_id, arg_max(kept, n) AS kept FROM {t}st GROUP BY 1)"""


def _box_at(cx: str, cy: str, size: str) -> str:
    lo = lambda c: f"CAST(greatest(0, least(greatest(round_even({c} - {size} / 2.0, 0), 0), 40 - {size})) AS INTEGER)"
    return f"{lo(cx)} AS l, {lo(cy)} AS t, {lo(cx)} + {size} AS r, {lo(cy)} + {size} AS b"


_CELL = "({0} + 0.5) / 5 * 40"


@query(f"""WITH RECURSIVE {_CONTRAST}, h AS (SELECT image_id, y, x, round(contrast, 4) AS heat FROM con),
pix AS (SELECT vec_id // 25 AS image_id, vec_id % 25 // 5 * 8 + i // 8 AS y, vec_id % 5 * 8 + i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) s(i)),
cb AS (SELECT vec_id // 25 AS image_id, vec_id * 7 % 30 AS l, vec_id * 11 % 30 AS t, vec_id * 7 % 30 + 3 + vec_id % 7 AS r, vec_id * 11 % 30 + 2 + vec_id % 5 AS b FROM embeddings),
cpx AS (SELECT DISTINCT pix.image_id, y, x FROM pix JOIN cb ON cb.image_id = pix.image_id AND x >= l AND x < r AND y >= t AND y < b),
li AS (SELECT image_id, quantile_cont(heat, 0.85) AS threshold FROM h GROUP BY 1),
pk AS (SELECT image_id, y, x, heat, threshold, row_number() OVER (PARTITION BY image_id ORDER BY heat DESC, y DESC, x DESC) AS n FROM h JOIN li USING (image_id)),
sz AS (SELECT * FROM (VALUES (0, 10), (1, 14), (2, 20)) v(k, size)),
qbx AS (SELECT image_id, n * 16 + k AS key, {_box_at(_CELL.format('x'), _CELL.format('y'), 'size')} FROM pk CROSS JOIN sz WHERE n <= 60 AND (heat >= threshold OR (n - 1) * 3 < 60)),
{_scored_boxes('q')}, it AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, key) AS n FROM qsc),
no AS (SELECT DISTINCT image_id, CAST([] AS STRUCT(l INTEGER, t INTEGER, r INTEGER, b INTEGER, score DOUBLE, reason VARCHAR)[]) AS kept FROM h),
{_kept('f', 'it', 'no', '4', 'heatmap')},
ce AS (SELECT image_id, (k.l + k.r) / 2.0 AS cx, (k.t + k.b) / 2.0 AS cy FROM (SELECT image_id, unnest(kept) AS k FROM ffi)),
gd AS (SELECT row, col, CAST(round_even(col * 40 / 3.0, 0) AS INTEGER) AS l, CAST(round_even((col + 1) * 40 / 3.0, 0) AS INTEGER) AS r, CAST(round_even(row * 40 / 3.0, 0) AS INTEGER) AS t, CAST(round_even((row + 1) * 40 / 3.0, 0) AS INTEGER) AS b FROM (SELECT c // 3 AS row, c % 3 AS col FROM range(9) q(c))),
fr AS (SELECT i.image_id, gd.*, least(0.4::DOUBLE, (SELECT min(sqrt(pow((l + r) / 2.0 - cx, 2) + pow((t + b) / 2.0 - cy, 2))) FROM ce WHERE ce.image_id = i.image_id) / sqrt(3200.0::DOUBLE) * 0.8) AS bonus FROM no i CROSS JOIN gd
  WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.image_id = i.image_id AND cx >= l AND cx < r AND cy >= t AND cy < b)),
fc AS (SELECT *, floor(l / 40.0 * 5) AS x1, ceil(r / 40.0 * 5) AS x2, floor(t / 40.0 * 5) AS y1, ceil(b / 40.0 * 5) AS y2 FROM fr),
tp AS (SELECT fc.image_id, row, col, any_value(bonus) AS bonus, max(heat) AS top, arg_max(h.y, (heat, -h.y, -h.x)) AS y, arg_max(h.x, (heat, -h.y, -h.x)) AS x FROM fc JOIN h ON h.image_id = fc.image_id AND h.x >= x1 AND h.x < x2 AND h.y >= y1 AND h.y < y2 GROUP BY 1, 2, 3),
rbx AS (SELECT image_id, row * 100 + col * 10 + k AS key, {_box_at(_CELL.format('x'), _CELL.format('y'), 'size')}, row, col, bonus, top FROM tp CROSS JOIN sz WHERE k < 2),
{_scored_boxes('r')}, re AS (SELECT image_id, l, t, r, b, key, score + 0.5 * top + 0.4 * (1.0 - cover) + 0.3 * edge / 128.0 + CASE WHEN row IN (0, 2) OR col IN (0, 2) THEN 0.15::DOUBLE ELSE 0 END + bonus AS score FROM rsc),
ri AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, key) AS n FROM re),
{_kept('g', 'ri', 'ffi', 'len(kept) + 2', 'spatial_rescue')}, {_kept('l', 'it', 'gfi', 'greatest(len(kept), 6)', 'heatmap_fill')}
SELECT image_id, CAST(ord AS INTEGER) AS ord, k.l, k.t, k.r, k.b, round(k.score, 6) AS score, k.reason FROM (SELECT image_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS ord FROM lfi)""")
def q_heatmap_windows(spark, d):
    """Windows on heat-map peaks and rescue cells, scored with coverage and gradients: an image of 40 x 40 from every 25 embeddings."""
    ship(spark)
    heat, e = _heat(spark, d), table(spark, d, "embeddings")
    image, k = F.floor(F.col("vec_id") / 25).alias("image_id"), F.col("vec_id") % 25
    pixels = e.select(image, k.alias("k"), F.posexplode("embedding").alias("i", "v"))
    pixels = pixels.select("image_id", (F.floor(F.col("k") / 5) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), (F.col("k") % 5 * 8 + F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    left, top, n = F.col("vec_id") * 7 % 30, F.col("vec_id") * 11 % 30, F.col("vec_id")
    covered = e.select(image, *[c.cast("int").alias(s) for s, c in zip("ltrb", (left, top, left + 3 + n % 7, top + 2 + n % 5))])
    # The last image may lack patches; what isn't there isn't covered.
    there = e.select(image, (F.floor(k / 5) * 8).cast("int").alias("y"), (k % 5 * 8).cast("int").alias("x"))
    at = dict(zip("ltrb", (F.greatest("l", "x"), F.greatest("t", "y"), F.least("r", F.col("x") + 8), F.least("b", F.col("y") + 8))))
    covered = covered.join(there, "image_id").select("image_id", *[c.alias(s) for s, c in at.items()]).filter("l < r AND t < b")
    images = heat.select("image_id").distinct().withColumns({"width": F.lit(40), "height": F.lit(40)})
    return _rounded(wn.heatmap_windows(heat, images, [0.25, 0.35, 0.5], top_k=6, rescue=2, covered=covered, pixels=pixels, grid=(5, 5)))


@query("""WITH c AS (SELECT o_orderkey AS image_id, o_custkey % 160 AS cx, o_orderkey * 7 % 160 AS cy FROM orders), gd AS (SELECT cell // 3 AS row, cell % 3 AS col FROM range(9) r(cell)),
e AS (SELECT row, col, round_even(col * 160.0 / 3, 0) AS l, round_even((col + 1) * 160.0 / 3, 0) AS r, round_even(row * 160.0 / 3, 0) AS t, round_even((row + 1) * 160.0 / 3, 0) AS b FROM (SELECT CAST(row AS DOUBLE) AS row, CAST(col AS DOUBLE) AS col FROM gd))
SELECT image_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(least(0.4, sqrt(pow((l + r) / 2 - cx, 2) + pow((t + b) / 2 - cy, 2)) / sqrt(160.0 * 160 + 160 * 160) * 0.8), 6) AS bonus
FROM c CROSS JOIN e WHERE NOT (cx >= l AND cx < r AND cy >= t AND cy < b)""")
def q_spatial_rescue_cells(spark, d):
    o = table(spark, d, "orders")
    centres = o.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 160).cast("double").alias("cx"), (F.col("o_orderkey") * 7 % 160).cast("double").alias("cy"))
    imgs = fx.images(spark, d).select(F.col("id").alias("image_id"), "width", "height")
    return _rounded(wn.rescue_cells(centres, imgs).select("image_id", "row", "col", "bonus"))


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), q AS (SELECT vec_id, v, i // 8 AS y, i % 8 AS x FROM p),
gg AS (SELECT *, lag(v) OVER wy AS uy, lead(v) OVER wy AS dy, lag(v) OVER wx AS ux, lead(v) OVER wx AS dx FROM q WINDOW wy AS (PARTITION BY vec_id, x ORDER BY y), wx AS (PARTITION BY vec_id, y ORDER BY x))
SELECT vec_id, round(avg(sqrt(pow(CASE WHEN uy IS NULL THEN dy - v WHEN dy IS NULL THEN v - uy ELSE (dy - uy) / 2 END, 2) + pow(CASE WHEN ux IS NULL THEN dx - v WHEN dx IS NULL THEN v - ux ELSE (dx - ux) / 2 END, 2))), 6) AS edge FROM gg GROUP BY 1""")
def q_edge_density(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    px = e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))
    return _rounded(wn.edge_density(px, ["vec_id"]))


@query(f"WITH {fx.PATCHES}, e AS (SELECT a.image_id, a.y * 5 + a.x AS i, CASE WHEN list_dot_product(a.feat, c.feat) / sqrt(list_dot_product(a.feat, a.feat) * list_dot_product(c.feat, c.feat)) > 0.2 THEN 1.0::DOUBLE ELSE 0.00001::DOUBLE END AS w FROM pt a JOIN pt c ON a.image_id = c.image_id) SELECT image_id, i, round(sum(w), 6) AS degree FROM e GROUP BY 1, 2")
def q_affinity_degree(spark, d):
    return _rounded(gr.degrees(gr.affinity(fx.patches(spark, d), 0.2)))


@query(f"""WITH {fx.PATCHES}, v AS (SELECT image_id, y * 5 + x AS i, feat[1] AS v FROM pt), f AS (SELECT *, v > avg(v) OVER (PARTITION BY image_id) AS fg FROM v),
g AS (SELECT image_id, count(*) FILTER (fg AND i IN (0, 4, 20, 24)) AS corners, arg_max(fg, abs(v)) AS peak, arg_max(i, v) AS hi, arg_min(i, v) AS lo FROM f GROUP BY 1)
SELECT image_id, string_agg(CAST(CAST(fg <> (corners >= 3 OR NOT peak) AS INTEGER) AS VARCHAR), '' ORDER BY i) AS bits, CAST(any_value(CASE WHEN corners >= 3 OR NOT peak THEN lo ELSE hi END) AS INTEGER) AS seed, CAST(any_value(corners) AS INTEGER) AS corners
FROM f JOIN g USING (image_id) GROUP BY 1""")
def q_bipartition(spark, d):
    """A value of every patch parted at its mean and turned so that the peak is in front; its seed, and the corners in front before."""
    ship(spark)
    p = fx.patches(spark, d).select("image_id", "y", "x", F.col("feat")[0].alias("v"))
    return gr.bipartitions(p, (5, 5)).select("image_id", _said("bits"), "seed", "corners")


def _said(bits: str) -> Column:
    return F.array_join(F.transform(bits, lambda x: x.cast("string")), "").alias(bits)


def _signed(v: str) -> Column:
    """An eigenvector's entries, rounded, with its largest made positive."""
    w = Window.partitionBy("image_id")
    top = F.max_by(v, F.struct(F.round(F.abs(v), 9), -F.col("i"))).over(w)
    return F.round(F.col(v) * F.signum(top), 6).alias("v")


@query()
def q_ncut(spark, d):
    ship(spark)
    return gr.ncut(fx.patches(spark, d)).select("image_id", "i", _signed("v"), (F.col("residual") < 1e-8).alias("solved"))


@query()
def q_iterative_cut(spark, d):
    ship(spark)
    return gr.cut_masks(fx.patches(spark, d), shape=(5, 5)).select("image_id", "round", _said("bits"), "area")


def _scored_masks(spark, d):
    return fx.masks(spark, d).select("image_id", "mask_id", "bits", F.round(mk.area_ratio(F.col("bits")) * 3 + (F.col("mask_id") % 7) / 10, 6).alias("score"), (F.col("mask_id") % 25 < 3).alias("protected"))


@query(f"WITH RECURSIVE {ms.MASKS}, {ms.general('g', True)} SELECT image_id, rank, mask_ids, round(score, 6) AS score, area, protected FROM gout")
def q_merge_candidates(spark, d):
    ship(spark)
    return _rounded(mg.merge_candidates(_scored_masks(spark, d), 8, **ms.OPTIONS))


@query(f"WITH RECURSIVE {ms.MASKS}, {ms.conservative()} SELECT image_id, mask_ids, round(score, 6) AS score, reject_reason FROM cout")
def q_conservative_merge(spark, d):
    ship(spark)
    return _rounded(mg.conservative_merge(_scored_masks(spark, d), 8, **ms.OPTIONS))


@query(f"""WITH {fx.MASKS}, q AS (SELECT a.mask_id, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: z[1] * z[2])) AS i, list_sum(a.bits) AS na, list_sum(b.bits) AS nb FROM m a LEFT JOIN m b ON a.image_id = b.image_id AND b.mask_id % 25 < 3 WHERE a.mask_id % 25 >= 3)
SELECT mask_id, round(coalesce(max(i / (na + nb - i)), 0), 6) AS normal_iou FROM q GROUP BY 1""")
def q_max_iou(spark, d):
    m = fx.masks(spark, d)
    return _rounded(cd.max_iou(m.filter("mask_id % 25 >= 3"), m.filter("mask_id % 25 < 3")).select("mask_id", "normal_iou"))


#: Cuts of windows: a raw and a refined mask, and the window's corner on a canvas of 24 x 24.
_REFINED = f"""{fx.PIXELS}, w AS (SELECT vec_id AS mask_id, vec_id // 25 AS image_id, vec_id % 5 AS window_id, vec_id % 3 * 8 AS lft, vec_id // 3 % 3 * 8 AS top FROM embeddings),
rf AS (SELECT mask_id, y, x, v AS raw, CASE WHEN (y * 8 + x) % 9 = 4 THEN 0 ELSE v END AS v FROM p),
fa AS (SELECT mask_id, sum(v) AS area, sum(v) / nullif(sum(raw), 0) AS crf_iou, sum(v) FILTER (y = 0) AS et, sum(v) FILTER (y = 7) AS eb, sum(v) FILTER (x = 0) AS el, sum(v) FILTER (x = 7) AS er,
  max(y) FILTER (v = 1) - min(y) FILTER (v = 1) + 1 AS h, max(x) FILTER (v = 1) - min(x) FILTER (v = 1) + 1 AS wd FROM rf GROUP BY 1),
fb AS (SELECT w.*, area, crf_iou, h, wd, CASE WHEN top = 0 THEN 0 ELSE et END AS et, CASE WHEN top = 16 THEN 0 ELSE eb END AS eb, CASE WHEN lft = 0 THEN 0 ELSE el END AS el, CASE WHEN lft = 16 THEN 0 ELSE er END AS er FROM fa JOIN w USING (mask_id) WHERE crf_iou >= 0.3 AND area > 0),
fc AS (SELECT image_id, window_id, mask_id, area / 576.0::DOUBLE AS area_ratio, area / CAST(h * wd AS DOUBLE) AS compactness, greatest(h, wd) / CAST(least(h, wd) AS DOUBLE) AS aspect, least(1.0::DOUBLE, (et + eb + el + er) / greatest(1.0::DOUBLE, sqrt(area))) AS touch,
  (et > 0)::INT + (eb > 0)::INT + (el > 0)::INT + (er > 0)::INT AS sides, greatest(h, wd) / 8.0::DOUBLE AS fill, crf_iou FROM fb),
fs AS (SELECT *, 1.4 * exp(-0.5 * pow((log10(area_ratio) - log10(0.004::DOUBLE)) / 0.65, 2)) + 1.1 * compactness + 0.7 * 0.5 + 0.5 * crf_iou - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (aspect - 3.0) / 4.0)) - 1.2 * greatest(touch, sides / 4.0::DOUBLE)
  - CASE WHEN sides >= 2 AND fill > 0.75 THEN least(1.0::DOUBLE, (fill - 0.75) / 0.25) ELSE 0 END AS score FROM fc)"""


def _cuts(spark, d) -> DataFrame:
    refined = F.transform("bits", lambda x, i: F.when(i % 9 == 4, 0).otherwise(x).cast("tinyint"))
    k = F.col("mask_id")
    return fx.masks(spark, d).select("image_id", (k % 5).alias("window_id"), "mask_id", F.col("bits").alias("raw"), refined.alias("refined"), (k % 3 * 8).cast("int").alias("left"), (F.floor(k / 3) % 3 * 8).cast("int").alias("top"), F.lit(2.0).alias("crop_score"))


@query(f"""WITH {_REFINED}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id, window_id ORDER BY score DESC, mask_id) AS n FROM fs WHERE NOT (fill >= 1.01 AND (touch >= 0.5 OR sides >= 2)))
SELECT image_id, window_id, mask_id, round(area_ratio, 6) AS area_ratio, round(compactness, 6) AS compactness, round(aspect, 6) AS aspect, round(touch, 6) AS touch, CAST(sides AS INTEGER) AS sides, round(fill, 6) AS fill, round(crf_iou, 6) AS crf_iou, round(score, 6) AS score FROM k WHERE n <= 3""")
def q_refine_candidates(spark, d):
    ship(spark)
    return _rounded(cd.choose(cd.refine(_cuts(spark, d), 8, 24, 24), per_window=3, fill_at=1.01).drop("bits", "counts"))


@query(f"""WITH RECURSIVE {ms.MASKS}, {ms.general('a', False)}, {ms.general('b', True)}
SELECT 'multiscale' AS split, image_id, rank, mask_ids, round(score, 6) AS score, area FROM aout UNION ALL SELECT 'combined', image_id, rank, mask_ids, round(score, 6), area FROM bout
UNION ALL SELECT 'normal', image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY mask_id) AS INTEGER), CAST(mask_id AS VARCHAR), score, CAST(area AS BIGINT) FROM ms WHERE protected
UNION ALL SELECT 'raw_multiscale', image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, mask_id) AS INTEGER), CAST(mask_id AS VARCHAR), score, CAST(area AS BIGINT) FROM ms WHERE NOT protected""")
def q_splits(spark, d):
    ship(spark)
    m = _scored_masks(spark, d)
    return _rounded(cd.splits(m.filter("NOT protected"), m.filter("protected"), 8, **ms.OPTIONS))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS stamp, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE replace(o_orderpriority, '_', ' ') END AS label FROM orders")
def q_label_map(spark, d):
    o = table(spark, d, "orders")
    code = F.when(F.col("o_orderstatus") == "O", "O").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), cd.iso_timestamp(F.col("o_orderdate")).alias("stamp"), cd.label_map(code, {"O": "open"}).alias("label"))


def _gt_pred(spark, d):
    a = fx.annotations(spark, d)
    return a.filter("flag = 'N'"), a.filter("flag = 'R'")


_BEST = f"gt AS (SELECT * FROM ann WHERE flag = 'N'), pr AS (SELECT * FROM ann WHERE flag = 'R'), pairs AS (SELECT x.image_id, x.ann_id AS gt_id, y.ann_id AS pred_id, {_iou('x', 'y')} AS iou FROM gt x JOIN pr y ON x.image_id = y.image_id), bin AS (SELECT image_id, ann_id AS gt_id, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS size_bin FROM gt), best AS (SELECT b.image_id, b.gt_id, size_bin, coalesce(max(iou), 0) AS best_iou FROM bin b LEFT JOIN pairs p ON p.gt_id = b.gt_id GROUP BY 1, 2, 3)"


@query(f"WITH {fx.ANN}, {_BEST} SELECT image_id, gt_id, size_bin, round(best_iou, 6) AS best_iou FROM best")
def q_best_iou(spark, d):
    return _rounded(ev.best_iou(*_gt_pred(spark, d)))


@query(f"WITH {fx.ANN}, {_BEST} SELECT coalesce(size_bin, 'all') AS size_bin, count(*) AS n_gt, round(avg((best_iou >= 0.25)::INT), 6) AS recall_25, round(avg((best_iou >= 0.5)::INT), 6) AS recall_50, round(avg((best_iou >= 0.75)::INT), 6) AS recall_75, round(avg(best_iou), 6) AS mean_best_iou FROM best GROUP BY ROLLUP (size_bin)")
def q_recall_at_iou(spark, d):
    return _rounded(ev.recall_by_size(ev.best_iou(*_gt_pred(spark, d))))


@query(f"""WITH {fx.ANN}, {_BEST}, rk AS (SELECT image_id, ann_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rank FROM pr),
fi AS (SELECT gt_id, min(rank) AS first FROM pairs JOIN rk ON rk.ann_id = pred_id WHERE iou >= 0.5 GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, size_bin, count(*) AS n_gt, round(avg(coalesce((first <= k)::INT, 0)), 6) AS recall FROM bin LEFT JOIN fi USING (gt_id) CROSS JOIN (VALUES (1), (3), (5), (10), (20)) v(k) GROUP BY 1, 2""")
def q_ar_at_k(spark, d):
    return _rounded(ev.recall_at_k(*_gt_pred(spark, d)))


@query(f"WITH {fx.ANN}, {_BEST}, m AS (SELECT gt_id, count(*) AS n FROM pairs WHERE iou >= 0.5 GROUP BY 1) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS matched, round(sum(n - 1) / count(*), 6) AS duplicate_rate FROM m")
def q_duplicate_rate(spark, d):
    return _rounded(ev.duplicate_rate(*_gt_pred(spark, d)))


@query(f"WITH {fx.ANN}, {_BEST}, m AS (SELECT pred_id FROM pairs WHERE iou >= 0.25 GROUP BY 1 HAVING count(*) >= 2) SELECT (SELECT count(*) FROM m) AS overmerged, (SELECT count(*) FROM pr) AS n_pred, round((SELECT count(*) FROM m) / (SELECT count(*) FROM pr), 6) AS overmerge_rate")
def q_overmerge_rate(spark, d):
    return _rounded(ev.overmerge_rate(*_gt_pred(spark, d)))


#: Every prediction, best first, takes the free true object of highest IoU; those of the class go first.
_AP = f"""WITH RECURSIVE {fx.ANN}, {_BEST}, vr AS (SELECT size, lo, hi, thr FROM (VALUES ('all', 0, 10000000000), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 10000000000)) s(size, lo, hi), (SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS thr FROM range(10) r(k))),
rk AS (SELECT image_id, ann_id AS pred_id, score, area, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS n FROM pr),
op AS (SELECT p.image_id, p.pred_id, list({{'x': CAST(g.area < lo OR g.area > hi AS INTEGER), 'i': -iou, 'g': p.gt_id}} ORDER BY CAST(g.area < lo OR g.area > hi AS INTEGER), -iou, p.gt_id) AS options, size, thr FROM pairs p JOIN gt g ON g.ann_id = p.gt_id JOIN vr ON iou >= thr GROUP BY p.image_id, p.pred_id, size, thr),
st(image_id, size, thr, n, used, x) AS (
  SELECT DISTINCT image_id, size, thr, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS INTEGER) FROM op
  UNION ALL
  SELECT s.image_id, s.size, s.thr, s.n + 1, CASE WHEN f.o IS NULL THEN s.used ELSE list_append(s.used, f.o.g) END, f.o.x
  FROM st s JOIN rk ON rk.image_id = s.image_id AND rk.n = s.n + 1 LEFT JOIN op ON op.image_id = s.image_id AND op.size = s.size AND op.thr = s.thr AND op.pred_id = rk.pred_id,
  LATERAL (SELECT list_filter(op.options, lambda o: NOT list_contains(s.used, o.g))[1] AS o) f
),
mk AS (SELECT v.size, v.thr, r.score, coalesce(s.x, CAST(r.area < v.lo OR r.area > v.hi AS INTEGER)) AS x, s.x IS NOT NULL AS hit FROM rk r CROSS JOIN vr v LEFT JOIN st s ON s.image_id = r.image_id AND s.n = r.n AND s.size = v.size AND s.thr = v.thr),
cu AS (SELECT size, thr, sum(tp) OVER w AS tp, sum(n) OVER w AS n FROM (SELECT size, thr, score, count(*) FILTER (hit) AS tp, count(*) AS n FROM mk WHERE x = 0 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY size, thr ORDER BY score DESC)),
ng AS (SELECT size, count(*) AS n_gt FROM gt JOIN (SELECT DISTINCT size, lo, hi FROM vr) ON area >= lo AND area <= hi GROUP BY 1),
be AS (SELECT size, thr, floor(tp / n_gt * 100 + 1e-9) AS step, max(tp / n) AS p FROM cu JOIN ng USING (size) GROUP BY 1, 2, 3),
ev AS (SELECT v.size, v.thr, k, (SELECT coalesce(max(p), 0) FROM be WHERE be.size = v.size AND be.thr = v.thr AND be.step >= k) AS p FROM vr v JOIN ng USING (size) CROSS JOIN range(101) r(k)),
ap AS (SELECT size, thr, avg(p) AS ap FROM ev GROUP BY 1, 2)
SELECT round(avg(ap) FILTER (size = 'all'), 6) AS AP, round(avg(ap) FILTER (size = 'all' AND thr = 0.5), 6) AS AP50, round(avg(ap) FILTER (size = 'all' AND thr = 0.75), 6) AS AP75,
  round(avg(ap) FILTER (size = 'small'), 6) AS APs, round(avg(ap) FILTER (size = 'medium'), 6) AS APm, round(avg(ap) FILTER (size = 'large'), 6) AS APl FROM ap"""


@query(_AP)
def q_average_precision(spark, d):
    return _rounded(ev.coco_ap(*_gt_pred(spark, d)))


@query(f"WITH {fx.ANN}, p AS (SELECT * FROM ann WHERE flag = 'R') SELECT round(count(*) / count(DISTINCT image_id), 6) AS masks_per_image, round(avg(area), 6) AS mean_area, round(median(area), 6) AS med_area, round(avg((area < 1024)::INT), 6) AS small_share, round(avg((l = 0 OR t = 0 OR r = 160 OR b = 160)::INT), 6) AS border_share FROM p")
def q_pred_stats(spark, d):
    return _rounded(ev.pred_stats(_gt_pred(spark, d)[1], fx.SIZE, fx.SIZE))


@query(f"WITH {fx.ANN} SELECT ann_id, image_id, image_id * 10 + 7 AS real_id FROM ann JOIN orders ON o_orderkey = image_id")
def q_id_remap(spark, d):
    i = fx.images(spark, d)
    real = i.select((F.col("id") * 10 + 7).alias("id"), F.concat(F.lit("val2017\\"), F.col("id"), F.lit(".jpg")).alias("file_name"))
    return ev.id_remap(fx.annotations(spark, d).select("ann_id", "image_id"), i, real).select("ann_id", "image_id", "real_id")


_V = [f"((s_suppkey * {k} + s_nationkey * 7) % 1000 // 10) + ((s_suppkey * {k} + s_nationkey * 7) % 10) / 10.0" for k in (3, 5, 7, 11, 13, 17)]
_METRICS = ", ".join(f"CAST({v} AS DOUBLE) AS {m}" for v, m in zip(_V, rd.METRICS))


@query(f"SELECT 'run' || s_suppkey AS run, 'bbox' AS task, {_METRICS} FROM supplier")
def q_log_metrics(spark, d):
    return rd.eval_metrics(fx.log_lines(spark, d))


@query(f"WITH m AS (SELECT 'run' || s_suppkey AS run, {_METRICS} FROM supplier) SELECT run, APs, CAST(row_number() OVER (ORDER BY APs DESC, run) AS INTEGER) AS rank FROM m")
def q_rank_runs(spark, d):
    return rd.rank_runs(rd.eval_metrics(fx.log_lines(spark, d)).filter("task = 'bbox'")).select("run", "APs", "rank")


_NICE = "CASE WHEN v / e <= 1 THEN e WHEN v / e <= 2 THEN 2 * e WHEN v / e <= 5 THEN 5 * e ELSE 10 * e END"


@query(f"""WITH s AS (SELECT event_type AS run, max(event_id) AS max_iteration, count(*) AS points, arg_max(value, event_id) AS last_value, greatest(max(value), 1.0) * 1.10 AS v FROM events WHERE value IS NOT NULL GROUP BY 1), t AS (SELECT *, pow(10.0, floor(log10(v))) AS e FROM s)
SELECT run, max_iteration, points, round(last_value, 6) AS last_value, round({_NICE}, 6) AS y_max FROM t""")
def q_series_summary(spark, d):
    return _rounded(st.series_summary(fx.points(spark, d)))


@query(f"WITH s AS (SELECT o_orderkey AS id, o_totalprice AS v, pow(10.0, floor(log10(o_totalprice))) AS e FROM orders WHERE o_totalprice > 0) SELECT id, round({_NICE}, 6) AS nice FROM s")
def q_nice_max(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 0").select(F.col("o_orderkey").alias("id"), r6(sc.nice_max(F.col("o_totalprice"))).alias("nice"))


@query("""WITH v AS (SELECT o_orderpriority AS variant, count(*) AS windows, count(*) FILTER (o_orderstatus = 'F') AS full_masks, sum(o_custkey % 3) AS generated, count(*) FILTER (o_custkey % 3 = 1) AS crop_merged, count(*) FILTER (o_custkey % 3 > 0) AS merged FROM orders GROUP BY 1)
SELECT variant, round(100.0::DOUBLE * crop_merged / greatest(generated, 1), 6) AS keep_ratio, round(100.0::DOUBLE * merged / greatest(windows, 1), 6) AS yield, CAST(merged - full_masks AS INTEGER) AS added, CAST(merged - (SELECT merged FROM v WHERE variant = '1-URGENT') AS INTEGER) AS delta FROM v""")
def q_ablation_ratios(spark, d):
    """Counters of every variant through a result CSV, and their ratios."""
    one = lambda c: F.count_if(c)
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(
        one(F.col("o_orderstatus") == "F").alias("full_masks"), F.count(F.lit(1)).alias("windows"), F.sum(F.col("o_custkey") % 3).alias("generated"),
        one(F.col("o_custkey") % 3 == 1).alias("crop_merged"), one(F.col("o_custkey") % 3 > 0).alias("merged"),
    )
    path = f"{shared_dir(spark)}/segmill/ablation-{uuid.uuid4().hex}"
    o.write.csv(path, header=True)
    rows = rd.csv_table(spark, path, "variant STRING, full_masks INT, windows INT, generated INT, crop_merged INT, merged INT")
    return _rounded(st.ablation_ratios(rows, "1-URGENT"))


@query("""WITH p AS (SELECT l_returnflag AS variant, count(*) AS annotations FROM lineitem GROUP BY 1), e AS (SELECT o_orderstatus AS variant, round(avg(o_totalprice), 4) AS ap FROM orders GROUP BY 1)
SELECT variant, annotations, ap FROM p FULL JOIN e USING (variant)""")
def q_variant_summary(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.count(F.lit(1)).alias("annotations"))
    e = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("variant")).agg(F.round(F.avg("o_totalprice"), 4).alias("ap"))
    return st.variant_summary(p, e)


@query("WITH f AS (SELECT n_name AS folder, row_number() OVER (ORDER BY n_name) - 1 AS place FROM nation) SELECT folder, CAST(place AS INTEGER) AS place FROM f WHERE place >= 5 AND place < 10")
def q_shard_range(spark, d):
    return ps.shard_range(table(spark, d, "nation").select(F.col("n_name").alias("folder")), "folder", 1, 5)


@query("WITH f AS (SELECT p_brand AS class, p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS place FROM part) SELECT * FROM f WHERE place <= 2")
def q_class_head_n(spark, d):
    return ps.class_head(table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("id")), "class", "id", 2)


@query("SELECT n_nationkey AS id, variant, percentile AS heatmap_percentile, top_k AS heatmap_top_k, sizes AS heatmap_crop_sizes FROM nation CROSS JOIN (VALUES ('baseline', 85.0::DOUBLE, 12, '0.25,0.35,0.5'), ('hp90', 90.0, 12, '0.25,0.35,0.5'), ('hp80', 80.0, 12, '0.25,0.35,0.5'), ('topk8', 85.0, 8, '0.25,0.35,0.5'), ('tightcrop', 85.0, 12, '0.2,0.3,0.4')) v(variant, percentile, top_k, sizes)")
def q_ablation_matrix(spark, d):
    return ps.ablation_matrix(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("id")))


@query(f"""WITH {fx.PIXELS}, o AS (SELECT mask_id, v, x * 8 + y AS k FROM p), c AS (SELECT *, CASE WHEN v <> coalesce(lag(v) OVER (PARTITION BY mask_id ORDER BY k), 0) THEN 1 ELSE 0 END AS step FROM o),
rn AS (SELECT mask_id, v, sum(step) OVER (PARTITION BY mask_id ORDER BY k) AS run FROM c), ln AS (SELECT mask_id, run, count(*) AS n FROM rn GROUP BY 1, 2),
al AS (SELECT mask_id, r.run, coalesce(n, 0) AS n FROM (SELECT DISTINCT mask_id FROM ln) CROSS JOIN (SELECT unnest(range(0, 65)) AS run) r LEFT JOIN ln USING (mask_id, run) WHERE r.run <= (SELECT max(run) FROM ln l2 WHERE l2.mask_id = ln.mask_id) OR (r.run = 0))
SELECT mask_id, string_agg(n, ',' ORDER BY run) AS counts FROM al GROUP BY 1""")
def q_rle_runs(spark, d):
    ship(spark)
    return fx.masks(spark, d).select("mask_id", F.array_join(F.transform(rn.of_bits("bits", 8), lambda x: x.cast("string")), ",").alias("counts"))


from . import generator_queries, more_queries, run_queries  # noqa: E402, F401  (add their own)


def queries():
    return dict(FOUND)


def oracle_sql():
    return dict(SQL)
