"""The generator's plan on images of 48 x 48, an image of every 25 embeddings; cuts come from the embeddings' values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from . import generator as gn
from . import merge_sql as ms
from .queries import query

SIDE = 48
SETTINGS = gn.Settings(SIDE, SIDE, 8, SIDE, most_covered=0.12, top_k=8, per_window=3, fill_at=0.95, merge=ms.OPTIONS | {"top_k": 6})


def _windows() -> list[tuple[int, int, int, int]]:
    """(ord, x, y, side) of the grid: 48, 36 and 24 wide, 30 % over one another."""
    found = []
    for side in (48, 36, 24):
        axis = sorted({*range(0, SIDE - side + 1, round(side * 0.7)), SIDE - side})
        found += [(x, y, side) for y in axis for x in axis]
    return [(n, *w) for n, w in enumerate(found, 1)]


def _cut(embeddings: DataFrame, n: int):
    """Two masks of every window: an embedding's values above 0.12, refined to those above 0.16."""
    bits = lambda least: F.transform("embedding", lambda v: (v.cast("double") > least).cast("tinyint"))
    sources = embeddings.select("vec_id", bits(0.12).alias("raw"), bits(0.16).alias("refined"))

    def cut(windows: DataFrame) -> DataFrame:
        each = windows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("vec_id", (F.col("image_id") * 25 + (F.col("window_id") + 1) * 7 + F.col("retry") * 3 + F.col("k") * 11) % n)
        name = F.col("image_id") * 1_000_000 + (F.col("window_id") + 1) * 1000 + F.col("retry") * 100 + F.col("k")
        return each.join(sources, "vec_id").select(*gn.WINDOW, name.alias("mask_id"), "raw", "refined")

    return cut


def _cuts_sql(t: str) -> str:
    """{t}px: the pixels of the refined masks of {t}w(image_id, window_id, retry, l, t, r, b, crop_score); {t}c: the candidates."""
    return f"""{t}m AS (SELECT w.*, image_id * 1000000 + (window_id + 1) * 1000 + retry * 100 + k AS mask_id, (image_id * 25 + (window_id + 1) * 7 + retry * 3 + k * 11) % (SELECT count(*) FROM embeddings) AS vec_id FROM {t}w w, range(2) q(k)),
{t}px AS (SELECT mask_id, image_id, y, x FROM (SELECT m.*, q.y, z.x, CAST(floor((q.y - t + 0.5) * 8 / (b - t)) * 8 + floor((z.x - l + 0.5) * 8 / (r - l)) AS INTEGER) AS i FROM {t}m m JOIN range({SIDE}) q(y) ON q.y >= t AND q.y < b JOIN range({SIDE}) z(x) ON z.x >= l AND z.x < r JOIN cf USING (vec_id) WHERE crf_iou >= 0.3)
  JOIN embeddings USING (vec_id) WHERE CAST(embedding[i + 1] AS DOUBLE) > 0.16),
{t}f AS (SELECT m.mask_id, count(*) AS area, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS wd, count(*) FILTER (y = t AND t > 0) AS et, count(*) FILTER (y = b - 1 AND b < {SIDE}) AS eb, count(*) FILTER (x = l AND l > 0) AS el, count(*) FILTER (x = r - 1 AND r < {SIDE}) AS er FROM {t}px JOIN {t}m m USING (mask_id) GROUP BY 1),
{t}g AS (SELECT m.*, area, h, wd, area / {SIDE * SIDE}.0::DOUBLE AS ratio, area / CAST(h * wd AS DOUBLE) AS compact, greatest(h, wd) / CAST(least(h, wd) AS DOUBLE) AS aspect, least(1.0::DOUBLE, (et + eb + el + er) / greatest(1.0::DOUBLE, sqrt(area))) AS touch,
  (et > 0)::INT + (eb > 0)::INT + (el > 0)::INT + (er > 0)::INT AS sides, greatest(wd / CAST(r - l AS DOUBLE), h / CAST(b - t AS DOUBLE)) AS fill, crf_iou FROM {t}f JOIN {t}m m USING (mask_id) JOIN cf USING (vec_id)),
{t}c AS (SELECT *, 1.4 * exp(-0.5 * pow((log10(ratio) - log10(0.004::DOUBLE)) / 0.65, 2)) + 1.1 * compact + 0.7 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, crop_score / 4.0)) + 0.5 * crf_iou - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (aspect - 3.0) / 4.0)) - 1.2 * greatest(touch, sides / 4.0::DOUBLE)
  - CASE WHEN sides >= 2 AND fill > 0.75 THEN least(1.0::DOUBLE, (fill - 0.75) / 0.25) ELSE 0 END AS score, fill >= 0.95 AND (touch >= 0.5 OR sides >= 2) AS shaped FROM {t}g)"""


def _grown(c: str) -> str:
    return f"CAST(greatest(least(greatest(round_even({c} - side / 2.0, 0), 0), {SIDE} - side), 0) AS INTEGER)"


_PLAN = f"""WITH RECURSIVE im AS (SELECT DISTINCT vec_id // 25 AS image_id FROM embeddings), gw(ord, x, y, w) AS (VALUES {', '.join(map(str, _windows()))}),
cf AS (SELECT vec_id, len(list_filter(embedding, lambda v: CAST(v AS DOUBLE) > 0.16)) / nullif(len(list_filter(embedding, lambda v: CAST(v AS DOUBLE) > 0.12)), 0) AS crf_iou FROM embeddings),
fw AS (SELECT image_id, -1 AS window_id, 0 AS retry, 0 AS l, 0 AS t, {SIDE} AS r, {SIDE} AS b, 0.0::DOUBLE AS crop_score FROM im), {_cuts_sql('f')},
un AS (SELECT DISTINCT image_id, y, x FROM fpx),
cv AS (SELECT i.image_id, ord AS window_id, g.x AS l, g.y AS t, g.x + w AS r, g.y + w AS b, (SELECT count(*) FROM un WHERE un.image_id = i.image_id AND un.x >= g.x AND un.x < g.x + w AND un.y >= g.y AND un.y < g.y + w) / CAST(w * w AS DOUBLE) AS covered FROM im i CROSS JOIN gw g WHERE w < {SIDE}),
ew AS (SELECT image_id, window_id, 0 AS retry, l, t, r, b, (1.0 - covered) * 1.0::DOUBLE AS crop_score, row_number() OVER (PARTITION BY image_id ORDER BY (1.0 - covered) * 1.0::DOUBLE DESC, window_id) AS n FROM cv WHERE covered < 0.12),
gw1 AS (SELECT * EXCLUDE (n) FROM ew WHERE n <= 8), aw AS (SELECT * FROM gw1), {_cuts_sql('a')},
bs AS (SELECT image_id, window_id, arg_max({{'touch': touch, 'sides': sides}}, (score, -mask_id)) AS m FROM ac GROUP BY 1, 2),
tr AS (SELECT aw.*, k, scale, CAST(greatest(2, least(round_even(greatest(r - l, b - t) * scale, 0), {SIDE})) AS INTEGER) AS side FROM aw LEFT JOIN bs USING (image_id, window_id), (VALUES (1, 1.4::DOUBLE), (2, 1.8::DOUBLE)) v(k, scale) WHERE m IS NULL OR m.touch >= 0.5 OR m.sides >= 2),
tb AS (SELECT image_id, window_id, k AS retry, {_grown('(l + r) / 2.0')} AS nl, {_grown('(t + b) / 2.0')} AS nt, side, l, t, r, b, crop_score FROM tr),
bw AS (SELECT image_id, window_id, retry, nl AS l, nt AS t, nl + side AS r, nt + side AS b, crop_score FROM tb WHERE NOT (nl = l AND nt = t AND nl + side = r AND nt + side = b)), {_cuts_sql('b')},
al AS (SELECT * FROM ac UNION ALL SELECT * FROM bc), ch AS (SELECT *, row_number() OVER (PARTITION BY image_id, window_id ORDER BY score DESC, mask_id) AS n FROM al WHERE NOT shaped), kp AS (SELECT * FROM ch WHERE n <= 3),
apx AS (SELECT * FROM fpx UNION ALL SELECT * FROM (SELECT * FROM bpx UNION ALL SELECT mask_id, image_id, y, x FROM a0px)),
sp AS (SELECT mask_id, image_id, y * {SIDE} + x AS k FROM apx WHERE mask_id IN (SELECT mask_id FROM kp UNION ALL SELECT mask_id FROM fc)),
ms AS (SELECT mask_id, c.image_id, c.area, min(k // {SIDE}) AS y0, max(k // {SIDE}) AS y1, min(k % {SIDE}) AS x0, max(k % {SIDE}) AS x1, any_value(c.score) AS score, any_value(c.own) AS protected
  FROM (SELECT mask_id, image_id, area, score, false AS own FROM kp UNION ALL SELECT mask_id, image_id, area, score, true FROM fc) c JOIN sp USING (mask_id) GROUP BY 1, 2, 3),
ov AS (SELECT a.mask_id AS u, b.mask_id AS w, count(*) AS n FROM sp a JOIN sp b ON a.image_id = b.image_id AND a.k = b.k GROUP BY 1, 2),
{ms.general('y', False, 6, SIDE)}, {ms.general('z', True, 6, SIDE)}""".replace("apx AS (SELECT * FROM fpx", "allpx AS (SELECT * FROM fpx").replace("a0px", "apx").replace("x AS k FROM apx", "x AS k FROM allpx")


def _of(name: str, rows: str) -> str:
    return f"CAST((SELECT count(*) FROM {rows} q WHERE q.image_id = im.image_id) AS INTEGER) AS {name}"


_COUNTS = [
    _of("full_masks", "fc"), f"CAST({len(_windows())} AS INTEGER) AS total_windows", _of("skipped_covered", "(SELECT * FROM cv WHERE covered >= 0.12)"), _of("eligible_windows", "ew"), _of("ranked_windows", "aw"), "0 AS rescue_windows",
    _of("crop_windows", "aw"), _of("generated_crop_candidates", "al"), _of("crop_candidates", "kp"), _of("crop_merged_masks", "yout"), _of("merged_masks", "zout"), _of("scored_candidates", "kp"),
    _of("border_retry_windows", "bw"), _of("crop_shape_rejected", "(SELECT * FROM al WHERE shaped)"),
]


def _generated(spark, d):
    ship(spark)
    e = table(spark, d, "embeddings")
    images = e.select(F.floor(F.col("vec_id") / 25).alias("image_id")).distinct()
    return gn.generate(images, _cut(e, e.count()), SETTINGS)


@query(f"{_PLAN} SELECT image_id, {', '.join(_COUNTS)} FROM im")
def q_generator_counters(spark, d):
    """Every image's counters from the whole plan."""
    return _generated(spark, d)[1]


@query(f"""{_PLAN} SELECT 'multiscale' AS split, image_id, rank, mask_ids, round(score, 6) AS score, area FROM yout UNION ALL SELECT 'combined', image_id, rank, mask_ids, round(score, 6), area FROM zout
UNION ALL SELECT 'normal', image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY mask_id) AS INTEGER), CAST(mask_id AS VARCHAR), round(score, 6), CAST(area AS BIGINT) FROM fc
UNION ALL SELECT 'raw_multiscale', image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, mask_id) AS INTEGER), CAST(mask_id AS VARCHAR), round(score, 6), CAST(area AS BIGINT) FROM kp""")
def q_generator_splits(spark, d):
    """The labels of all four splits from the whole plan."""
    return _generated(spark, d)[0].withColumn("score", F.round("score", 6))
