"""SQL of the fragment merges over the small masks: links, components by closure, unions as pixels, and the ordered choice by recursion."""

from __future__ import annotations

from . import fixtures as fx

#: The queries' bounds.
MAX_RATIO, IOU, IOS, EXPAND = 0.8, 0.4, 0.7, -0.2
OPTIONS = {"max_ratio": MAX_RATIO, "iou": IOU, "ios": IOS, "expand": EXPAND}

#: ms: every mask with its facts; on: its set pixels; ov: how many any two of an image share.
MASKS = f"""{fx.PIXELS}, ms AS (SELECT mask_id, any_value(image_id) AS image_id, sum(v) AS area, min(y) FILTER (v = 1) AS y0, max(y) FILTER (v = 1) AS y1, min(x) FILTER (v = 1) AS x0, max(x) FILTER (v = 1) AS x1,
  round(sum(v) / 64.0::DOUBLE * 3 + mask_id % 7 / 10.0::DOUBLE, 6) AS score, mask_id % 25 < 3 AS protected FROM p GROUP BY mask_id),
sp AS (SELECT mask_id, image_id, y * 8 + x AS k FROM p WHERE v = 1),
ov AS (SELECT a.mask_id AS u, b.mask_id AS w, count(*) AS n FROM sp a JOIN sp b ON a.image_id = b.image_id AND a.k = b.k GROUP BY 1, 2)"""


def components(t: str, eligible: str, side: int = 8) -> str:
    """{t}el: the masks that take part; {t}lb: each one's component, named by its smallest mask."""
    near = " AND ".join(f"a.{d}0 - (a.{d}1 - a.{d}0) * {EXPAND}::DOUBLE < b.{d}1 + (b.{d}1 - b.{d}0) * {EXPAND}::DOUBLE AND b.{d}0 - (b.{d}1 - b.{d}0) * {EXPAND}::DOUBLE < a.{d}1 + (a.{d}1 - a.{d}0) * {EXPAND}::DOUBLE" for d in "yx")
    return f"""{t}el AS (SELECT * FROM ms WHERE {eligible}),
{t}lk AS (SELECT a.mask_id AS u, b.mask_id AS w FROM {t}el a JOIN {t}el b ON a.image_id = b.image_id AND a.mask_id <> b.mask_id LEFT JOIN ov ON ov.u = a.mask_id AND ov.w = b.mask_id
  WHERE coalesce(n, 0) / CAST(a.area + b.area - coalesce(n, 0) AS DOUBLE) > {IOU} OR coalesce(n, 0) / CAST(least(a.area, b.area) AS DOUBLE) > {IOS} OR ({near})),
{t}rc(u, w) AS (SELECT mask_id, mask_id FROM {t}el UNION SELECT r.u, l.w FROM {t}rc r JOIN {t}lk l ON l.u = r.w),
{t}lb AS (SELECT u AS mask_id, min(w) AS label FROM {t}rc GROUP BY 1),
{t}ux AS (SELECT DISTINCT label, k FROM {t}lb JOIN sp USING (mask_id)),
{t}uf AS (SELECT label, count(*) AS area, max(k // {side}) - min(k // {side}) + 1 AS h, max(k % {side}) - min(k % {side}) + 1 AS w FROM {t}ux GROUP BY 1),
{t}gr AS (SELECT label, any_value(image_id) AS image_id, count(*) AS n, max(score) AS top, arg_max(mask_id, (score, -mask_id)) AS best FROM {t}lb JOIN {t}el USING (mask_id) GROUP BY 1)"""


def pool(t: str, valid: str, step: float, rest: str, order: str) -> str:
    """{t}po: the candidates in order: valid unions, and of the others every member or, as ``rest`` says, some; {t}pp: their pixels; {t}px: what two of an image share."""
    return f"""{t}va AS (SELECT label, n > 1 AND {valid} AS ok FROM {t}gr JOIN {t}uf USING (label)),
{t}pl AS (SELECT image_id, 'u' || label AS pid, label, -1 AS member, top - {step}::DOUBLE * (n - 1) AS score, (SELECT string_agg(mask_id, ',' ORDER BY mask_id) FROM {t}lb q WHERE q.label = g.label) AS mask_ids FROM {t}gr g JOIN {t}va USING (label) WHERE ok
  UNION ALL SELECT e.image_id, 'm' || mask_id, label, mask_id, e.score, CAST(mask_id AS VARCHAR) FROM {t}lb JOIN {t}va USING (label) JOIN {t}gr g USING (label) JOIN {t}el e USING (mask_id) WHERE NOT ok AND {rest}),
{t}pp AS (SELECT pid, image_id, k FROM {t}pl JOIN {t}ux USING (label) WHERE member < 0 UNION ALL SELECT pid, q.image_id, k FROM {t}pl q JOIN sp ON sp.mask_id = q.member),
{t}po AS (SELECT q.*, a.area, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, {order}, label, member) AS n FROM {t}pl q JOIN (SELECT pid, count(*) AS area FROM {t}pp GROUP BY 1) a USING (pid)),
{t}px AS (SELECT a.pid AS u, b.pid AS w, count(*) AS n FROM {t}pp a JOIN {t}pp b ON a.image_id = b.image_id AND a.k = b.k AND a.pid <> b.pid GROUP BY 1, 2),
{t}own AS (SELECT q.pid, m.mask_id, m.area AS own_area, q.area, count(*) AS n FROM {t}po q JOIN {t}pp x USING (pid) JOIN sp ON sp.image_id = q.image_id AND sp.k = x.k JOIN ms m ON m.mask_id = sp.mask_id AND m.protected GROUP BY ALL)"""


def iou(n: str, a: str, b: str) -> str:
    return f"({n} / CAST({a} + {b} - {n} AS DOUBLE))"


def ios(n: str, a: str, b: str) -> str:
    return f"({n} / CAST(least({a}, {b}) AS DOUBLE))"


def general(t: str, own: bool, top_k: int = 12, side: int = 8) -> str:
    """{t}out(image_id, rank, mask_ids, score, area, protected): the general merge, with protected masks or without."""
    blocked = f"pid IN (SELECT pid FROM {t}own WHERE {iou('n', 'area', 'own_area')} > {IOU})" if own else "false"
    valid = f"area / {side * side}.0 <= {MAX_RATIO} AND greatest(h, w) / CAST(least(h, w) AS DOUBLE) <= 3.0"
    hits = f"SELECT x.u, x.w FROM {t}px x JOIN {t}po a ON a.pid = x.u JOIN {t}po b ON b.pid = x.w WHERE {iou('x.n', 'a.area', 'b.area')} > {IOU} OR {ios('x.n', 'a.area', 'b.area')} > {IOS}"
    return f"""{components(t, f"NOT protected AND area / {side * side}.0 BETWEEN 0.0001 AND {MAX_RATIO}", side)},
{pool(t, valid, 0.03, "true", "area DESC")},
{t}hit AS ({hits}), {t}bl AS (SELECT pid, {blocked} AS blocked FROM {t}po),
{t}st(image_id, n, kept) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM {t}po UNION ALL
  SELECT s.image_id, s.n + 1, CASE WHEN blocked OR len(s.kept) >= {top_k} OR EXISTS (SELECT 1 FROM {t}hit h WHERE h.u = q.pid AND list_contains(s.kept, h.w)) THEN s.kept ELSE list_append(s.kept, q.pid) END
  FROM {t}st s JOIN {t}po q ON q.image_id = s.image_id AND q.n = s.n + 1 JOIN {t}bl USING (pid)),
{t}fi AS (SELECT image_id, unnest(arg_max(kept, n)) AS pid, generate_subscripts(arg_max(kept, n), 1) AS place FROM {t}st GROUP BY 1),
{t}ow AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY mask_id) AS rank, mask_id, score, area FROM ms WHERE protected AND area / {side * side}.0 >= 0.0001 AND {str(own).lower()}),
{t}out AS (SELECT image_id, CAST(rank AS INTEGER) AS rank, CAST(mask_id AS VARCHAR) AS mask_ids, score, CAST(area AS BIGINT) AS area, true AS protected FROM {t}ow
  UNION ALL SELECT f.image_id, CAST(place + (SELECT count(*) FROM {t}ow o WHERE o.image_id = f.image_id) AS INTEGER), mask_ids, score, area, false FROM {t}fi f JOIN {t}po USING (pid))"""


def conservative(t: str = "c") -> str:
    """{t}out(image_id, mask_ids, score, reject_reason): the conservative merge."""
    side = lambda a: f"(y1 - y0 + 1) {a} (x1 - x0 + 1)"
    gate = f"area / 64.0 BETWEEN 0.0001 AND {MAX_RATIO} AND score >= 1.0 AND area / CAST({side('*')} AS DOUBLE) >= 0.22 AND greatest(y1 - y0 + 1, x1 - x0 + 1) / CAST(least(y1 - y0 + 1, x1 - x0 + 1) AS DOUBLE) <= 2.8"
    valid = f"area > 0 AND area / 64.0 <= {MAX_RATIO} AND greatest(h, w) / CAST(least(h, w) AS DOUBLE) <= 2.8 AND area / CAST(h * w AS DOUBLE) >= 0.18"
    return f"""{components(t, f"NOT protected AND {gate}")},
{pool(t, valid, 0.04, "(g.n = 1 OR mask_id = g.best)", "area")},
{t}pr AS (SELECT pid, arg_min(CASE WHEN {iou('n', 'area', 'own_area')} >= 0.35 THEN 'duplicate' ELSE 'fragment' END, mask_id) AS reason FROM {t}own
  WHERE {iou('n', 'area', 'own_area')} >= 0.35 OR n / CAST(area AS DOUBLE) >= 0.70 OR {ios('n', 'area', 'own_area')} >= {IOS} GROUP BY 1),
{t}hit AS (SELECT x.u, x.w FROM {t}px x JOIN {t}po a ON a.pid = x.u JOIN {t}po b ON b.pid = x.w WHERE {iou('x.n', 'a.area', 'b.area')} >= 0.35 OR {ios('x.n', 'a.area', 'b.area')} >= {IOS}),
{t}st(image_id, n, kept, pid, reason) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM {t}po UNION ALL
  SELECT image_id, n, CASE WHEN reason IS NULL THEN list_append(kept, pid) ELSE kept END, pid, reason FROM (
    SELECT s.image_id, s.n + 1 AS n, s.kept, q.pid, CASE WHEN len(s.kept) >= 2 THEN 'budget' WHEN r.reason IS NOT NULL THEN r.reason WHEN EXISTS (SELECT 1 FROM {t}hit h WHERE h.u = q.pid AND list_contains(s.kept, h.w)) THEN 'duplicate' END AS reason
    FROM {t}st s JOIN {t}po q ON q.image_id = s.image_id AND q.n = s.n + 1 LEFT JOIN {t}pr r ON r.pid = q.pid)),
{t}out AS (SELECT q.image_id, mask_ids, score, reason AS reject_reason FROM {t}st s JOIN {t}po q USING (pid)
  UNION ALL SELECT image_id, CAST(mask_id AS VARCHAR), score, 'quality' FROM ms WHERE NOT protected AND NOT ({gate})
  UNION ALL SELECT e.image_id, CAST(mask_id AS VARCHAR), e.score, 'union' FROM {t}lb JOIN {t}va USING (label) JOIN {t}gr g USING (label) JOIN {t}el e USING (mask_id) WHERE NOT ok AND g.n > 1 AND mask_id <> best)"""
