"""Merging label sets: ordered duplicate removal, and fragment merging of dense masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks as mk
from ..functions import scoring as sc
from .greedy import fold, ordered_lists

FIELDS = ["ann_id", "ord", "l", "t", "r", "b", "area"]


def duplicate(a: Column, b: Column, iou: float = 0.5, inside: float = 0.7) -> Column:
    """``a`` repeats ``b``: IoU, or either one's share inside the other, reaches its threshold."""
    return (g.box_iou(a, b) >= iou) | (g.box_inside(a, b) >= inside) | (g.box_inside(b, a) >= inside)


def combine_labels(baseline: DataFrame, crops: DataFrame, iou: float = 0.5, inside: float = 0.7, by_area: bool = False) -> DataFrame:
    """The whole baseline, then each crop annotation, in order, that repeats neither it nor an earlier kept one.

    Both have image_id and FIELDS. First an anti join against the baseline on the image with overlap as its cheap test, then a
    fold over what is left in the image. Adds ``split`` and ``new_id`` within the image, baseline first.
    """
    base = baseline.select("image_id", F.struct("l", "t", "r", "b").alias("kept"))
    me = F.struct("l", "t", "r", "b")
    hit = g.boxes_overlap(me, F.col("kept")) & duplicate(me, F.col("kept"), iou, inside)
    rest = crops.join(base.withColumnRenamed("image_id", "base_image"), (F.col("image_id") == F.col("base_image")) & hit, "left_anti")
    order = ([F.desc("area")] if by_area else []) + [F.col("ord")]
    lists = ordered_lists(rest, ["image_id"], order, FIELDS)
    kept = lists.select("image_id", F.explode(fold(F.col("items"), lambda a, b: duplicate(b, a, iou, inside))).alias("k"))
    added = kept.select("image_id", *[F.col(f"k.{f}").alias(f) for f in FIELDS], F.lit("crop").alias("split"))
    both = baseline.select("image_id", *FIELDS, F.lit("baseline").alias("split")).unionByName(added)
    new = F.row_number().over(Window.partitionBy("image_id").orderBy("split", "ord"))
    return both.withColumn("new_id", new)


def renumber(anns: DataFrame, order: list[str | Column], out: str = "new_id", parts: int = 1024) -> DataFrame:
    """Dense ids 1..n in a global order, without a global window: ranges are counted, then numbered inside."""
    from ..session import materialise

    ranged = anns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "renumber")
    sizes = ranged.groupBy("__part").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(before, "__part").withColumn(out, inner + F.col("__before")).drop("__part", "__before")


# Dense masks. One image's candidates at a time, as matrices.


def _shape_facts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """area, inclusive boxes, compactness and aspect ratio of masks [n, h, w]."""
    area = m.sum(axis=(1, 2)).astype(float)
    rows, cols = m.any(axis=2), m.any(axis=1)
    first = lambda a: a.argmax(axis=1)
    last = lambda a: a.shape[1] - 1 - a[:, ::-1].argmax(axis=1)
    boxes = np.stack([first(rows), first(cols), last(rows), last(cols)], axis=1)
    h, w = boxes[:, 2] - boxes[:, 0] + 1, boxes[:, 3] - boxes[:, 1] + 1
    some = area > 0
    return area, boxes, np.where(some, area / (h * w), 0.0), np.where(some, np.maximum(h, w) / np.minimum(h, w), 1.0)


def _ratios(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IoU, intersection over smaller, and a's share inside b, of all pairs."""
    x, y = a.reshape(len(a), -1).astype(float), b.reshape(len(b), -1).astype(float)
    both = x @ y.T
    na, nb = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    part = lambda whole: np.divide(both, whole, out=np.zeros_like(both), where=whole > 0)
    return part(na + nb - both), part(np.minimum(na, nb)), part(np.broadcast_to(na, both.shape))


def fragment_labels(m: np.ndarray, iou: float, ios: float, expand: float) -> np.ndarray:
    """Component of each mask in the graph of near-duplicates, containment and near boxes; smallest index of each."""
    area, boxes, _, _ = _shape_facts(m)
    over, smaller, _ = _ratios(m, m)
    extent = np.stack([boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]], axis=1) * expand
    lo, hi = boxes[:, :2] - extent, boxes[:, 2:] + extent
    near = ((lo[:, None] < hi[None]) & (lo[None] < hi[:, None])).all(axis=2) & (area > 0)[:, None] & (area > 0)[None]
    linked = (over > iou) | (smaller > ios) | near
    linked = linked | linked.T | np.eye(len(m), dtype=bool)
    label = np.arange(len(m))
    while True:
        new = np.where(linked, label[None, :], len(m)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def merge_candidates_image(m, score, protected, *, iou=0.5, top_k=12, min_ratio=1e-4, max_ratio=0.02, small_first=False, ios=0.85, expand=0.05, max_aspect=3.0):
    """Of masks [n, h, w] with scores: [(mask, score, members)] kept after merging fragments; protected ones come first, as given."""
    size = m[0].size if len(m) else 1
    share = m.sum(axis=(1, 2)) / size if len(m) else np.zeros(0)
    index = np.flatnonzero((share >= min_ratio) & (share <= max_ratio))
    own = [p for p in protected if min_ratio <= p.mean() <= 1.0]
    pool = []
    if len(index):
        label = fragment_labels(m[index], iou, ios, expand)
        for k in np.unique(label):
            members = index[label == k]
            if len(members) > 1:
                union = m[members].any(axis=0)
                _, _, _, aspect = _shape_facts(union[None])
                if union.mean() <= max_ratio and aspect[0] <= max_aspect:
                    pool.append((union, score[members].max() - 0.03 * (len(members) - 1), members))
                    continue
            pool += [(m[i], score[i], np.array([i])) for i in members]
    sign = 1 if small_first else -1
    pool.sort(key=lambda c: (-c[1], sign * c[0].mean()))
    kept = []
    for c in pool:
        if own and (_ratios(c[0][None], np.array(own))[0] > iou).any():
            continue
        if kept:
            over, smaller, _ = _ratios(c[0][None], np.array([k[0] for k in kept]))
            if ((over > iou) | (smaller > ios)).any():
                continue
        kept.append(c)
        if 0 < top_k <= len(kept):
            break
    return own, kept


def conservative_merge_image(m, meta, protected, *, iou=0.5, min_ratio=1e-4, max_ratio=0.02, ios=0.85, expand=0.04, max_aspect=2.8, most=2, min_score=1.0, min_compact=0.22, min_merged=0.18, max_touch=0.55, max_sides=1, max_fill=0.9, min_crf=0.5, dup_iou=0.35, dup_inside=0.70, passed=None):
    """[(member indexes, score, reason)] of every candidate or merged one; reason is null for those added. ``passed`` is the gate's answer, if it is known.

    Reasons: quality, union (members but the best of an invalid union), duplicate, fragment, budget.
    """
    out: list[tuple[list[int], float, str | None]] = []
    if not len(m):
        return out
    score = meta["score"].to_numpy(dtype=float)
    area, _, compact, aspect = _shape_facts(m)
    get = lambda k, d: meta[k].fillna(d).to_numpy() if k in meta else np.full(len(m), d)
    ratio = area / m[0].size
    good = (ratio >= min_ratio) & (ratio <= max_ratio) & (score >= min_score) & (compact >= min_compact) & (aspect <= max_aspect)
    good &= (get("touch", 0.0) <= max_touch) & (get("sides", 0) <= max_sides) & (get("fill", 0.0) <= max_fill) & (get("crf_iou", 1.0) >= min_crf)
    good = good if passed is None else passed
    out += [([int(i)], float(score[i]), "quality") for i in np.flatnonzero(~good)]
    index = np.flatnonzero(good)
    pool = []
    if len(index):
        label = fragment_labels(m[index], iou, ios, expand)
        for k in np.unique(label):
            members = index[label == k]
            best = members[score[members].argmax()]
            if len(members) == 1:
                pool.append((m[best], score[best], [int(best)]))
                continue
            union = m[members].any(axis=0)
            pixels, _, c, a = _shape_facts(union[None])
            if pixels[0] > 0 and union.mean() <= max_ratio and a[0] <= max_aspect and c[0] >= min_merged:
                pool.append((union, score[members].max() - 0.04 * (len(members) - 1), members.tolist()))
            else:
                pool.append((m[best], score[best], [int(best)]))
                out += [([int(i)], float(score[i]), "union") for i in members if i != best]
    pool.sort(key=lambda c: (-c[1], c[0].mean()))
    added: list[np.ndarray] = []
    for mask, value, members in pool:
        reason = None
        if 0 < most <= len(added):
            reason = "budget"
        elif len(protected):
            over, smaller, within = (r[0] for r in _ratios(mask[None], protected))
            hit = np.flatnonzero((over >= dup_iou) | (within >= dup_inside) | (smaller >= ios))
            if len(hit):
                reason = "duplicate" if over[hit[0]] >= dup_iou else "fragment"
        if reason is None and added:
            over, smaller, _ = _ratios(mask[None], np.array(added))
            if ((over >= dup_iou) | (smaller >= ios)).any():
                reason = "duplicate"
        if reason is None:
            added.append(mask)
        out.append((members, float(value), reason))
    return out


def _stack(bits, width: int) -> np.ndarray:
    return np.stack([np.asarray(b, dtype=bool).reshape(-1, width) for b in bits]) if len(bits) else np.zeros((0, 1, width), dtype=bool)


def _drawn(counts, width: int) -> np.ndarray:
    """As :func:`_stack`, of run lengths."""
    return np.stack([np.repeat(np.arange(len(c)) % 2 == 1, c).reshape(width, -1).T for c in counts]) if len(counts) else np.zeros((0, 1, width), dtype=bool)


def merge_candidates(masks: DataFrame, width: int, **options) -> DataFrame:
    """masks: image_id, mask_id, bits (row-major) or counts (run lengths), score, protected. (image_id, rank, mask_ids, score, area, protected) of the kept."""
    pixels = (lambda df: _drawn(df.counts.to_list(), width)) if "counts" in masks.columns else (lambda df: _stack(df.bits.to_list(), width))

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("mask_id")
        own, rest = df[df.protected], df[~df.protected]
        p = pixels(own)
        _, kept = merge_candidates_image(pixels(rest), rest.score.to_numpy(), list(p), **options)
        ids = rest.mask_id.to_numpy()
        rows = []
        low = options.get("min_ratio", 1e-4)
        for (mask_id, score), mask in zip(own[["mask_id", "score"]].to_numpy().tolist(), p):
            if mask.mean() >= low:
                rows.append((key[0], len(rows) + 1, str(int(mask_id)), float(score), int(mask.sum()), True))
        for mask, score, members in kept:
            rows.append((key[0], len(rows) + 1, ",".join(str(ids[i]) for i in sorted(members)), float(score), int(mask.sum()), False))
        return pd.DataFrame(rows, columns=["image_id", "rank", "mask_ids", "score", "area", "protected"])

    return masks.groupBy("image_id").applyInPandas(run, "image_id long, rank int, mask_ids string, score double, area long, protected boolean")


def conservative_merge(masks: DataFrame, width: int, **options) -> DataFrame:
    """masks: image_id, mask_id, bits, score, protected and, where known, touch, sides, fill, crf_iou. A row per candidate with its reason."""

    known = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in masks.columns else F.lit(d)
    bounds = {k: v for k, v in options.items() if k in ("min_ratio", "max_ratio", "min_score", "min_compact", "max_aspect", "max_touch", "max_sides", "max_fill", "min_crf")}
    box = mk.bbox(F.col("bits"), width)
    gate = sc.quality_gate(mk.area_ratio(F.col("bits")), F.col("score"), mk.compactness(F.col("bits"), box), mk.aspect_ratio(box), known("touch", 0.0), known("sides", 0), known("fill", 0.0), known("crf_iou", 1.0), **bounds)
    gated = masks.select("image_id", "mask_id", "bits", "score", "protected", gate.alias("passed"))

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("mask_id")
        own, rest = df[df.protected], df[~df.protected].reset_index(drop=True)
        found = conservative_merge_image(_stack(rest.bits.to_list(), width), rest, _stack(own.bits.to_list(), width), passed=rest.passed.to_numpy(dtype=bool), **options)
        ids = rest.mask_id.to_numpy()
        rows = [(key[0], ",".join(str(ids[i]) for i in sorted(members)), score, reason) for members, score, reason in found]
        return pd.DataFrame(rows, columns=["image_id", "mask_ids", "score", "reject_reason"])

    return gated.groupBy("image_id").applyInPandas(run, "image_id long, mask_ids string, score double, reject_reason string")


def split_fanout(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame with a ``split`` column from several named ones."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
