"""Scores of candidates, windows and patches as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

#: Fixed values of the score: the preferred share of the image and its width in decades.
TARGET_RATIO, SIGMA = 0.004, 0.65
#: The weights of the terms.
WEIGHTS = {"area_prior": 1.4, "compactness": 1.1, "crop_prior": 0.7, "alignment": 0.8, "crf": 0.5, "aspect": 1.0, "border": 1.2, "shape": 1.0, "normal": 0.6}
LEGACY_BORDER = 0.9


def area_prior(ratio: Column) -> Column:
    z = (F.log10(ratio) - F.log10(F.lit(TARGET_RATIO))) / SIGMA
    return F.when(ratio > 0, F.exp(-0.5 * z * z)).otherwise(0.0)


def shape_penalty(fill: Column, internal_sides: Column) -> Column:
    return F.when((internal_sides >= 2) & (fill > 0.75), clamp((fill - 0.75) / 0.25, 0.0, 1.0)).otherwise(0.0)


def candidate_score(ratio, compactness, crop_score, aspect, internal_touch, internal_sides, fill, normal_iou, crf_iou, alignment=None) -> Column:
    w = WEIGHTS
    gains = [
        w["area_prior"] * area_prior(ratio), w["compactness"] * compactness, w["crop_prior"] * clamp(crop_score / 4.0, 0.0, 1.0),
        w["alignment"] * (alignment if alignment is not None else F.lit(0.0)), w["crf"] * clamp(crf_iou, 0.0, 1.0),
    ]
    losses = [
        w["aspect"] * clamp((aspect - 3.0) / 4.0, 0.0, 1.0), w["border"] * F.greatest(internal_touch, internal_sides / 4.0),
        w["shape"] * shape_penalty(fill, internal_sides), w["normal"] * normal_iou,
    ]
    return reduce(lambda a, b: a - b, losses, reduce(lambda a, b: a + b, gains))


def candidate_score_legacy(ratio, compactness, crop_score, aspect, touch, sides, normal_iou, crf_iou) -> Column:
    w = WEIGHTS
    gain = w["area_prior"] * area_prior(ratio) + w["compactness"] * compactness + w["crop_prior"] * clamp(crop_score / 4.0, 0.0, 1.0) + w["crf"] * clamp(crf_iou, 0.0, 1.0)
    return gain - w["aspect"] * clamp((aspect - 3.0) / 4.0, 0.0, 1.0) - LEGACY_BORDER * F.greatest(touch, sides / 4.0) - w["normal"] * normal_iou


def merged_score(best: Column, members: Column, step: float = 0.03) -> Column:
    return best - step * (members - 1)


def proposal_alignment(iou: Column, recall: Column, precision: Column, distance: Column, diagonal: Column) -> Column:
    centre = 1.0 - F.least(F.lit(1.0), distance / (0.25 * F.greatest(F.lit(1.0), diagonal)))
    return 0.45 * recall + 0.25 * precision + 0.20 * centre + 0.10 * iou


def heatmap_box_score(mean: Column, peak: Column, coverage: Column, edge: Column, touches: Column) -> Column:
    return 1.5 * mean + peak + 2.0 * mean * (1.0 - coverage) + 0.5 * edge / 128.0 - 0.1 * touches


def grid_crop_score(coverage: Column, edge: Column) -> Column:
    return (1.0 - coverage) * (1.0 + edge / 128.0)


def rescue_score(box_score: Column, peak: Column, coverage: Column, edge: Column, edge_cell: Column, bonus: Column) -> Column:
    return box_score + 0.5 * peak + 0.4 * (1.0 - coverage) + 0.3 * edge / 128.0 + F.when(edge_cell, 0.15).otherwise(0.0) + bonus


def crop_shape_reject(fill: Column, touch: Column, sides: Column, has_box: Column, fill_at: float = 0.9, touch_at: float = 0.5, sides_at: int = 2) -> Column:
    found = (F.coalesce(fill, F.lit(0.0)) >= fill_at) & ((F.coalesce(touch, F.lit(0.0)) >= touch_at) | (F.coalesce(sides, F.lit(0)) >= sides_at))
    return F.coalesce(has_box, F.lit(False)) & found


def needs_border_retry(touch: Column, sides: Column, touch_at: float = 0.5, sides_at: int = 2) -> Column:
    return (F.coalesce(touch, F.lit(0.0)) >= touch_at) | (F.coalesce(sides, F.lit(0)) >= sides_at)


def quality_gate(
    area_ratio: Column, score: Column, compactness: Column, aspect: Column, touch: Column, sides: Column, fill: Column, crf_iou: Column, min_ratio: float = 1e-4, max_ratio: float = 0.02,
    min_score: float = 1.0, min_compact: float = 0.22, max_aspect: float = 2.8, max_touch: float = 0.55, max_sides: int = 1, max_fill: float = 0.9, min_crf: float = 0.5,
) -> Column:
    """Whether a candidate may be added to labels that are there already; all bounds are included."""
    shape = area_ratio.between(min_ratio, max_ratio) & (compactness >= min_compact) & (aspect <= max_aspect)
    return shape & (score >= min_score) & (touch <= max_touch) & (sides <= max_sides) & (fill <= max_fill) & (crf_iou >= min_crf)


def union_valid(pixels: Column, ratio: Column, aspect: Column, compactness: Column, max_ratio: float = 0.02, max_aspect: float = 2.8, min_compactness: float = 0.18) -> Column:
    return (pixels > 0) & (ratio <= max_ratio) & (aspect <= max_aspect) & (compactness >= min_compactness)


def nice_max(v: Column, whole: bool = False) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that isn't below ``v``; 1 for v <= 0."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    lead = v / base
    out = F.when(lead <= 1, base).when(lead <= 2, 2 * base).when(lead <= 5, 5 * base).otherwise(10 * base)
    out = F.when(v > 0, out).otherwise(1.0)
    return out.cast("long") if whole else out
