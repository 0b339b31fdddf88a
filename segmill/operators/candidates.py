"""Candidates from windows to splits: refinement, rejection, per-window choice, merging and counters.

The network's own steps (features, refinement by a random field) come in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as mk
from ..functions import scoring as sc
from . import runs as rn
from .greedy import top_per_group
from .merge import merge_candidates, split_fanout


def drop_small(anns: DataFrame, least: float = 1.0) -> DataFrame:
    return anns.filter(F.col("area") >= least)


def area_ratio_filter(masks: DataFrame, low: float = 1e-4, high: float = 0.02) -> DataFrame:
    """Masks within the bounds; protected ones have no upper bound but the image."""
    return masks.filter(F.col("area_ratio").between(low, F.when(F.col("protected"), 1.0).otherwise(high)))


def stable(masks: DataFrame, least: float = 0.3) -> DataFrame:
    """Masks that their refinement left alike: IoU of raw and refined, kept as crf_iou, reaches ``least``."""
    return masks.withColumn("crf_iou", mk.iou(F.col("raw"), F.col("refined"))).filter(F.col("crf_iou") >= least)


def skip_errors(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose step gave a result, and how many gave none."""
    return df.filter(F.col(result).isNotNull()), df.agg(F.count_if(F.col(result).isNull()).alias("failed"))


def max_iou(masks: DataFrame, others: DataFrame) -> DataFrame:
    """masks with ``normal_iou``: the highest IoU with another mask of the image, 0 without."""
    o = others.select(F.col("image_id").alias("__i"), F.col("bits").alias("__o"))
    best = masks.join(o, F.col("image_id") == F.col("__i")).groupBy("image_id", "mask_id").agg(F.max(mk.iou(F.col("bits"), F.col("__o"))).alias("normal_iou"))
    return masks.join(best, ["image_id", "mask_id"], "left").withColumn("normal_iou", F.coalesce("normal_iou", F.lit(0.0)))


def refine(cuts: DataFrame, width: int, canvas_width: int, canvas_height: int, least_iou: float = 0.3) -> DataFrame:
    """cuts: image_id, window_id, mask_id, raw and refined (row-major, of ``width``), left, top, crop_score and perhaps right and bottom.

    Scored candidates on the image's canvas. A mask is resized (nearest) to its window, or as large as it is without right and bottom; what lies beyond the canvas
    is lost. ``counts`` are the run lengths on the canvas, ``bits`` its pixels. Masks whose refinement changed them too much, and empty ones, are left out.
    """
    right = F.col("right") if "right" in cuts.columns else F.col("left") + width
    bottom = F.col("bottom") if "bottom" in cuts.columns else F.col("top") + F.floor(F.size("refined") / width).cast("int")
    crop = F.struct(*[c.cast("int").alias(k) for k, c in zip("ltrb", (F.col("left"), F.col("top"), right, bottom))])
    good = cuts.withColumn("m", rn.placed("raw", "refined", crop, width, canvas_width, canvas_height)).filter((F.col("m.crf_iou") >= least_iou) & (F.col("m.area") > 0))
    edges = {"left": F.col("left") == 0, "top": F.col("top") == 0, "right": right == canvas_width, "bottom": bottom == canvas_height}
    h, w = mk.box_size(F.col("m.box"))
    good = good.select(
        "*", F.col("m.crf_iou").alias("crf_iou"), F.col("m.counts").alias("counts"), F.col("m.box").alias("box"), mk.border_metrics(F.col("m.edges"), F.col("m.pixels"), edges).alias("inner"),
        F.greatest(w / (right - F.col("left")), h / (bottom - F.col("top"))).alias("fill"), (F.col("m.area") / (canvas_width * canvas_height)).alias("area_ratio"),
        (F.col("m.area") / (h * w)).alias("compactness"), mk.aspect_ratio(F.col("m.box")).alias("aspect"),
    ).select("*", F.col("inner.touch").alias("touch"), F.col("inner.sides").alias("sides"))
    normal = F.col("normal_iou") if "normal_iou" in cuts.columns else F.lit(0.0)
    score = sc.candidate_score(F.col("area_ratio"), F.col("compactness"), F.col("crop_score"), F.col("aspect"), F.col("touch"), F.col("sides"), F.col("fill"), normal, F.col("crf_iou"))
    return good.select("image_id", "window_id", "mask_id", rn.to_bits("counts", canvas_width).alias("bits"), "counts", "area_ratio", "compactness", "aspect", "touch", "sides", "fill", "crf_iou", score.alias("score"))


def choose(candidates: DataFrame, per_window: int = 0, reject_shape: bool = True, fill_at: float = 0.9, touch_at: float = 0.5, sides_at: int = 2) -> DataFrame:
    """Without crop-shaped candidates, and the best ``per_window`` of each window (all for 0)."""
    if reject_shape:
        candidates = candidates.filter(~sc.crop_shape_reject(F.col("fill"), F.col("touch"), F.col("sides"), F.lit(True), fill_at, touch_at, sides_at))
    return top_per_group(candidates, ["image_id", "window_id"], [F.desc("score"), F.col("mask_id")], per_window).drop("rank")


def splits(candidates: DataFrame, protected: DataFrame, width: int, **options) -> DataFrame:
    """(split, image_id, rank, mask_ids, score, area): normal, raw_multiscale, multiscale and combined labels of each image.

    Both frames: image_id, mask_id, bits, score.
    """
    cols = ["image_id", "mask_id", "bits", "score"]
    c, p = candidates.select(*cols, F.lit(False).alias("protected")), protected.select(*cols, F.lit(True).alias("protected"))

    def plain(df: DataFrame, order: list[Column]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
        return df.select("image_id", rank.alias("rank"), F.col("mask_id").cast("string").alias("mask_ids"), "score", mk.area(F.col("bits")).cast("long").alias("area"))

    return split_fanout({
        "normal": plain(p, [F.col("mask_id")]), "raw_multiscale": plain(c, [F.desc("score"), F.col("mask_id")]),
        "multiscale": merge_candidates(c, width, **options).drop("protected"), "combined": merge_candidates(c.unionByName(p), width, **options).drop("protected"),
    })


def counters(found: DataFrame) -> DataFrame:
    """Per-image counts of each split, zeros where a split has none; totals are their sums."""
    names = ["normal", "raw_multiscale", "multiscale", "combined"]
    return found.groupBy("image_id").pivot("split", names).agg(F.count(F.lit(1))).na.fill(0, names)


def label_map(code: Column, names: dict[str, str]) -> Column:
    """A code's name, or the code with spaces for underscores."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<string,string>")
    return F.coalesce(known[code], F.replace(code, F.lit("_"), F.lit(" ")))


def get_or(m: Column, key, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def iso_timestamp(t: Column) -> Column:
    """UTC with a space, as the label files have it."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ann_area(area: Column, counts: Column) -> Column:
    """The explicit area, else that of the run lengths (every second run is set)."""
    runs = F.transform(counts, lambda n, i: F.when(i % 2 == 1, n).otherwise(0))
    return F.coalesce(area, F.aggregate(runs, F.lit(0), lambda a, n: a + n).cast("double"))
