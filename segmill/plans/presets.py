"""Presets and batch plans: a typed flag goes before a preset, a preset before a default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The parameters' defaults and the named presets.
DEFAULTS = {
    "tau": 0.2, "N": 3, "fixed_size": 480, "crop_mode": "heatmap", "crop_scales": "1.0,0.75,0.5", "crop_overlap": 0.3, "crop_max_per_scale": 0,
    "merge_iou_thresh": 0.5, "keep_topk": 12, "min_mask_area_ratio": 0.0001, "max_mask_area_ratio": 0.02, "small_first": False,
    "two_stage_crop": False, "two_stage_max_covered_ratio": 0.9, "crop_batch_size": 8, "crop_N": 0, "crop_keep_per_window": 0,
    "containment_thresh": 0.85, "box_expand_ratio": 0.05, "merge_max_aspect_ratio": 3.0, "crop_top_k": 0, "heatmap_crop_sizes": "0.25,0.35,0.5",
    "heatmap_top_k": 12, "heatmap_nms_iou": 0.4, "heatmap_percentile": 85.0, "heatmap_spatial_rescue": -1, "border_retry": False,
    "border_retry_scales": "1.4,1.8", "border_retry_touch_thresh": 0.5, "border_retry_sides_thresh": 2, "crop_shape_reject": False,
    "crop_fill_thresh": 0.9, "crf_iou_thresh": 0.3, "primary_output": "multiscale", "final_max_new_crop_masks": 2, "final_min_score": 1.0,
    "final_min_compactness": 0.22, "final_min_merged_compactness": 0.18, "final_max_internal_border_touch": 0.55,
    "final_max_internal_border_sides": 1, "final_duplicate_iou_thresh": 0.35, "final_duplicate_inside_thresh": 0.70,
}
_SHARED = {"min_mask_area_ratio": 0.0001, "two_stage_crop": True}
PRESETS = {
    "small": _SHARED | {"crop_mode": "heatmap", "heatmap_crop_sizes": "0.25,0.35,0.5", "heatmap_top_k": 12, "heatmap_spatial_rescue": 4, "keep_topk": 12, "max_mask_area_ratio": 0.02, "containment_thresh": 0.85, "box_expand_ratio": 0.05, "merge_max_aspect_ratio": 3.0, "primary_output": "multiscale"},
    "balanced": _SHARED | {"crop_mode": "heatmap", "heatmap_crop_sizes": "0.35,0.5,0.75", "heatmap_top_k": 16, "heatmap_spatial_rescue": 4, "keep_topk": 20, "max_mask_area_ratio": 0.05, "containment_thresh": 0.8, "box_expand_ratio": 0.1, "merge_max_aspect_ratio": 4.0, "primary_output": "multiscale"},
    "legacy": _SHARED | {"crop_mode": "grid", "heatmap_crop_sizes": "0.35,0.5,0.75", "heatmap_top_k": 12, "heatmap_spatial_rescue": 0, "keep_topk": 20, "max_mask_area_ratio": 0.25, "containment_thresh": 0.7, "box_expand_ratio": 0.15, "merge_max_aspect_ratio": 5.0, "primary_output": "combined"},
    "final": _SHARED | {"crop_mode": "heatmap", "heatmap_crop_sizes": "0.25,0.35,0.5", "heatmap_top_k": 12, "heatmap_spatial_rescue": 4, "crop_N": 1, "crop_keep_per_window": 1, "border_retry": True, "border_retry_scales": "1.4,1.8", "border_retry_touch_thresh": 0.5, "border_retry_sides_thresh": 2, "crop_shape_reject": True, "crop_fill_thresh": 0.9, "crf_iou_thresh": 0.5, "keep_topk": 2, "max_mask_area_ratio": 0.02, "containment_thresh": 0.85, "box_expand_ratio": 0.04, "merge_max_aspect_ratio": 2.8, "primary_output": "final"},
}
#: The ablation's variants over the small preset.
ABLATIONS = {"baseline": {}, "hp90": {"heatmap_percentile": 90.0}, "hp80": {"heatmap_percentile": 80.0}, "topk8": {"heatmap_top_k": 8}, "tightcrop": {"heatmap_crop_sizes": "0.2,0.3,0.4"}}
STEPS = ("download", "prepare", "baseline", "hybrid", "merge", "stats", "train", "eval")


def resolve(preset: str | None = None, **typed) -> dict:
    if bad := set(typed) - set(DEFAULTS):
        raise ValueError(f"unknown parameters: {', '.join(sorted(bad))}")
    return DEFAULTS | (PRESETS[preset] if preset else {}) | typed


def resolve_table(typed: DataFrame, preset: DataFrame, default: DataFrame) -> DataFrame:
    """(name, value) by precedence, for parameter tables (name, value)."""
    p = preset.withColumnRenamed("value", "preset")
    t = typed.withColumnRenamed("value", "typed")
    return default.join(p, "name", "left").join(t, "name", "left").select("name", F.coalesce("typed", "preset", "value").alias("value"))


def ablation_matrix(spark: SparkSession, images: DataFrame, base: str = "small") -> DataFrame:
    """Every image with every variant's parameters (a table of a fixed few rows)."""
    keys = ("heatmap_percentile", "heatmap_top_k", "heatmap_crop_sizes")
    rows = [(name, *[resolve(base, **over)[k] for k in keys]) for name, over in ABLATIONS.items()]
    return images.crossJoin(spark.createDataFrame(rows, "variant string, heatmap_percentile double, heatmap_top_k int, heatmap_crop_sizes string"))


def shard_range(folders: DataFrame, column: str, job: int, per_job: int) -> DataFrame:
    """Folders [job * per_job, (job + 1) * per_job) in their order, without a task that holds all."""
    from ..operators.merge import renumber

    parts = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = renumber(folders, [column], "place", parts).withColumn("place", (F.col("place") - 1).cast("int"))
    return placed.filter((F.col("place") >= job * per_job) & (F.col("place") < (job + 1) * per_job))


def class_head(files: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return files.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("place") <= n)


#: The class lists of the five-class and the ten-class subset.
CLASSES_5 = ("n01443537", "n02123045", "n02281406", "n02410509", "n02906734")
CLASSES_10 = ("n01443537", "n02123045", "n02281406", "n02410509", "n02906734", "n03100240", "n03444034", "n04067472", "n04254777", "n07711569")


def class_subset(files: DataFrame, by: str, classes: list[str] | tuple[str, ...] = CLASSES_5) -> DataFrame:
    """Files of the listed classes."""
    return files.filter(F.col(by).isin(*classes))


def equal_split(total: int, per_class: int, classes: int) -> None:
    if total != per_class * classes:
        raise ValueError(f"{total} isn't {classes} classes of {per_class}")


def select_steps(text: str) -> list[str]:
    """Steps named in a comma-separated list, in running order."""
    from ..sources.readers import enum_list

    wanted = set(enum_list(text, list(STEPS)))
    return [s for s in STEPS if s in wanted]


def register(spark: SparkSession, name: str, images: DataFrame, anns: DataFrame) -> None:
    """A label set as views name_images and name_annotations."""
    images.createOrReplaceTempView(f"{name}_images")
    anns.createOrReplaceTempView(f"{name}_annotations")


def file_uri(path: str) -> str:
    from pathlib import Path

    return path if "://" in path else Path(path).resolve().as_uri()
