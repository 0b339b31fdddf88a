"""The generator's plan from end to end: full-image masks, windows, cuts, retries, choice, merges, splits and per-image counters.

The network's step is a function from windows to cuts (masks of a small grid, raw and refined), so it can be a table, a model server or a join. Every
step is a table of all images; what several later steps read is written once. Retries are one more round of cuts, as the published generator has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scoring as sc
from ..operators import candidates as cd
from ..operators import windows as wn
from ..operators.greedy import top_per_group
from ..operators.merge import merge_candidates, split_fanout
from ..session import materialise, release

#: Windows as the cutting function gets them.
WINDOW = ["image_id", "window_id", "retry", "l", "t", "r", "b", "crop_score"]
COUNTERS = [
    "full_masks", "total_windows", "skipped_covered", "eligible_windows", "ranked_windows", "rescue_windows", "crop_windows", "generated_crop_candidates",
    "crop_candidates", "crop_merged_masks", "merged_masks", "scored_candidates", "border_retry_windows", "crop_shape_rejected",
]


@dataclass
class Settings:
    """Sizes of the canvas and of a cut's grid, and the options that the presets name."""

    width: int
    height: int
    grid: int
    fixed: int
    scales: list[float] = field(default_factory=lambda: [1.0, 0.75, 0.5])
    overlap: float = 0.3
    two_stage: bool = True
    most_covered: float = 0.9
    top_k: int = 0
    border_retry: bool = True
    retry_scales: tuple[float, ...] = (1.4, 1.8)
    touch_at: float = 0.5
    sides_at: int = 2
    shape_reject: bool = True
    fill_at: float = 0.9
    per_window: int = 0
    least_iou: float = 0.3
    merge: dict = field(default_factory=dict)


def _candidates(cuts: DataFrame, s: Settings) -> DataFrame:
    """Refined candidates; ``cuts`` has the windows' columns, mask_id, raw and refined."""
    named = cuts.withColumnsRenamed({"l": "left", "t": "top", "r": "right", "b": "bottom"})
    found = cd.refine(named, s.grid, s.width, s.height, s.least_iou)
    return found.select("image_id", "window_id", "mask_id", "counts", "touch", "sides", "fill", "score")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias(name))


def generate(images: DataFrame, cut: Callable[[DataFrame], DataFrame], s: Settings, heatmap: DataFrame | None = None, pixels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(splits, counters) of ``images`` (image_id): splits are split, image_id, rank, mask_ids, score, area; counters a row an image.

    ``heatmap``: windows (image_id, ord, l, t, r, b, score, reason) proposed before, in place of the grid. ``pixels`` (image_id, y, x, v) give the grid windows' edge term.
    ``cut`` gets windows (WINDOW; window_id -1 is the whole image) and returns them with mask_id, raw and refined for every mask.
    """
    spark = images.sparkSession
    whole = images.select("image_id", F.lit(-1).alias("window_id"), F.lit(0).alias("retry"), F.lit(0).alias("l"), F.lit(0).alias("t"), F.lit(s.width).alias("r"), F.lit(s.height).alias("b"), F.lit(0.0).alias("crop_score"))
    protected = materialise(_candidates(cut(whole.limit(0) if not s.two_stage else whole), s), "full-masks")
    counts = [_counted(protected, "full_masks")]
    if heatmap is not None:
        ranked = heatmap.select("image_id", F.col("ord").alias("window_id"), "l", "t", "r", "b", F.col("score").alias("crop_score"), "reason")
        ranked = materialise(ranked, "windows")
        counts += [_counted(ranked, n) for n in ("total_windows", "eligible_windows")] + [_counted(ranked.filter("reason = 'spatial_rescue'"), "rescue_windows")]
    else:
        grid = wn.grid_windows(spark, s.fixed, s.scales, s.overlap)
        every = images.select("image_id").crossJoin(F.broadcast(grid))
        box = g.project_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), s.fixed, F.lit(s.width), F.lit(s.height))
        placed = every.select("image_id", F.col("ord").alias("window_id"), ((F.col("w") == s.fixed) & (F.col("h") == s.fixed)).alias("whole"), box.alias("q")).select("image_id", "window_id", "whole", "q.*")
        counts.append(_counted(placed, "total_windows"))
        if s.two_stage:
            placed = placed.filter("NOT whole")
        covered = materialise(wn.mask_coverage(placed.drop("whole"), protected.select("image_id", "counts"), s.height), "covered")
        counts.append(_counted(covered.filter((F.col("covered") >= s.most_covered) & F.lit(s.two_stage)), "skipped_covered"))
        eligible = covered.filter((F.col("covered") < s.most_covered) | F.lit(not s.two_stage))
        counts.append(_counted(eligible, "eligible_windows"))
        scored = wn.box_terms(eligible.select("image_id", "window_id", "l", "t", "r", "b"), ["window_id"], None, pixels).drop("cover").join(eligible.select("image_id", "window_id", "covered"), ["image_id", "window_id"])
        scored = scored.withColumn("crop_score", sc.grid_crop_score(F.col("covered") if s.two_stage else F.lit(0.0), F.col("edge")))
        ranked = top_per_group(scored, ["image_id"], [F.desc("crop_score"), F.col("window_id")], s.top_k).drop("rank")
        ranked = materialise(ranked.select("image_id", "window_id", "l", "t", "r", "b", "crop_score"), "windows")
    counts += [_counted(ranked, n) for n in ("ranked_windows", "crop_windows")]
    first = ranked.select("image_id", "window_id", F.lit(0).alias("retry"), "l", "t", "r", "b", "crop_score")
    found = materialise(_candidates(cut(first), s), "candidates")
    both = found
    if s.border_retry:
        # The best candidate of each window; a window without any is tried again as well.
        best = found.groupBy("image_id", "window_id").agg(F.max_by(F.struct("touch", "sides"), F.struct("score", -F.col("mask_id"))).alias("m"))
        open_ = first.join(best, ["image_id", "window_id"], "left").filter(F.col("m").isNull() | sc.needs_border_retry(F.col("m.touch"), F.col("m.sides"), s.touch_at, s.sides_at))
        old = F.struct("l", "t", "r", "b")
        tries = open_.select("image_id", "window_id", "crop_score", old.alias("old"), F.posexplode(F.array(*[F.lit(float(k)) for k in s.retry_scales])).alias("k", "scale"))
        # The box is computed once a row: without the barrier each of its columns would repeat the long expression.
        grown = F.transform(F.array(g.expand_box(F.col("old"), F.col("scale"), F.lit(s.width), F.lit(s.height))), lambda x: F.when(x != F.col("old"), x))
        tries = tries.withColumn("box", F.explode(F.filter(grown, lambda x: x.isNotNull())))
        tries = materialise(tries.select("image_id", "window_id", (F.col("k") + 1).cast("int").alias("retry"), "box.*", "crop_score"), "retries")
        counts.append(_counted(tries, "border_retry_windows"))
        both = materialise(found.unionByName(_candidates(cut(tries), s)), "all-candidates")
    counts.append(_counted(both, "generated_crop_candidates"))
    shaped = sc.crop_shape_reject(F.col("fill"), F.col("touch"), F.col("sides"), F.lit(s.shape_reject), s.fill_at, s.touch_at, s.sides_at)
    counts.append(_counted(both.filter(shaped), "crop_shape_rejected"))
    kept = materialise(cd.choose(both, s.per_window, s.shape_reject, s.fill_at, s.touch_at, s.sides_at), "kept")
    counts += [_counted(kept, n) for n in ("crop_candidates", "scored_candidates")]
    # Run lengths up to here: pixels are drawn for one image at a time, where it is merged.
    cols = ["image_id", "mask_id", "counts", "score"]
    c, p = kept.select(*cols, F.lit(False).alias("protected")), protected.select(*cols, F.lit(True).alias("protected"))
    area = cd.ann_area(F.lit(None).cast("double"), F.col("counts")).cast("long").alias("area")
    plain = lambda df, *order: df.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).alias("rank"), F.col("mask_id").cast("string").alias("mask_ids"), "score", area)
    splits = split_fanout({
        "normal": plain(p, "mask_id"), "raw_multiscale": plain(c, F.desc("score"), "mask_id"),
        "multiscale": merge_candidates(c, s.width, **s.merge).drop("protected"), "combined": merge_candidates(c.unionByName(p), s.width, **s.merge).drop("protected"),
    })
    splits = materialise(splits, "splits")
    counts += [_counted(splits.filter(F.col("split") == k), n) for k, n in (("multiscale", "crop_merged_masks"), ("combined", "merged_masks"))]
    out = reduce(lambda a, b: a.join(b, "image_id", "left"), counts, images.select("image_id"))
    missing = [n for n in COUNTERS if n not in out.columns]
    out = out.withColumns({n: F.lit(0) for n in missing}).na.fill(0, COUNTERS).select("image_id", *COUNTERS)
    out = materialise(out, "counters")
    for t in (protected, ranked, found, both, kept):
        release(t)
    return splits, out
