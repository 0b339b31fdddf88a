"""Descriptive statistics of label sets and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import LARGE_AREA, MEDIUM_AREA, size_bin
from ..session import materialise


def per_image(images: DataFrame, anns: DataFrame) -> DataFrame:
    """(image_id, n_masks) of every image, and of ids that only annotations name."""
    counts = anns.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    ids = images.select(F.col("id").alias("image_id")).distinct()
    return ids.join(counts, "image_id", "full_outer").select("image_id", F.coalesce("n", F.lit(0)).alias("n_masks"))


def with_spans(df: DataFrame, column: str, by: list[str], spans: int = 64) -> DataFrame:
    """df (a row per distinct value) with ``__span``: which of ``spans`` runs of about equally many rows of its group holds the value.

    The bounds are quantiles from a sketch, written to a table so that all readers see the same ones. They only deal rows out: what
    is counted over spans is exact.
    """
    some = df.groupBy(*by).agg(F.percentile_approx(column, F.array(*[F.lit(k / spans) for k in range(1, spans)]), 1_000).alias("__bounds"))
    some = materialise(some, "span-bounds")
    out = (df.join(some, by) if by else df.crossJoin(F.broadcast(some))).withColumn("__span", F.lit(0))
    # How many bounds are below the value, by halving; ``spans`` is a power of two.
    step = spans // 2
    while step:
        out = out.withColumn("__span", F.col("__span") + F.when(F.col(column) > F.element_at("__bounds", F.col("__span") + step), step).otherwise(0))
        step //= 2
    return out.drop("__bounds")


def median(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, median): the exact median of whole or rounded values through counts, so that no task holds all values.

    Distinct values are counted (which combines before the shuffle) and written once, spans of equally many values are summed, and only the spans that hold
    the middle are looked into. Nulls don't count; a group without values has no row, and the whole without values a null.
    """
    keys = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    spans = with_spans(materialise(counts, "median-counts"), "__v", keys)
    whole = Window.partitionBy(*keys, *([] if keys else [F.lit(0)]))
    upto = whole.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*keys, "__span").agg(F.sum("__n").alias("__m"))
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__m").over(upto), F.lit(0)), "__all": F.sum("__m").over(whole)})
    # The middle's places, from 0: one of an odd number, two of an even one.
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    held = sums.filter((F.col("__before") <= high) & (F.col("__before") + F.col("__m") > low)).select(*keys, "__span", "__before", "__all")
    inner = Window.partitionBy(*keys, "__span").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    near = spans.join(F.broadcast(held) if not keys else held, [*keys, "__span"]).withColumn("__at", F.col("__before") + F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    at = lambda place: F.max(F.when((F.col("__at") <= place) & (F.col("__at") + F.col("__n") > place), F.col("__v")))
    return near.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def label_stats(images: DataFrame, anns: DataFrame) -> DataFrame:
    """One row: counts, mean and median masks per image and area, and size classes."""
    area = F.coalesce(F.col("area").cast("double"), F.lit(0.0))
    n = F.count(F.lit(1))
    share = lambda c: F.when(n > 0, 100.0 * F.count_if(c) / n).otherwise(0.0)
    small, large = area < MEDIUM_AREA, area >= LARGE_AREA
    a = anns.agg(
        n.alias("total_anns"), F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_area"),
        F.count_if(small).alias("small_count"), share(small).alias("small_pct"),
        F.count_if(~small & ~large).alias("medium_count"), share(~small & ~large).alias("medium_pct"),
        F.count_if(large).alias("large_count"), share(large).alias("large_pct"),
    )
    n_masks = per_image(images, anns)
    m = n_masks.agg(F.coalesce(F.avg("n_masks"), F.lit(0.0)).alias("avg_masks"))
    i = images.agg(F.count(F.lit(1)).alias("total_images"))
    med = lambda df, c, name: median(df, c).select(F.coalesce("median", F.lit(0.0)).alias(name))
    out = i.crossJoin(a).crossJoin(m).crossJoin(med(anns.select(area.alias("area")), "area", "med_area")).crossJoin(med(n_masks, "n_masks", "med_masks"))
    return out.select("total_images", "total_anns", "mean_area", "med_area", *[f"{k}_{x}" for k in ("small", "medium", "large") for x in ("count", "pct")], "avg_masks", "med_masks")


def mask_histogram(images: DataFrame, anns: DataFrame, top: int = 5) -> DataFrame:
    """(n_masks, images): images with 0 .. top masks, the last with all above too, zeros included."""
    spine = images.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("n_masks"))
    found = per_image(images, anns).groupBy(F.least("n_masks", F.lit(top)).cast("int").alias("n_masks")).agg(F.count(F.lit(1)).alias("images"))
    return spine.join(found, "n_masks", "left").select("n_masks", F.coalesce("images", F.lit(0)).alias("images"))


def size_rollup(anns: DataFrame) -> DataFrame:
    """(size_bin, anns, mean_area) by class, and of all."""
    binned = anns.withColumn("size_bin", size_bin(F.col("area")))
    out = binned.rollup("size_bin").agg(F.count(F.lit(1)).alias("anns"), F.avg("area").alias("mean_area"))
    return out.select(F.coalesce("size_bin", F.lit("all")).alias("size_bin"), "anns", "mean_area")


def pseudo_stats(images: DataFrame, anns: DataFrame) -> DataFrame:
    i, a = images.agg(F.count(F.lit(1)).alias("images")), anns.agg(F.count(F.lit(1)).alias("annotations"))
    return i.crossJoin(a).withColumn("avg_masks_per_image", F.when(F.col("images") > 0, F.col("annotations") / F.col("images")).otherwise(0.0))


def collapse_categories(anns: DataFrame, name: str = "object") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotations of one category, that category's table, and how many there were before."""
    one = anns.withColumn("category_id", F.lit(1))
    spark = anns.sparkSession
    cats = spark.createDataFrame([(1, name, name)], "id int, name string, supercategory string")
    return one, cats, anns.agg(F.countDistinct("category_id").alias("before"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash (MD5, so that other engines can say the same) of their key, the same on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def ablation_ratios(rows: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per variant: kept share, yield per window, added masks and the change against the baseline."""
    base = rows.filter(F.col("variant") == baseline).select(F.col("merged").alias("base"))
    out = rows.crossJoin(base)
    return out.select(
        "variant", (100.0 * F.col("crop_merged") / F.greatest("generated", F.lit(1))).alias("keep_ratio"),
        (100.0 * F.col("merged") / F.greatest("windows", F.lit(1))).alias("yield"),
        (F.col("merged") - F.col("full_masks")).alias("added"), (F.col("merged") - F.col("base")).alias("delta"),
    )


def series_summary(points: DataFrame) -> DataFrame:
    """points (run, iteration, value) -> last iteration, count, last value and the axis' top."""
    from ..functions.scoring import nice_max

    good = points.filter("iteration IS NOT NULL AND value IS NOT NULL")
    out = good.groupBy("run").agg(F.max("iteration").alias("max_iteration"), F.count(F.lit(1)).alias("points"), F.max_by("value", "iteration").alias("last_value"), F.max("value").alias("top"))
    return out.select("run", "max_iteration", "points", "last_value", nice_max(F.greatest("top", F.lit(1.0)) * 1.10).alias("y_max"))


def variant_summary(pseudo: DataFrame, evals: DataFrame) -> DataFrame:
    """Both tables' variants in one, empty where one has none."""
    return pseudo.join(evals, "variant", "full_outer")
