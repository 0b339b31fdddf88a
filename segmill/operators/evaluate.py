"""Predictions against ground truth: recall by size class, budgets and kinds of noise.

Both sides are image_id, ann_id, l, t, r, b, area; predictions may have score. Joins are on the image with overlap as the cheap
first test, which any IoU above 0 needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import materialise
from .areas import covered_pixels
from .stats import median, with_spans


def pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, gt_id, pred_id, iou) of all pairs that overlap."""
    a = gt.select("image_id", F.col("ann_id").alias("gt_id"), F.struct("l", "t", "r", "b").alias("a"))
    c = pred.select(F.col("image_id").alias("other"), F.col("ann_id").alias("pred_id"), F.struct("l", "t", "r", "b").alias("c"))
    met = a.join(c, (F.col("image_id") == F.col("other")) & g.boxes_overlap(F.col("a"), F.col("c")))
    return met.select("image_id", "gt_id", "pred_id", g.box_iou(F.col("a"), F.col("c")).alias("iou"))


def best_iou(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, gt_id, size_bin, best_iou) of every true object, 0 without a prediction."""
    best = pairs(gt, pred).groupBy("image_id", "gt_id").agg(F.max("iou").alias("best"))
    out = gt.select("image_id", F.col("ann_id").alias("gt_id"), g.size_bin(F.col("area")).alias("size_bin")).join(best, ["image_id", "gt_id"], "left")
    return out.select("image_id", "gt_id", "size_bin", F.coalesce("best", F.lit(0.0)).alias("best_iou"))


def recall_by_size(best: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Recall at each threshold and mean best IoU, by size class and of all."""
    recalls = [F.avg((F.col("best_iou") >= t).cast("double")).alias(f"recall_{round(100 * t)}") for t in at]
    out = best.rollup("size_bin").agg(F.count(F.lit(1)).alias("n_gt"), *recalls, F.avg("best_iou").alias("mean_best_iou"))
    return out.withColumn("size_bin", F.coalesce("size_bin", F.lit("all")))


def recall_at_k(gt: DataFrame, pred: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20), at: float = 0.5) -> DataFrame:
    """(k, size_bin, recall) when each image keeps its k highest predictions (by score, then ord)."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "ord"))
    ranked = pred.withColumn("rank", rank)
    met = pairs(gt, ranked).join(ranked.select("image_id", F.col("ann_id").alias("pred_id"), "rank"), ["image_id", "pred_id"])
    first = met.filter(F.col("iou") >= at).groupBy("image_id", "gt_id").agg(F.min("rank").alias("first"))
    every = gt.select("image_id", F.col("ann_id").alias("gt_id"), g.size_bin(F.col("area")).alias("size_bin")).join(first, ["image_id", "gt_id"], "left")
    every = every.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))
    return every.groupBy("k", "size_bin").agg(F.count(F.lit(1)).alias("n_gt"), F.avg(hit).alias("recall"))


def duplicate_rate(gt: DataFrame, pred: DataFrame, at: float = 0.5) -> DataFrame:
    m = pairs(gt, pred).filter(F.col("iou") >= at).groupBy("image_id", "gt_id").agg(F.count(F.lit(1)).alias("n"))
    out = m.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("matched"))
    return out.withColumn("duplicate_rate", F.when(F.col("matched") > 0, F.col("duplicates") / F.col("matched")).otherwise(0.0))


def fragment_rate(gt: DataFrame, pred: DataFrame, at: float = 0.5) -> DataFrame:
    """True objects no single prediction covers, but all that overlap together do.

    The union's IoU needs areas of unions of boxes, which come from tables over the boxes' own edges.
    """
    a = gt.select("image_id", F.col("ann_id").alias("gt_id"), "l", "t", "r", "b", "area")
    c = pred.select(F.col("image_id").alias("other"), F.struct("l", "t", "r", "b").alias("c"))
    met = a.join(c, (F.col("image_id") == F.col("other")) & g.boxes_overlap(F.struct("l", "t", "r", "b"), F.col("c")))
    met = met.withColumn("iou", g.box_iou(F.struct("l", "t", "r", "b"), F.col("c")))
    hull = F.struct(F.min("c.l").alias("l"), F.min("c.t").alias("t"), F.max("c.r").alias("r"), F.max("c.b").alias("b"))
    per = met.groupBy("image_id", "gt_id", "l", "t", "r", "b").agg(F.max("iou").alias("best"), F.collect_list("c").alias("cs"), hull.alias("hull")).filter(F.col("best") < at)
    # What the predictions cover together of the object, and at all.
    per = per.withColumn("px", covered_pixels("cs", F.array(F.struct("l", "t", "r", "b"), "hull")))
    own, both, union = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")), F.col("px")[0], F.col("px")[1]
    parts = per.filter(both / (own + union - both) >= at)
    n = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    return parts.agg(F.count(F.lit(1)).alias("fragmented")).crossJoin(n).withColumn("fragment_rate", F.when(F.col("n_gt") > 0, F.col("fragmented") / F.col("n_gt")).otherwise(0.0))


def overmerge_rate(gt: DataFrame, pred: DataFrame, at: float = 0.25) -> DataFrame:
    m = pairs(gt, pred).filter(F.col("iou") >= at).groupBy("image_id", "pred_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    n = pred.agg(F.count(F.lit(1)).alias("n_pred"))
    return m.agg(F.count(F.lit(1)).alias("overmerged")).crossJoin(n).withColumn("overmerge_rate", F.when(F.col("n_pred") > 0, F.col("overmerged") / F.col("n_pred")).otherwise(0.0))


def pred_stats(pred: DataFrame, width: int, height: int) -> DataFrame:
    """Masks per image with any, mean and median area, share of small ones and of those at the image's border."""
    edge = (F.col("l") == 0) | (F.col("t") == 0) | (F.col("r") == width) | (F.col("b") == height)
    mid = median(pred, "area").select(F.col("median").alias("med_area"))
    return pred.agg(
        (F.count(F.lit(1)) / F.countDistinct("image_id")).alias("masks_per_image"), F.avg("area").alias("mean_area"),
        F.avg((F.col("area") < g.MEDIUM_AREA).cast("double")).alias("small_share"), F.avg(edge.cast("double")).alias("border_share"),
    ).crossJoin(mid)


def id_remap(anns: DataFrame, images: DataFrame, real: DataFrame) -> DataFrame:
    """Annotations with the ids that ``real`` (id, file_name) has for their images' base names."""
    base = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    mine = images.select(F.col("id").alias("image_id"), base(F.col("file_name")).alias("base"))
    theirs = real.select(F.col("id").alias("real_id"), base(F.col("file_name")).alias("base"))
    return anns.join(mine.join(theirs, "base").select("image_id", "real_id"), "image_id")


def decision(base: DataFrame, new: DataFrame, gain: float = 0.10, worse: float = 2.0) -> DataFrame:
    """Whether recall rose by ``gain`` (relative) and neither duplicates nor fragments reached ``worse`` times theirs.

    Both sides: one row of recall, duplicate_rate, fragment_rate.
    """
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in ("recall", "duplicate_rate", "fragment_rate")])
    j = new.crossJoin(b)
    better = F.col("recall") >= F.col("b_recall") * (1 + gain)
    clean = (F.col("duplicate_rate") < worse * F.greatest("b_duplicate_rate", F.lit(1e-9))) & (F.col("fragment_rate") < worse * F.greatest("b_fragment_rate", F.lit(1e-9)))
    return j.withColumn("adopt", better & clean)


def average_precision(gt: DataFrame, pred: DataFrame, at: float = 0.5) -> DataFrame:
    """AP at one IoU by the 101-point envelope.

    Predictions, best first in their image, take the free true object with the highest IoU; then precision runs over all of them by score.
    """
    best = pairs(gt, pred).filter(F.col("iou") >= at)
    ranked = pred.select("image_id", F.col("ann_id").alias("pred_id"), "score", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")).alias("rank"))
    cand = best.join(ranked, ["image_id", "pred_id"])
    per = cand.groupBy("image_id", "pred_id", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("i"), F.col("gt_id").alias("g")))).alias("options"))
    lists = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pred_id", "options"))).alias("items"))
    none = F.array().cast("array<struct<p:bigint,g:bigint>>")

    def take(used, x):
        free = F.filter(x["options"], lambda o: ~F.exists(used, lambda u: u["g"] == o["g"]))
        return F.when(F.size(free) > 0, F.array_append(used, F.struct(x["pred_id"].cast("long").alias("p"), F.get(free, F.lit(0))["g"].cast("long").alias("g")))).otherwise(used)

    hits = lists.select("image_id", F.explode(F.aggregate("items", none, take)).alias("m")).select("image_id", F.col("m.p").alias("pred_id"), F.lit(1).alias("tp"))
    marked = ranked.join(hits, ["image_id", "pred_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    # By distinct score, so that the running counts need no row order among equals.
    steps = marked.groupBy("score").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    # Running counts in two levels: over spans of equally many scores, highest first, then inside each, so that no task holds all scores.
    steps = with_spans(materialise(steps, "ap-steps"), "score", []).select("score", "tp", "n", (-F.col("__span")).alias("span"))
    sums = steps.groupBy("span").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("span", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    w = Window.partitionBy("span").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    n_gt = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    curve = steps.select("span", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n")).join(sums, "span").crossJoin(n_gt)
    curve = curve.select((F.col("tp") + F.col("tp0")).alias("tp"), (F.col("n") + F.col("n0")).alias("n"), "n_gt")
    curve = curve.select((F.col("tp") / F.col("n_gt")).alias("recall"), (F.col("tp") / F.col("n")).alias("precision"))
    best_at = curve.groupBy(F.floor(F.col("recall") * 100 + 1e-9).alias("step")).agg(F.max("precision").alias("p"))
    spine = gt.sparkSession.range(101).select(F.col("id").alias("step"))
    joined = spine.join(best_at, "step", "left")
    envelope = F.coalesce(F.max("p").over(Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    return joined.select(envelope.alias("p")).agg(F.avg("p").alias("ap"))


#: COCO's IoU thresholds, and its size classes with both ends included.
THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
CLASSES = {"all": (0, 10**10), "small": (0, 32**2), "medium": (32**2, 96**2), "large": (96**2, 10**10)}


def coco_ap(gt: DataFrame, pred: DataFrame, most: int = 100) -> DataFrame:
    """COCO's six figures: AP (mean over IoU .50 to .95), AP50, AP75, APs, APm and APl, by the 101-point envelope.

    A size class ignores true objects of other sizes: a prediction takes one only if no free object of the class
    reaches the IoU, and then counts neither way, as does one of another size that takes nothing. A class without
    true objects has a null. As COCO has it, an image's ``most`` best predictions count (all for 0).
    """
    spark = gt.sparkSession
    classes = spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in CLASSES.items()], "size string, lo long, hi long")
    variants = F.broadcast(classes.crossJoin(spark.createDataFrame([(x,) for x in THRESHOLDS], "at double")))
    key = ["size", "at"]
    outside = lambda area, lo=F.col("lo"), hi=F.col("hi"): ((area < lo) | (area > hi)).cast("int")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")).alias("rank")
    ranked = pred.select("image_id", "score", F.col("area").alias("pred_area"), F.struct("l", "t", "r", "b").alias("c"), rank)
    ranked = ranked.filter(F.col("rank") <= most) if most > 0 else ranked
    # One join and one grouping on the image; the variants meet an image's list, not its pairs.
    true = gt.select("image_id", F.col("ann_id").alias("gt_id"), F.col("area").alias("gt_area"), F.struct("l", "t", "r", "b").alias("a"))
    met = true.join(ranked, "image_id").filter(g.boxes_overlap(F.col("a"), F.col("c"))).withColumn("iou", g.box_iou(F.col("a"), F.col("c"))).filter(F.col("iou") >= min(THRESHOLDS))
    option = F.struct((-F.col("iou")).alias("i"), F.col("gt_id").cast("long").alias("g"), F.col("gt_area").alias("area"))
    per = met.groupBy("image_id", "rank", "score", "pred_area").agg(F.array_sort(F.collect_list(option)).alias("options"))
    lists = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "pred_area", "options"))).alias("items"))
    taken = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).alias("x"), *[F.lit(0).cast(pred.schema[c].dataType).alias(n) for c, n in (("score", "score"), ("area", "pred_area"))])

    def take(used, x):
        free = F.filter(x["options"], lambda o: (-o["i"] >= F.col("at")) & ~F.exists(used, lambda u: u["g"] == o["g"]))
        first = F.coalesce(F.get(F.filter(free, lambda o: outside(o["area"]) == 0), F.lit(0)), F.get(free, F.lit(0)))
        return F.when(F.size(free) > 0, F.array_append(used, F.struct(first["g"].alias("g"), outside(first["area"]).alias("x"), x["score"].alias("score"), x["pred_area"].alias("pred_area")))).otherwise(used)

    used = F.aggregate("items", F.filter(F.array(taken), lambda u: F.lit(False)), take)
    hits = lists.crossJoin(variants).select(*key, "lo", "hi", F.explode(used).alias("m"))
    # How many predictions of a score count is a number a class, but for those that took something, whose own class doesn't matter.
    counts = (F.col("m.x") == 0).cast("int")
    plain = F.coalesce(1 - outside(F.col("m.pred_area")), F.lit(0))
    hits = hits.groupBy(*key, F.col("m.score").alias("score")).agg(F.sum(counts).alias("tp"), F.sum(counts - plain).alias("more"))
    hits = materialise(hits, "ap-hits")
    names = {c: f"n_{c}" for c in CLASSES}
    steps = ranked.groupBy("score").agg(*[F.sum(F.coalesce(1 - outside(F.col("pred_area"), F.lit(lo), F.lit(hi)), F.lit(0))).alias(names[c]) for c, (lo, hi) in CLASSES.items()])
    # Running counts in two levels, as in average_precision: of all predictions by score, then of those that took something.
    steps = with_spans(materialise(steps, "ap-steps"), "score", []).withColumn("span", -F.col("__span"))
    before = lambda *by: Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.groupBy("span").agg(*[F.sum(n).alias(n) for n in names.values()])
    sums = sums.select("span", *[F.coalesce(F.sum(n).over(before(F.lit(0))), F.lit(0)).alias(f"{n}0") for n in names.values()])
    ran = steps.select("score", "span", *[F.sum(n).over(upto("span")).alias(n) for n in names.values()]).join(F.broadcast(sums), "span")
    ran = ran.select(F.col("score").alias("__score"), "span", *[(F.col(n) + F.col(f"{n}0")).alias(n) for n in names.values()])
    own = F.coalesce(*[F.when(F.col("size") == c, F.col(n)) for c, n in names.items()])
    found = hits.join(ran, F.col("score").eqNullSafe(F.col("__score"))).select(*key, "score", "span", "tp", "more", own.alias("n"))
    found = materialise(found, "ap-found")
    sums = found.groupBy(*key, "span").agg(F.sum("tp").alias("tp"), F.sum("more").alias("more"))
    sums = sums.select(*key, "span", *[F.coalesce(F.sum(c).over(before(*key)), F.lit(0)).alias(f"{c}0") for c in ("tp", "more")])
    curve = found.select(*key, "span", F.col("tp").alias("own"), "n", *[F.sum(c).over(upto(*key, "span")).alias(c) for c in ("tp", "more")]).join(F.broadcast(sums), [*key, "span"])
    n_gt = gt.select("area").crossJoin(F.broadcast(classes)).filter(outside(F.col("area")) == 0).groupBy("size").agg(F.count(F.lit(1)).alias("n_gt"))
    # Where no true object is found the precision only falls, so those scores can't be the best of their step.
    curve = curve.filter("own > 0").select(*key, (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("n") + F.col("more") + F.col("more0")).alias("n")).join(n_gt, "size")
    curve = curve.select(*key, (F.col("tp") / F.col("n_gt")).alias("recall"), (F.col("tp") / F.col("n")).alias("precision"))
    best_at = curve.groupBy(*key, F.floor(F.col("recall") * 100 + 1e-9).alias("step")).agg(F.max("precision").alias("p"))
    spine = variants.join(n_gt, "size").select(*key).crossJoin(spark.range(101).select(F.col("id").alias("step")))
    envelope = F.coalesce(F.max("p").over(Window.partitionBy(*key).orderBy("step").rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    ap = spine.join(best_at, [*key, "step"], "left").select(*key, envelope.alias("p")).groupBy(*key).agg(F.avg("p").alias("ap"))
    mean = lambda test: F.avg(F.when(F.expr(test), F.col("ap")))
    return ap.agg(
        mean("size = 'all'").alias("AP"), mean("size = 'all' AND at = 0.5D").alias("AP50"), mean("size = 'all' AND at = 0.75D").alias("AP75"),
        mean("size = 'small'").alias("APs"), mean("size = 'medium'").alias("APm"), mean("size = 'large'").alias("APl"),
    )
