"""Binary masks as row-major arrays of 0 and 1 with a known width, all in the JVM. Masks of real sizes are run lengths: ``operators.runs``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(m: Column) -> Column:
    return F.aggregate(m, F.lit(0), lambda s, x: s + x.cast("int"))


def area_ratio(m: Column) -> Column:
    return area(m) / F.size(m)


def _places(m: Column, width: int, key) -> Column:
    return F.filter(F.transform(m, lambda x, i: F.when(x > 0, key(i))), lambda v: v.isNotNull())


def bbox(m: Column, width: int) -> Column:
    """The inclusive box (rmin, cmin, rmax, cmax), null for an empty mask."""
    rows = _places(m, width, lambda i: F.floor(i / width).cast("int"))
    cols = _places(m, width, lambda i: i % width)
    found = F.struct(F.array_min(rows).alias("rmin"), F.array_min(cols).alias("cmin"), F.array_max(rows).alias("rmax"), F.array_max(cols).alias("cmax"))
    return F.when(area(m) > 0, found)


def box_size(b: Column) -> tuple[Column, Column]:
    return b["rmax"] - b["rmin"] + 1, b["cmax"] - b["cmin"] + 1


def bbox_xywh(b: Column) -> Column:
    h, w = box_size(b)
    return F.when(b.isNotNull(), F.array(b["cmin"], b["rmin"], w, h))


def compactness(m: Column, b: Column) -> Column:
    h, w = box_size(b)
    return F.coalesce(area(m) / (h * w), F.lit(0.0))


def aspect_ratio(b: Column) -> Column:
    h, w = box_size(b)
    return F.coalesce(F.greatest(h, w) / F.greatest(F.lit(1), F.least(h, w)), F.lit(1.0))


def centroid(m: Column, width: int) -> Column:
    xs, ys = (F.aggregate(m_i, F.lit(0).cast("long"), lambda s, x: s + x) for m_i in (_places(m, width, lambda i: i % width), _places(m, width, lambda i: F.floor(i / width))))
    return F.when(area(m) > 0, F.struct((xs / area(m)).alias("x"), (ys / area(m)).alias("y")))


def overlap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("int")), F.lit(0), lambda s, x: s + x)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return _share(both, area(a) + area(b) - both)


def ios(a: Column, b: Column) -> Column:
    return _share(overlap(a, b), F.least(area(a), area(b)))


def inside(a: Column, b: Column) -> Column:
    """The share of ``a`` inside ``b``."""
    return _share(overlap(a, b), area(a))


def iou_and_inside(a: Column, b: Column) -> Column:
    return F.struct(iou(a, b).alias("iou"), inside(a, b).alias("a_inside"), inside(b, a).alias("b_inside"))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def union_of(masks: Column) -> Column:
    """The union of an array of masks."""
    return F.aggregate(masks, F.get(masks, F.lit(0)), lambda s, m: either(s, m))


def without(m: Column, painted: Column) -> Column:
    """A mask minus what is painted already, not below 0."""
    return F.zip_with(m, painted, lambda x, y: F.greatest(x - y, F.lit(0).cast("tinyint")))


def threshold(values: Column) -> Column:
    """Binary at half of the largest value."""
    top = F.array_max(values)
    return F.transform(values, lambda v: (v > top / 2).cast("tinyint"))


def resize_nearest(m: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """Nearest pixel by centres: the source of column x is floor((x + 0.5) * width / new_width)."""
    places = F.sequence(F.lit(0), F.lit(new_width * new_height - 1))
    row = lambda i: F.floor((F.floor(i / new_width) + 0.5) * height / new_height)
    col = lambda i: F.floor((i % new_width + 0.5) * width / new_width)
    return F.transform(places, lambda i: F.get(m, (row(i) * width + col(i)).cast("int")))


def paste(m: Column, width: int, canvas_width: int, canvas_height: int, left: Column, top: Column) -> Column:
    """A mask on an empty canvas, its corner at (left, top); what falls off is lost."""
    height = F.floor(F.size(m) / width)
    places = F.sequence(F.lit(0), F.lit(canvas_width * canvas_height - 1))
    x = lambda i: i % canvas_width - left
    y = lambda i: F.floor(i / canvas_width).cast("int") - top
    return F.transform(places, lambda i: F.when((x(i) >= 0) & (x(i) < width) & (y(i) >= 0) & (y(i) < height), F.get(m, (y(i) * width + x(i)).cast("int"))).otherwise(F.lit(0).cast("tinyint")))


def border_counts(m: Column, width: int) -> Column:
    """Mask pixels on the top, bottom, left and right edge of an array that is the crop itself."""
    n = F.size(m)
    height = F.floor(n / width).cast("int")
    side = lambda pick: F.aggregate(F.filter(F.transform(m, lambda x, i: F.when(pick(i), x.cast("int"))), lambda v: v.isNotNull()), F.lit(0), lambda s, x: s + x)
    return F.struct(
        side(lambda i: i < width).alias("top"), side(lambda i: i >= (height - 1) * width).alias("bottom"),
        side(lambda i: i % width == 0).alias("left"), side(lambda i: i % width == width - 1).alias("right"),
    )


def border_metrics(counts: Column, pixels: Column, on_image_border: dict[str, Column] | None = None) -> Column:
    """(touch, sides): edge pixels over the area's root, at most 1, and edges touched.

    Edges for which ``on_image_border`` holds are left out: the crop couldn't go further there.
    """
    free = {s: ~on_image_border[s] if on_image_border else F.lit(True) for s in ("top", "bottom", "left", "right")}
    on_edge = sum((F.when(free[s], counts[s]).otherwise(0) for s in free), F.lit(0))
    sides = sum((F.when(free[s] & (counts[s] > 0), 1).otherwise(0) for s in free), F.lit(0))
    touch = F.least(F.lit(1.0), on_edge / F.greatest(F.lit(1.0), F.sqrt(pixels)))
    return F.struct(F.when(pixels > 0, touch).otherwise(0.0).alias("touch"), F.when(pixels > 0, sides).otherwise(0).alias("sides"))
