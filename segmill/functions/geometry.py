"""Boxes as Column expressions.

Exclusive boxes (l, t, r, b) end before r and b; inclusive boxes (rmin, cmin, rmax, cmax) hold
their last row and column. The two are never mixed. Rounding is half to even.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def box_area(a: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, a["r"] - a["l"]) * F.greatest(zero, a["b"] - a["t"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.greatest(zero, w) * F.greatest(zero, h)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    return _ratio(both, box_area(a) + box_area(b) - both)


def box_ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    return _ratio(intersection(a, b), F.least(box_area(a), box_area(b)))


def box_inside(a: Column, b: Column) -> Column:
    """The share of ``a`` inside ``b``."""
    return _ratio(intersection(a, b), box_area(a))


def boxes_overlap(a: Column, b: Column) -> Column:
    """The prefilter of IoU and containment joins: anything above 0 needs it."""
    return (a["l"] < b["r"]) & (b["l"] < a["r"]) & (a["t"] < b["b"]) & (b["t"] < a["b"])


def inclusive(a: Column) -> Column:
    """The inclusive box of a filled exclusive one."""
    return F.struct(a["t"].alias("rmin"), a["l"].alias("cmin"), (a["b"] - 1).alias("rmax"), (a["r"] - 1).alias("cmax"))


def grown(x: Column, ratio: float = 0.15) -> Column:
    """An inclusive box grown by ``ratio`` of its own extent (last minus first) on every side.

    All is multiplied by the ratio's denominator, so whole numbers stay whole (doubles hold them exactly), and boxes that just touch don't overlap by a last bit.
    """
    share = Fraction(str(ratio))
    part, whole = F.lit(float(share.numerator)), F.lit(float(share.denominator))
    h, w = (x["rmax"] - x["rmin"]) * part, (x["cmax"] - x["cmin"]) * part
    return F.struct((x["rmin"] * whole - h).alias("rmin"), (x["cmin"] * whole - w).alias("cmin"), (x["rmax"] * whole + h).alias("rmax"), (x["cmax"] * whole + w).alias("cmax"))


def grown_overlap(a: Column, b: Column) -> Column:
    """Boxes of :func:`grown` overlap strictly. For joins, whose sides grow their boxes once, not once a pair."""
    return (a["rmin"] < b["rmax"]) & (b["rmin"] < a["rmax"]) & (a["cmin"] < b["cmax"]) & (b["cmin"] < a["cmax"])


def overlap_expanded(a: Column, b: Column, ratio: float = 0.15) -> Column:
    """Inclusive boxes, each grown by ``ratio`` of its own extent (last minus first), overlap strictly."""
    return grown_overlap(grown(a, ratio), grown(b, ratio))


def clip_square(cx: Column, cy: Column, size: Column, width: Column, height: Column) -> Column:
    """A square about a centre, pushed into the image and then cut to it."""
    side = F.greatest(F.lit(2), F.least(half_even(size), F.greatest(width, height)))

    def span(centre: Column, limit: Column) -> tuple[Column, Column]:
        # Pushed off the low edge first, then off the high one; what is still outside is cut.
        start = F.greatest(half_even(centre - side / 2.0), F.lit(0))
        lo = F.greatest(F.least(start, limit - side), F.lit(0))
        return lo, F.greatest(lo + 1, F.least(lo + side, limit))

    left, right = span(cx, width)
    top, bottom = span(cy, height)
    return box(left, top, right, bottom)


def expand_box(a: Column, scale: Column | float, width: Column, height: Column) -> Column:
    """A box's longer side times ``scale`` as a square about its centre."""
    side = F.greatest(a["r"] - a["l"], a["b"] - a["t"]) * (scale if isinstance(scale, Column) else F.lit(float(scale)))
    return clip_square((a["l"] + a["r"]) / 2.0, (a["t"] + a["b"]) / 2.0, side, width, height)


def project_window(x: Column, y: Column, w: Column, h: Column, fixed: int, width: Column, height: Column) -> Column:
    """A window of the fixed square canvas in the pixels of the original."""
    at = lambda v, size: half_even(v / F.lit(float(fixed)) * size)
    left, top = clamp(at(x, width), 0, width - 1), clamp(at(y, height), 0, height - 1)
    right = F.greatest(left + 1, F.least(at(x + w, width), width))
    return box(left, top, right, F.greatest(top + 1, F.least(at(y + h, height), height)))


def crop_sizes_px(sizes: list[float], width: Column, height: Column) -> Column:
    """Crop sizes in pixels, ascending: values up to 1 are shares of the shorter side."""
    short, long = F.least(width, height), F.greatest(width, height)
    px = [F.greatest(F.lit(2), F.least(half_even(F.lit(float(v)) * short if v <= 1 else F.lit(float(v))), long)) for v in sizes]
    return F.array_sort(F.array_distinct(F.array(*px)))


def pick_crop_size(sizes: Column, extent: Column, factor: float = 2.4) -> Column:
    """The first size that is ``factor`` times the extent, else the last."""
    fits = F.filter(sizes, lambda s: s >= extent * factor)
    return F.coalesce(F.get(fits, F.lit(0)), F.element_at(sizes, -1))


def component_box(y0: Column, x0: Column, y1: Column, x1: Column, grid_h: Column, grid_w: Column, width: Column, height: Column) -> Column:
    """Patch rows and columns [y0, y1) x [x0, x1) as an image box, rounded outwards."""

    def span(lo: Column, hi: Column, n: Column, size: Column) -> tuple[Column, Column]:
        first = clamp(F.floor(lo / n * size).cast("int"), 0, size - 1)
        return first, F.greatest(first + 1, F.least(F.ceil(hi / n * size).cast("int"), size))

    left, right = span(x0, x1, grid_w, width)
    top, bottom = span(y0, y1, grid_h, height)
    return box(left, top, right, bottom)


def patch_bounds(a: Column, width: Column, height: Column, grid_w: Column, grid_h: Column) -> Column:
    """The heat-map cells [x1, x2) x [y1, y2) that an image box touches."""

    def span(lo: Column, hi: Column, size: Column, n: Column) -> tuple[Column, Column]:
        first = clamp(F.floor(lo / size * n).cast("int"), 0, n - 1)
        return first, F.greatest(first + 1, F.least(n, F.ceil(hi / size * n).cast("int")))

    x1, x2 = span(a["l"], a["r"], width, grid_w)
    y1, y2 = span(a["t"], a["b"], height, grid_h)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def cell_to_xy(x: Column, y: Column, grid_w: Column, grid_h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return (x + 0.5) / grid_w * width, (y + 0.5) / grid_h * height


#: Fixed values of the COCO size classes: areas from which an object is medium and large.
MEDIUM_AREA, LARGE_AREA = 1024, 9216


def size_bin(area: Column) -> Column:
    return F.when(area < MEDIUM_AREA, "small").when(area < LARGE_AREA, "medium").otherwise("large")
