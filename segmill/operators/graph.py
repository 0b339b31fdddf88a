"""Affinity graphs, normalised cuts and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import materialise, release
from . import runs as rn
from .windows import dot, l2_normalise


def affinity(patches: DataFrame, tau: float = 0.2, eps: float = 1e-5, by: str = "image_id") -> DataFrame:
    """(by, i, j, w): 1 where the cosine of two patches exceeds tau, else eps. i and j number the grid row by row."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("y", "x")) - 1
    p = patches.withColumn("i", n).select(by, "i", l2_normalise(F.transform("feat", lambda v: v.cast("double"))).alias("a"))
    q = p.select(F.col(by).alias("qb"), F.col("i").alias("j"), F.col("a").alias("c"))
    pair = p.join(q, F.col(by) == F.col("qb"))
    return pair.select(by, "i", "j", F.when(dot(F.col("a"), F.col("c")) > tau, 1.0).otherwise(eps).alias("w"))


def degrees(edges: DataFrame, by: str = "image_id") -> DataFrame:
    return edges.groupBy(by, "i").agg(F.sum("w").alias("degree"))


class Affinity:
    """The matrix that has 1 where the cosine of two unit rows exceeds tau and eps elsewhere, applied block by block.

    Of the matrix only its bits are held, an eighth of a byte each; a block of rows at a time is unpacked for a product.
    """

    def __init__(self, unit: np.ndarray, tau: float = 0.2, eps: float = 1e-5, block: int = 256):
        self.n, self.eps, self.block = len(unit), eps, block
        self.bits = [np.packbits(unit[i : i + block] @ unit.T > tau, axis=1) for i in range(0, self.n, block)]
        self.degree = self @ np.ones(self.n)

    def rows(self, k: int) -> np.ndarray:
        return np.unpackbits(self.bits[k], axis=1, count=self.n)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        linked = np.concatenate([self.rows(k) @ x for k in range(len(self.bits))])
        return (1 - self.eps) * linked + self.eps * x.sum()


def second_vector(a: Affinity, tolerance: float = 1e-11) -> np.ndarray:
    """The generalised eigenvector of (D - A) v = s D v with the second smallest s; the first largest entry is positive.

    The smallest one is known (a constant), so Lanczos steps run in the space without it, each orthogonal to all before, until the
    equation holds; at the latest after as many steps as there are rows.
    """
    n, root = a.n, 1 / np.sqrt(a.degree)
    if n < 2:
        return np.ones(n)
    known = np.sqrt(a.degree) / np.sqrt(a.degree.sum())
    # The steps so far, the known vector first.
    basis = [known]
    away = lambda x: x - np.array(basis).T @ (np.array(basis) @ x)
    x = away(away(np.random.default_rng(0).standard_normal(n)))
    diagonal, beside = [], []
    size = np.linalg.norm(x)
    for step in range(1, n):
        basis.append(x / size)
        y = root * (a @ (root * basis[-1]))
        diagonal.append(float(y @ basis[-1]))
        x = away(away(y))
        size = np.linalg.norm(x)
        # The last entry of the small problem's vector times what is left over is the equation's error.
        if step % 8 == 0 or step == n - 1 or size < 1e-13:
            small = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
            _, inner = np.linalg.eigh(small)
            if abs(inner[-1, -1]) * size < tolerance or step == n - 1 or size < 1e-13:
                break
        beside.append(float(size))
    v = root * (np.array(basis[1:]).T @ inner[:, -1])
    return v * np.sign(v[np.abs(v).argmax()] or 1.0)


def flood(mask: np.ndarray, seed: int) -> np.ndarray:
    """The 4-connected part of a mask that holds the seed; empty if the seed is outside. By union of column runs, so it costs runs, not steps."""
    height, width = mask.shape
    flat = np.concatenate([[False], mask.astype(bool).ravel(order="F"), [False]])
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    none = np.zeros(len(edges) // 2, dtype=np.int64)
    row, x, y0, y1 = rn.column_runs(none, edges[::2], edges[1::2], np.array([height]))
    part = rn.labels(row, x, y0, y1)
    sy, sx = divmod(seed, width)
    held = np.flatnonzero((x == sx) & (y0 <= sy) & (y1 > sy))
    change = np.zeros(height * width + 1, dtype=np.int64)
    if len(held):
        mine = part == part[held[0]]
        np.add.at(change, (x * height + y0)[mine], 1)
        np.add.at(change, (x * height + y1)[mine], -1)
    return (np.cumsum(change)[:-1] > 0).reshape((height, width), order="F")


def filled(masks: DataFrame, width: int, column: str = "bits") -> DataFrame:
    """masks with their holes filled: the background that can't reach the border."""
    height = F.floor(F.size(column) / width)
    return masks.withColumn(column, rn.to_bits(rn.fill_holes(rn.of_bits(column, width), height), width))


def oriented(v: np.ndarray, shape: tuple[int, int], cells: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """(foreground, seed, corners): v above its mean, turned over when three corners or not the peak lie in it.

    ``cells``: the grid's places that v has, row by row; all if not given. A place without a value is never in front.
    Entries that differ in the last bits only count as equal, and the first of them as the peak, so that no solver's noise decides.
    """
    cells = np.arange(len(v)) if cells is None else cells
    v = np.round(v / (np.abs(v).max() or 1.0), 9)
    front = v > v.mean()
    fg = np.zeros(shape, dtype=bool)
    fg.flat[cells] = front
    corners = int(fg[0, 0]) + int(fg[0, -1]) + int(fg[-1, 0]) + int(fg[-1, -1])
    if corners >= 3 or not front[np.abs(v).argmax()]:
        fg.flat[cells] = ~front
        return fg, int(cells[(-v).argmax()]), corners
    return fg, int(cells[v.argmax()]), corners


def _cells(df: pd.DataFrame, shape: tuple[int, int] | None) -> tuple[pd.DataFrame, tuple[int, int], np.ndarray]:
    """An image's rows in the grid's order, the grid's shape (that of its last row and column if not given), and the rows' places in it."""
    df = df.sort_values(["y", "x"])
    shape = shape or (int(df.y.max()) + 1, int(df.x.max()) + 1)
    return df, shape, df.y.to_numpy(dtype=int) * shape[1] + df.x.to_numpy(dtype=int)


def bipartitions(values: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """values: image_id, y, x, v. (image_id, bits, seed, corners) as :func:`oriented`, one image's grid at a time; bits of the places that have a value."""

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        df, size, cells = _cells(df, shape)
        fg, seed, corners = oriented(df.v.to_numpy(dtype=float), size, cells)
        return pd.DataFrame({"image_id": [key[0]], "bits": [fg.ravel()[cells].astype(int).tolist()], "seed": [seed], "corners": [corners]})

    return values.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(run, "image_id long, bits array<int>, seed int, corners int")


def iterative_cut(feat: np.ndarray, shape: tuple[int, int], tau: float = 0.2, rounds: int = 3, eps: float = 1e-5, cells: np.ndarray | None = None) -> list[np.ndarray]:
    """Masks of one image's patches [n, dim], a round each; a round that repeats the one before or is tiny is empty.

    ``cells``: the grid's places that have a patch, all if not given; the others are in no mask.
    """
    cells = np.arange(len(feat)) if cells is None else cells
    feat, painted = feat.astype(float).copy(), np.zeros(shape, dtype=bool)
    masks: list[np.ndarray] = []
    before: np.ndarray | None = None
    for k in range(rounds):
        if before is not None:
            painted |= before
            feat[painted.ravel()[cells]] = 0
        norm = np.maximum(np.linalg.norm(feat, axis=1, keepdims=True), 1e-12)
        unit = feat / norm
        fg, seed, _ = oriented(second_vector(Affinity(unit, tau, eps)), shape, cells)
        mask = flood(fg, seed)
        if before is not None:
            both, either = (mask & before).sum(), (mask | before).sum()
            if (either and both / either > 0.5) or mask.mean() <= 0.01:
                mask = np.zeros(shape, dtype=bool)
        before = mask
        seen = np.logical_or.reduce(masks) if masks else np.zeros(shape, dtype=bool)
        masks.append(mask & ~seen)
    return masks


def _features(df: pd.DataFrame) -> np.ndarray:
    return np.stack(df.feat.to_list()).astype(float)


def cut_masks(patches: DataFrame, tau: float = 0.2, rounds: int = 3, shape: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, round, bits, area): the iterative cut of every image, one image's patches at a time; bits of the whole grid, of ``shape`` or up to the image's last row and column."""

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        df, size, cells = _cells(df, shape)
        rows = [(key[0], k, m.ravel().astype(int).tolist(), int(m.sum())) for k, m in enumerate(iterative_cut(_features(df), size, tau, rounds, cells=cells))]
        return pd.DataFrame(rows, columns=["image_id", "round", "bits", "area"])

    return patches.select("image_id", "y", "x", "feat").groupBy("image_id").applyInPandas(run, "image_id long, round int, bits array<int>, area long")


def ncut(patches: DataFrame, tau: float = 0.2, eps: float = 1e-5) -> DataFrame:
    """(image_id, i, v, residual): the cut's vector and its equation's largest error."""

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        feat = _features(df.sort_values(["y", "x"]))
        unit = feat / np.maximum(np.linalg.norm(feat, axis=1, keepdims=True), 1e-12)
        a = Affinity(unit, tau, eps)
        v, d = second_vector(a), a.degree
        lap = d * v - a @ v
        s = (v @ lap) / (v @ (d * v))
        return pd.DataFrame({"image_id": key[0], "i": range(len(v)), "v": v, "residual": np.abs(lap - s * d * v).max()})

    return patches.select("image_id", "y", "x", "feat").groupBy("image_id").applyInPandas(run, "image_id long, i int, v double, residual double")


def fragment_edges(boxes: DataFrame, iou: float = 0.5, ios: float = 0.85, expand: float = 0.05) -> DataFrame:
    """(image_id, u, v), u < v: boxes of an image that repeat, hold or nearly touch each other."""
    box = F.struct("l", "t", "r", "b")
    wide = g.grown(g.inclusive(box), expand)
    a = boxes.select("image_id", F.col("ann_id").alias("u"), box.alias("a"), wide.alias("wide_a"))
    c = boxes.select(F.col("image_id").alias("other"), F.col("ann_id").alias("v"), box.alias("c"), wide.alias("wide_c"))
    linked = g.grown_overlap(F.col("wide_a"), F.col("wide_c")) | (g.box_iou(F.col("a"), F.col("c")) > iou) | (g.box_ios(F.col("a"), F.col("c")) > ios)
    return a.join(c, (F.col("image_id") == F.col("other")) & (F.col("u") < F.col("v")) & linked).select("image_id", "u", "v")


def components(vertices: DataFrame, edges: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, v, component): the smallest vertex reachable, by minima along edges and label jumps until nothing changes."""
    both = materialise(edges.select(by, "u", "v").unionByName(edges.select(by, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    now = materialise(vertices.select(by, "v", F.col("v").alias("component")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("v", "u").withColumnRenamed("component", "c"), [by, "u"]).groupBy(by, "v").agg(F.min("c").alias("c"))
        step = now.join(near, [by, "v"], "left").select(by, "v", F.least("component", F.coalesce("c", F.col("component"))).alias("next"), F.col("component").alias("old"))
        jump = step.select(F.col(by).alias("jb"), F.col("v").alias("next"), F.col("next").alias("far"))
        step = step.join(jump.withColumnRenamed("jb", by), [by, "next"], "left").select(by, "v", F.least("next", "far").alias("component"), "old")
        step = materialise(step, "labels")
        done = step.filter("component <> old").isEmpty()
        release(now)
        now = step.select(by, "v", "component")
        now._segmill_path = step._segmill_path
        if done:
            return now


def image_components(vertices: DataFrame, edges: DataFrame, by: str = "image_id") -> DataFrame:
    """As :func:`components`, where a group's graph is small, as an image's is: one shuffle, and a fold over its edges.

    Each edge gives the larger of its ends' labels up for the smaller one.
    """
    v = vertices.groupBy(by).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    e = edges.groupBy(by).agg(F.collect_list(F.struct("u", "v")).alias("es"))
    start = F.map_from_arrays("vs", "vs")

    def join(labels, edge):
        lo, hi = F.least(labels[edge["u"]], labels[edge["v"]]), F.greatest(labels[edge["u"]], labels[edge["v"]])
        return F.when(lo == hi, labels).otherwise(F.transform_values(labels, lambda _, c: F.when(c == hi, lo).otherwise(c)))

    found = v.join(e, by, "left").withColumn("labels", F.when(F.col("es").isNull(), start).otherwise(F.aggregate("es", start, join)))
    return found.select(by, F.explode("labels").alias("v", "component"))
