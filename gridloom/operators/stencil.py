"""Stencils: gradients, separable smoothing, two-dimensional kernels.

Differences use windows along a row or a column. Kernels are applied by explosion: each source
cell is sent to the targets that its weight reaches, and one aggregation sums them, so the boundary
rule is arithmetic on the index and no range join is planned. Partial sums are combined before the
shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.header import Header
from gridloom.operators.raster import Raster


def mapped(i: Column, n: int, mode: str) -> Column:
    """The index inside 0..n-1 that i stands for: symmetric (edge repeated), reflect, edge, constant (null)."""
    if mode == "symmetric":
        j = F.pmod(i, F.lit(2 * n))
        return F.when(j >= n, 2 * n - 1 - j).otherwise(j).cast("int")
    if mode == "reflect":
        j = F.pmod(i, F.lit(max(2 * n - 2, 1)))
        return F.when(j >= n, 2 * n - 2 - j).otherwise(j).cast("int")
    if mode == "edge":
        return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0)).cast("int")
    if mode == "constant":
        return F.when(i.between(0, n - 1), i).cast("int")
    raise ValueError(mode)


def gradient(df: DataFrame, along: str, across: list[str], step: float, edge_order: int = 2, value: str = "val", out: str = "grad") -> DataFrame:
    """Central differences along a column of consecutive integers, one-sided at the ends (first or
    second order). A missing neighbour gives a missing gradient, and so does a missing cell."""
    w = Window.partitionBy(*across).orderBy(along)
    v, at = F.col(value), lambda k: F.lag(value, -k).over(w)
    inner = (at(1) - at(-1)) / (2 * step)
    if edge_order == 2:
        first, last = (-3 * v + 4 * at(1) - at(2)) / (2 * step), (3 * v - 4 * at(-1) + at(-2)) / (2 * step)
    else:
        first, last = (at(1) - v) / step, (v - at(-1)) / step
    n, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*across))
    g = F.when(n == 1, first).when(n == size, last).otherwise(inner)
    return df.withColumn(out, F.when(v.isNotNull(), g))


def gradients(r: Raster, edge_order: int = 2) -> DataFrame:
    """(row, col, val, dval_dy, dval_dx) by the header's spacing."""
    g = gradient(r.cells, "row", ["col"], r.header.dy, edge_order, out="dval_dy")
    return gradient(g, "col", ["row"], r.header.dx, edge_order, out="dval_dx")


def windows(size: float | tuple[float, float], spacing: float | tuple[float, float]) -> tuple[int, int]:
    """(rows, columns): odd window sizes in pixels that hold the size in units of the spacing."""
    pair = lambda v: v if isinstance(v, tuple) else (v, v)
    return tuple(n + 1 - n % 2 for n in (math.ceil(abs(s / d)) for s, d in zip(pair(size), pair(spacing))))


def triangular_kernel(radius: int) -> list[float]:
    """Weights rising to the centre; those at the ends are zero."""
    w = [radius - abs(k) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w] if radius else [1.0]


def _gathered(df: DataFrame, axis: str, n: int, kernel: list[float], mode: str) -> DataFrame:
    """Sum of kernel[k] * value at index + k - radius along one axis."""
    radius = len(kernel) // 2
    keep = [c for c in ("row", "col") if c != axis]
    offsets = F.array(*(F.struct(F.lit(k - radius).alias("d"), F.lit(float(x)).alias("w")) for k, x in enumerate(kernel)))
    targets = df.sparkSession.range(n).select(F.col("id").cast("int").alias("t"), F.explode(offsets).alias("o"))
    targets = targets.select("t", mapped(F.col("t") + F.col("o.d"), n, mode).alias(axis), F.col("o.w").alias("w")).groupBy("t", axis).agg(F.sum("w").alias("w"))
    met = df.join(F.broadcast(targets), axis)  # n x kernel rows: a grid side's length times a bounded kernel
    v = F.when(F.count("*") == F.count("val"), F.sum(F.col("w") * F.col("val")))
    return met.groupBy(*keep, F.col("t").alias(axis)).agg(v.alias("val")).select("row", "col", "val")


def triangular_smooth(r: Raster, radius: int, mode: str = "symmetric") -> Raster:
    if radius == 0:
        return r
    k = triangular_kernel(radius)
    once = _gathered(r.cells, "col", r.header.nx, k, mode)
    return Raster(_gathered(once, "row", r.header.ny, k, mode), r.header)


def convolve(r: Raster, kernel: np.ndarray, mode: str = "symmetric") -> Raster:
    """Correlation with a small two-dimensional kernel of odd sides, rows of it one after another."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    h = r.header
    offsets = F.array(*(F.struct(F.lit(a - ry).alias("a"), F.lit(b - rx).alias("b"), F.lit(float(kernel[a, b])).alias("w")) for a in range(kernel.shape[0]) for b in range(kernel.shape[1]) if kernel[a, b]))
    # a source cell reaches the target at -offset; cells near an edge stand for padded ones too
    padded = pad_sources(r.cells, h, ry, rx, mode)
    hit = padded.select("val", "row", "col", F.explode(offsets).alias("o")).select((F.col("row") - F.col("o.a")).alias("row"), (F.col("col") - F.col("o.b")).alias("col"), (F.col("o.w") * F.col("val")).alias("wv"))
    inside = hit.where(F.col("row").between(0, h.ny - 1) & F.col("col").between(0, h.nx - 1))
    v = F.when(F.count("*") == F.count("wv"), F.sum("wv"))
    return Raster(inside.groupBy("row", "col").agg(v.alias("val")), h)


def pad_sources(cells: DataFrame, h: Header, ry: int, rx: int, mode: str) -> DataFrame:
    """Cells with their images outside the grid, as far as the kernel reaches."""

    def images(i: str, n: int, reach: int) -> Column:
        outside = F.array(*(F.lit(k) for k in [*range(-reach, 0), *range(n, n + reach)])) if reach else F.array().cast("array<int>")
        return F.concat(F.array(F.col(i)), F.filter(outside, lambda k: mapped(k, n, mode) == F.col(i)))

    rows = cells.withColumn("row", F.explode(images("row", h.ny, ry)))
    return rows.withColumn("col", F.explode(images("col", h.nx, rx)))


def savgol_kernels(window: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, d/drow, d/dcol) kernels of a least-squares polynomial surface."""
    if window % 2 == 0 or (window**2) < (order + 1) * (order + 2) // 2 or order >= window:
        raise ValueError("the window must be odd and wider than the order")
    k = np.arange(window) - window // 2
    y, x = np.meshgrid(k, k, indexing="ij")
    powers = [(a, b) for s in range(order + 1) for a in range(s + 1) for b in [s - a]]
    inverse = np.linalg.pinv(np.column_stack([(y.ravel() ** a) * (x.ravel() ** b) for a, b in powers]))
    pick = lambda a, b: inverse[powers.index((a, b))].reshape(window, window)
    return pick(0, 0), pick(1, 0), pick(0, 1)


def savgol_gradient(r: Raster, window: int = 5, order: int = 3) -> tuple[Raster, Raster]:
    _, ky, kx = savgol_kernels(window, order)
    dy, dx = convolve(r, ky, "reflect"), convolve(r, kx, "reflect")
    return dy.map(lambda v: v / r.header.dy), dx.map(lambda v: v / r.header.dx)


def path_length(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(…, seq, x, y, dist): distance along a polyline."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return df.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("dist", F.sum("step").over(w)).drop("step")


def nonuniform_gradient(df: DataFrame, x: str, value: str, keys: list[str], edge_order: int = 1, out: str = "grad") -> DataFrame:
    """Differences on uneven spacing; ends of first or second order."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(x)
    s, f = (lambda k: F.lag(x, -k).over(w)), (lambda k: F.lag(value, -k).over(w))
    a, b = F.col(x) - s(-1), s(1) - F.col(x)
    inner = (a * a * f(1) + (b * b - a * a) * F.col(value) - b * b * f(-1)) / (a * b * (a + b))
    if edge_order == 1:
        first, last = (f(1) - F.col(value)) / b, (F.col(value) - f(-1)) / a
    else:
        b2, a2 = s(2) - s(1), s(-1) - s(-2)
        first = -(2 * b + b2) / (b * (b + b2)) * F.col(value) + (b + b2) / (b * b2) * f(1) - b / (b2 * (b + b2)) * f(2)
        last = a / (a2 * (a + a2)) * f(-2) - (a + a2) / (a * a2) * f(-1) + (2 * a + a2) / (a * (a + a2)) * F.col(value)
    n, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return df.withColumn(out, F.when(n == 1, first).when(n == size, last).otherwise(inner))


def radius_map(grad: Raster, lo: float, hi: float, r_min: float, r_max: float) -> Raster:
    """Radius falls from r_max to r_min as the gradient magnitude goes from its lo to its hi percentile."""
    cut = grad.cells.agg(F.percentile("val", lo / 100).alias("lo"), F.percentile("val", hi / 100).alias("hi"))
    t = F.greatest(F.least((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(1.0)), F.lit(0.0))
    return Raster(grad.cells.crossJoin(F.broadcast(cut)).select("row", "col", (r_max - (r_max - r_min) * t).alias("val")), grad.header)


def adaptive_smooth(r: Raster, radius: Raster, r_max: int) -> Raster:
    """Between the layers of the two nearest whole radii, linearly."""
    layers = None
    for k in range(r_max + 1):
        layer = triangular_smooth(r, k).cells.withColumn("k", F.lit(k))
        layers = layer if layers is None else layers.unionByName(layer)
    want = radius.cells.select("row", "col", F.col("val").alias("rad"))
    both = want.join(layers, ["row", "col"]).where((F.col("k") == F.floor("rad")) | (F.col("k") == F.ceil("rad")))
    weight = F.greatest(1 - F.abs(F.col("rad") - F.col("k")), F.lit(0.0))
    return Raster(both.groupBy("row", "col").agg((F.sum(weight * F.col("val")) / F.sum(weight)).alias("val")), r.header)
