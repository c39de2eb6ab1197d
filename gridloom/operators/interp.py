"""Interpolation on grids: B-spline weights of order 0 to 3 without prefilter, by equi-joins.

Source cells are packed in tiles with a margin, and a target is joined with its tile by key. Without
prefilter the quadratic and cubic cases smooth, as the reference's do. Outside: ``constant`` gives
``fill`` where the target lies outside the grid, ``nearest`` clamps the indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.crs import transform
from gridloom.header import Header
from gridloom.operators.raster import Raster, meshgrid
from gridloom.operators.stencil import mapped


def _weights(t: Column, order: int) -> list[tuple[Column, Column]]:
    """(index, weight) pairs for the fractional index t."""
    if order == 0:
        return [(F.floor(t + 0.5).cast("int"), F.lit(1.0))]
    if order == 1:
        i = F.floor(t).cast("int")
        f = t - i
        return [(i, 1 - f), (i + 1, f)]
    if order == 2:
        i = F.floor(t + 0.5).cast("int")
        f = t - i
        return [(i - 1, 0.5 * (0.5 - f) * (0.5 - f)), (i, 0.75 - f * f), (i + 1, 0.5 * (0.5 + f) * (0.5 + f))]
    if order == 3:
        i = F.floor(t).cast("int")
        f = t - i
        return [(i - 1, (1 - f) * (1 - f) * (1 - f) / 6), (i, (4 - 6 * f * f + 3 * f * f * f) / 6), (i + 1, (1 + 3 * f + 3 * f * f - 3 * f * f * f) / 6), (i + 2, f * f * f / 6)]
    raise ValueError(f"order {order}")


TILE, REACH = 16, 2  # side of a tile; cells that the weights reach beyond the tile of a target's base cell


def _tiles(cells: DataFrame) -> DataFrame:
    """(tile_y, tile_x, tile): the values of each tile and its margin as array[array], null where missing."""
    side = range(TILE + 2 * REACH)

    def over(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - REACH) / TILE), F.floor((F.col(c) + REACH) / TILE)))

    at = F.col("col") - F.col("tile_x") * TILE + REACH
    strips = cells.select("row", "col", "val", over("col").alias("tile_x")).groupBy("row", "tile_x").agg(*(F.max(F.when(at == j, F.col("val"))).alias(f"v{j}") for j in side))
    strips = strips.select("row", "tile_x", F.array(*(f"v{j}" for j in side)).alias("strip")).withColumn("tile_y", over("row"))
    tiles = strips.groupBy("tile_y", "tile_x").agg(F.collect_list(F.struct((F.col("row") - F.col("tile_y") * TILE + REACH).alias("i"), "strip")).alias("s"))
    ith = lambda i: F.get(F.filter("s", lambda e: e["i"] == i), F.lit(0))["strip"]
    return tiles.select("tile_y", "tile_x", F.array(*map(ith, side)).alias("tile"))


def interpolate(r: Raster, targets: DataFrame, keys: list[str], order: int = 3, mode: str = "constant", fill: float = 0.0) -> DataFrame:
    """targets: keys, x, y. Adds val. A source cell that is missing and has weight makes val missing.
    A target meets the tile of its base cell, whose margin holds all cells under its weights: one row a target is shuffled."""
    h = r.header
    at = targets.select(*keys, "x", "y").withColumn("cf", (F.col("x") - h.xstart) / h.dx).withColumn("rf", (F.col("y") - h.ystart) / h.dy)
    rule = "edge" if mode == "nearest" else "symmetric"

    def reached(t: str, n: int, tile: str) -> Column:
        first = F.col(tile) * TILE - REACH
        return F.array(*(F.struct((mapped(i, n, rule) - first).cast("int").alias("i"), w.alias("w")) for i, w in _weights(F.col(t), order)))

    # mapped indices of neighbours differ by one at most, so the base cell's tile and its margin hold all
    base = {c: F.floor(mapped(F.floor(F.col(t) + (0.5 if order % 2 == 0 else 0.0)).cast("int"), n, rule) / TILE) for c, t, n in (("tile_y", "rf", h.ny), ("tile_x", "cf", h.nx))}
    met = at.withColumns(base).join(_tiles(r.cells.select("row", "col", "val")), ["tile_y", "tile_x"], "left")
    met = met.withColumns({"rows": reached("rf", h.ny, "tile_y"), "cols": reached("cf", h.nx, "tile_x")})

    def used(a: Column, b: Column) -> Column:
        w = a["w"] * b["w"]
        return F.when(w != 0, w * F.get(F.get("tile", a["i"]), b["i"])).otherwise(0.0)

    total = F.aggregate("rows", F.lit(0.0), lambda s, a: s + F.aggregate("cols", F.lit(0.0), lambda t, b: t + used(a, b)))
    inside = F.col("rf").between(0, h.ny - 1) & F.col("cf").between(0, h.nx - 1) if mode == "constant" else F.lit(True)
    return met.select(*keys, "x", "y", F.when(inside, total).otherwise(F.lit(fill)).alias("val"))


def resample(r: Raster, header: Header, order: int = 3, mode: str = "constant", fill: float = 0.0) -> Raster:
    """Onto another grid; nothing to do for an equal one."""
    if r.header == header:
        return r
    found = interpolate(r, meshgrid(r.cells.sparkSession, header), ["row", "col"], order, mode, fill)
    return Raster(found.select("row", "col", "val"), header)


def warp(r: Raster, header: Header, source_epsg: int, target_epsg: int, order: int = 3, mode: str = "constant", fill: float = 0.0) -> Raster:
    """Onto a grid of another reference system: its cell centres are projected back, then interpolated."""
    cells = meshgrid(r.cells.sparkSession, header)
    x, y = transform(F.col("x"), F.col("y"), target_epsg, source_epsg)
    found = interpolate(r, cells.select("row", "col", x.alias("x"), y.alias("y")), ["row", "col"], order, mode, fill)
    return Raster(found.select("row", "col", "val"), header)


def resample_stack(obs: DataFrame, header: Header, target: Header, order: int = 3, fill: float = 0.0) -> DataFrame:
    """(row, col, k, val) on another grid, every epoch at once: the weights of a target cell are made once
    and met by the observations under their cells. Missing where a cell with weight is missing (no row);
    targets outside the source grid have ``fill`` in every epoch."""
    at = meshgrid(obs.sparkSession, target).withColumn("cf", (F.col("x") - header.xstart) / header.dx).withColumn("rf", (F.col("y") - header.ystart) / header.dy)
    inside = F.col("rf").between(0, header.ny - 1) & F.col("cf").between(0, header.nx - 1)
    rows = F.array(*(F.struct(mapped(i, header.ny, "symmetric").alias("i"), w.alias("w")) for i, w in _weights(F.col("rf"), order)))
    cols = F.array(*(F.struct(mapped(i, header.nx, "symmetric").alias("i"), w.alias("w")) for i, w in _weights(F.col("cf"), order)))
    used = lambda x: F.filter(x, lambda e: e["w"] != 0)
    near = at.where(inside).select(F.col("row").alias("r"), F.col("col").alias("c"), used(rows).alias("a"), used(cols).alias("b")).withColumn("need", F.size("a") * F.size("b"))
    keyed = near.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).select("r", "c", "need", F.col("a.i").alias("row"), F.col("b.i").alias("col"), (F.col("a.w") * F.col("b.w")).alias("w"))
    met = obs.where("val is not null").join(keyed, ["row", "col"]).groupBy("r", "c", "k", "need").agg(F.sum(F.col("w") * F.col("val")).alias("val"), F.count("*").alias("n"))
    out = met.where("n = need").select(F.col("r").alias("row"), F.col("c").alias("col"), "k", "val")
    return out.unionByName(at.where(~inside).select("row", "col").crossJoin(obs.select("k").distinct()).select("row", "col", "k", F.lit(float(fill)).alias("val")))


def transect(r: Raster, start: tuple[float, float], end: tuple[float, float], n: int, order: int = 3) -> DataFrame:
    """(i, x, y, val) at n points from start to end."""
    t = F.col("i") / (n - 1)
    points = r.cells.sparkSession.range(n).select(F.col("id").cast("int").alias("i")).select("i", (start[0] + (end[0] - start[0]) * t).alias("x"), (start[1] + (end[1] - start[1]) * t).alias("y"))
    return interpolate(r, points, ["i"], order, "nearest")


def nearest_griddata(points: DataFrame, header: Header, bucket: float) -> Raster:
    """Each cell takes the value of the nearest point (ties: the lesser id). points: id, x, y, z.

    Points are put in square buckets; a cell looks at the 3 x 3 buckets around it, and cells whose
    best find lies farther than the buckets guarantee are searched again in buckets twice as wide."""
    spark = points.sparkSession
    cells = meshgrid(spark, header)
    diameter = (header.xspan**2 + header.yspan**2) ** 0.5 + bucket
    far = points.agg(F.max(F.abs("x")).alias("a"), F.max(F.abs("y")).alias("b")).first()
    diameter += sum(abs(v or 0.0) for v in far)
    # of points at one place the least id alone can win; the joined rows would have all of them
    points = points.join(points.groupBy("x", "y").agg(F.min("id").alias("id")), ["x", "y", "id"], "left_semi")
    done = None
    while True:
        key = lambda c: F.floor(F.col(c) / bucket).cast("bigint")
        p = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), "z", key("x").alias("bx"), key("y").alias("by"))
        around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
        c = cells.withColumn("kx", F.explode(around)).withColumn("ky", F.explode(around)).select("row", "col", "x", "y", (key("x") + F.col("kx")).alias("bx"), (key("y") + F.col("ky")).alias("by"))
        d = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
        best = c.join(p, ["bx", "by"]).groupBy("row", "col", "x", "y").agg(F.min(F.struct(d.alias("d"), "id", "z")).alias("m"))
        sure = best.where(F.col("m.d") <= bucket**2).select("row", "col", F.col("m.z").alias("val"))
        done = sure if done is None else done.unionByName(sure)
        cells = cells.join(sure.select("row", "col"), ["row", "col"], "left_anti")
        if bucket > diameter or cells.limit(1).count() == 0:
            return Raster(done, header)
        bucket *= 4
