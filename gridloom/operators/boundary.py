"""Polylines and polygons as vertices (seq, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.stencil import path_length


def truncate(b: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Vertices strictly inside the box."""
    return b.where((F.col("x") > xmin) & (F.col("x") < xmax) & (F.col("y") > ymin) & (F.col("y") < ymax))


def scale(b: DataFrame, k: float) -> DataFrame:
    return b.withColumns({"x": F.col("x") * k, "y": F.col("y") * k})


def reverse(b: DataFrame) -> DataFrame:
    n = b.agg(F.max("seq").alias("n"), F.min("seq").alias("m"))
    return b.crossJoin(F.broadcast(n)).select((F.col("n") + F.col("m") - F.col("seq")).alias("seq"), "x", "y")


def edges(b: DataFrame) -> DataFrame:
    """Closed ring of edges (x1, y1, x2, y2)."""
    w = Window.partitionBy(F.lit(1)).orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    return b.select(F.col("x").alias("x1"), F.col("y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def contains_points(b: DataFrame, points: DataFrame, most: int = 100_000) -> DataFrame:
    """points with ``inside``: crossings of a ray to the right, counted in the row over an array of
    the polygon's edges (at most so many), so points are neither shuffled nor multiplied."""
    e = edges(b)
    if e.limit(most + 1).count() > most:
        raise ValueError(f"polygons of more than {most} vertices are not sent to every task")
    ring = e.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("ring"))
    cross = lambda s: ((s["y1"] > F.col("y")) != (s["y2"] > F.col("y"))) & (F.col("x") < s["x1"] + (F.col("y") - s["y1"]) * F.try_divide(s["x2"] - s["x1"], s["y2"] - s["y1"]))
    return points.crossJoin(F.broadcast(ring)).withColumn("inside", F.size(F.filter("ring", cross)) % 2 == 1).drop("ring")


def along(b: DataFrame, n: int) -> DataFrame:
    """(i, dist, x, y): n points at equal distances along the line, by linear interpolation."""
    p = path_length(b)
    w = Window.partitionBy(F.lit(1)).orderBy("seq")
    seg = p.select("dist", "x", "y", F.lead("dist").over(w).alias("d2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("d2 > dist")
    total = p.agg(F.max("dist").alias("total"))
    # each segment makes its own points: i from ceil to floor of its ends, the last segment its far end too
    step = F.col("total") / (n - 1)
    made = seg.crossJoin(F.broadcast(total)).withColumn("lo", F.ceil(F.col("dist") / step - 1e-9).cast("int")).withColumn("hi", F.when(F.col("d2") >= F.col("total"), F.lit(n - 1)).otherwise(F.ceil(F.col("d2") / step - 1e-9).cast("int") - 1))
    made = made.where("hi >= lo").withColumn("i", F.explode(F.sequence("lo", "hi"))).withColumn("d", F.col("i") * step)
    t = (F.col("d") - F.col("dist")) / (F.col("d2") - F.col("dist"))
    return made.select("i", F.col("d").alias("dist"), (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def perpendicular_transects(b: DataFrame, n: int, half_width: float, n_points: int) -> DataFrame:
    """(i, j, x, y): n lines across the polyline, from +half_width on its left to -half_width."""
    w = Window.partitionBy(F.lit(1)).orderBy("i")
    p = along(b, n)
    nx, px, ny, py = (F.coalesce(F.lead("x").over(w), F.col("x")), F.coalesce(F.lag("x").over(w), F.col("x")), F.coalesce(F.lead("y").over(w), F.col("y")), F.coalesce(F.lag("y").over(w), F.col("y")))
    p = p.withColumn("tx", nx - px).withColumn("ty", ny - py).withColumn("len", F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2))
    j = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))
    off = half_width - 2 * half_width * F.col("j") / (n_points - 1)
    return p.withColumn("j", j).select("i", "j", (F.col("x") - F.col("ty") / F.col("len") * off).alias("x"), (F.col("y") + F.col("tx") / F.col("len") * off).alias("y"))


def smoothed(b: DataFrame, window: int) -> DataFrame:
    """Centred moving average with a triangular kernel, ends extended along their first and last step."""
    from gridloom.operators.stencil import triangular_kernel

    k = triangular_kernel(window // 2 + 1)
    r = len(k) // 2
    w = Window.partitionBy(F.lit(1)).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy(F.lit(1)).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = b.withColumn("n", F.count("*").over(whole)).withColumn("i", F.row_number().over(w))
    for c in ("x", "y"):
        first, second = F.first(c).over(whole), F.nth_value(c, 2).over(whole)
        last, before = F.last(c).over(whole), F.nth_value(c, 2).over(back)
        total = F.lit(0.0)
        for o, wt in zip(range(-r, r + 1), k):
            if wt:
                v = F.when(F.col("i") + o < 1, first - (second - first) * (1 - F.col("i") - o)).when(F.col("i") + o > F.col("n"), last + (last - before) * (F.col("i") + o - F.col("n"))).otherwise(F.lag(c, -o).over(w))
                total = total + wt * v
        out = out.withColumn(f"s{c}", total)
    return out.select("seq", F.col("sx").alias("x"), F.col("sy").alias("y"))
