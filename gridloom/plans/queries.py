"""Registered queries of the raster and time-series operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import builder, crs, dates, timefn
from gridloom.header import Header
from gridloom.operators import boundary, fill, interp, offsets, raster, sim, solve, stack, stencil, strain, vario
from gridloom.operators.raster import Raster
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_
from gridloom.sources import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns))


def _val(r: Raster | DataFrame) -> DataFrame:
    return r6((r.cells if isinstance(r, Raster) else r), "val")


# --- headers, coordinates, arithmetic


@query("meshgrid_coords", with_("grid") + " SELECT row, col, 0.0::DOUBLE + 100.0::DOUBLE * col AS x, 0.0::DOUBLE + -100.0::DOUBLE * row AS y FROM grid")
def _(spark, d):
    return raster.meshgrid(spark, fx.grid(spark, d).header)


@query("xy_to_imagecoord", with_("scat") + " SELECT id, CAST(round_even((x - 0.0) / 100.0::DOUBLE * 1.0, 0) AS INT) AS col, CAST(round_even((y * -0.37::DOUBLE - 0.0) / -100.0::DOUBLE, 0) AS INT) AS row FROM scat")
def _(spark, d):
    h = fx.grid(spark, d).header
    return fx.scatter(spark, d).select("id", h.col_of(F.col("x")).alias("col"), h.row_of(F.col("y") * -0.37).alias("row"))


@query("contains_point_header", with_("scat", "hdr") + " SELECT id, (CAST(round_even(x / 100.0::DOUBLE, 0) AS INT) BETWEEN 0 AND nx - 1) AND (CAST(round_even(y * -1 / -100.0::DOUBLE, 0) AS INT) BETWEEN 0 AND ny - 1) AS inside FROM scat, hdr")
def _(spark, d):
    return fx.scatter(spark, d).select("id", fx.grid(spark, d).header.contains(F.col("x"), -F.col("y")).alias("inside"))


@query("raster_add_mul", with_("grid", "holed") + " SELECT row, col, round((a.val + b.val) * a.val - 2.5::DOUBLE, 6) AS val FROM grid a JOIN holed b USING (row, col)")
def _(spark, d):
    a, b = fx.grid(spark, d), fx.holed(spark, d)
    return _val((a + b) * a - 2.5)


@query("raster_divide_power", with_("grid") + " SELECT row, col, round(CASE WHEN val = 0 THEN NULL ELSE 1.0::DOUBLE / val END, 6) AS inv, round(pow(val, 2.0::DOUBLE), 6) AS sq FROM grid")
def _(spark, d):
    g = fx.grid(spark, d)
    return r6(g.cells.select("row", "col", F.try_divide(F.lit(1.0), F.col("val")).alias("inv"), F.pow("val", F.lit(2.0)).alias("sq")), "inv", "sq")


@query("raster_ufunc_exp_log10", with_("grid") + " SELECT row, col, round(10 * log10(exp(val)), 6) AS val FROM grid")
def _(spark, d):
    return _val(fx.grid(spark, d).map(lambda v: 10 * F.log10(F.exp(v))))


@query("diag_multiply", with_("grid") + " SELECT row, col, round((row + 1) * val, 6) AS val, round(val * (col + 0.5::DOUBLE), 6) AS val2 FROM grid")
def _(spark, d):
    g = fx.grid(spark, d)
    left = g.scale_rows(g.cells.select("row").distinct().withColumn("d", F.col("row") + 1.0))
    right = g.scale_cols(g.cells.select("col").distinct().withColumn("d", F.col("col") + 0.5))
    return r6(left.cells.join(right.cells.withColumnRenamed("val", "val2"), ["row", "col"]), "val", "val2")


@query("raster_flatten", with_("grid") + " SELECT CAST(row AS BIGINT) * 64 + col AS i, round(val, 6) AS val FROM grid")
def _(spark, d):
    return r6(fx.grid(spark, d).flat(), "val")


@query("glen_rate_factor", with_("scat") + " SELECT id, round(log10(5.3e-15::DOUBLE * (365.25::DOUBLE * 86400.0::DOUBLE) * (1.2478766e-39::DOUBLE * exp(0.32769::DOUBLE * (-z / 100 + 273.15::DOUBLE)) + 1.9463011e-10::DOUBLE * exp(0.07205::DOUBLE * (-z / 100 + 273.15::DOUBLE)))), 6) AS a FROM scat")
def _(spark, d):
    return r6(fx.scatter(spark, d).select("id", F.log10(strain.glen_rate(-F.col("z") / 100, True)).alias("a")), "a")


@query("utm_zones", with_("scat") + " SELECT id, CAST(ceil((x / 30 - 160 + 180) / 6) AS INT) AS zone, CAST(CASE WHEN y >= 2000 THEN 32600 ELSE 32700 END + CAST(ceil((x / 30 - 160 + 180) / 6) AS INT) AS INT) AS epsg, CAST(((CAST(floor((x / 30 - 160 + 180) / 6) AS BIGINT) % 60 + 60) % 60) + 1 AS INT) AS zone2 FROM scat")
def _(spark, d):
    lon, lat = F.col("x") / 30 - 160, F.col("y") - 2000
    return fx.scatter(spark, d).select("id", dates.utm_zone(lon).alias("zone"), dates.utm_epsg(lon, lat).alias("epsg"), dates.utm_zone_floor(lon).alias("zone2"))


_E = crs.E


@query("crs_polar_stereographic", with_("scat") + f""", p AS (SELECT id, x / 30 - 160 AS lon, 60 + y / 200 AS lat FROM scat),
q AS (SELECT id, lon, lat, {crs._scale(70.0)!r}::DOUBLE * tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E!r}::DOUBLE * sin(radians(lat))) / (1 + {_E!r}::DOUBLE * sin(radians(lat))), {_E / 2!r}::DOUBLE) AS rho FROM p)
SELECT id, round(rho * sin(radians(lon + 45)), 3) AS px, round(-rho * cos(radians(lon + 45)), 3) AS py FROM q""")
def _(spark, d):
    x, y = crs.transform(F.col("x") / 30 - 160, 60 + F.col("y") / 200, 4326, 3413)
    return fx.scatter(spark, d).select("id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query("crs_round_trip_utm", with_("scat") + " SELECT id, round(x / 2000 + 7, 6) AS lon, round(y / 100 + 2, 6) AS lat FROM scat")
def _(spark, d):
    lon, lat = F.col("x") / 2000 + 7, F.col("y") / 100 + 2
    e, n = crs.transform(lon, lat, 4326, 32632)
    step = fx.scatter(spark, d).select("id", e.alias("e"), n.alias("n"))
    lon2, lat2 = crs.transform(F.col("e"), F.col("n"), 32632, 4326)
    return step.select("id", F.round(lon2, 6).alias("lon"), F.round(lat2, 6).alias("lat"))


# --- windows, masks


@query("raster_subset", with_("grid") + " SELECT row - 3 AS row, col - 10 AS col, round(val, 6) AS val FROM grid WHERE row >= 3 AND row < 33 AND col >= 10 AND col < 20")
def _(spark, d):
    return _val(fx.grid(spark, d).subset(1000.0, -300.0, 2000.0, -3300.0))


@query("raster_crop_inclusive", with_("grid") + " SELECT row - 3 AS row, col - 10 AS col, round(val, 6) AS val FROM grid WHERE row BETWEEN 3 AND 33 AND col BETWEEN 10 AND 20")
def _(spark, d):
    return _val(fx.grid(spark, d).crop(1000.0, 2000.0, -3300.0, -300.0))


@query("raster_mask", with_("grid") + " SELECT row, col, CASE WHEN (row + col) % 5 = 0 THEN -1.0 ELSE round(val, 6) END AS val FROM grid")
def _(spark, d):
    g = fx.grid(spark, d)
    return _val(g.mask(g.cells.where((F.col("row") + F.col("col")) % 5 == 0), -1.0))


@query("raster_keep_drop", with_("grid") + " SELECT row, col, round(val, 6) AS val, (row + col) % 5 = 0 AS kept FROM grid")
def _(spark, d):
    g = fx.grid(spark, d)
    m = g.cells.where((F.col("row") + F.col("col")) % 5 == 0)
    return _val(g.keep(m).cells.withColumn("kept", F.lit(True)).unionByName(g.drop(m).cells.withColumn("kept", F.lit(False))))


@query("raster_isfinite", with_("holed") + " SELECT row, col, val IS NOT NULL AS finite FROM holed")
def _(spark, d):
    return fx.holed(spark, d).isfinite()


@query("raster_flatnonzero", with_("grid") + " SELECT CAST(row AS BIGINT) * 64 + col AS i FROM grid WHERE val > 0.34::DOUBLE")
def _(spark, d):
    return fx.grid(spark, d).map(lambda v: F.when(v > 0.34, 1.0).otherwise(0.0)).flatnonzero()


@query("raster_any", with_("grid") + " SELECT bool_or(val <> 0) AS \"any\" FROM grid")
def _(spark, d):
    return fx.grid(spark, d).any()


@query("raster_tiles", with_("grid") + " SELECT row // 128 AS ty, col // 16 AS tx, count(*) AS n, round(sum(val), 6) AS s FROM grid GROUP BY 1, 2")
def _(spark, d):
    return r6(fx.grid(spark, d).tiles(128, 16).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.sum("val").alias("s")), "s")


@query("raster_pad_symmetric", with_("grid", "hdr") + """, o AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, ny, nx, r - 3 AS i, c - 3 AS j FROM hdr, range(0, 1000000) a(r), range(0, 70) b(c) WHERE r < ny + 6)
SELECT o.row, o.col, round(val, 6) AS val FROM o JOIN grid g ON g.row = CASE WHEN i < 0 THEN -1 - i WHEN i >= ny THEN 2 * ny - 1 - i ELSE i END AND g.col = CASE WHEN j < 0 THEN -1 - j WHEN j >= nx THEN 2 * nx - 1 - j ELSE j END""")
def _(spark, d):
    return _val(raster.pad(fx.grid(spark, d), 3, "symmetric"))


@query("boundary_truncate_reverse", with_("line") + ", t AS (SELECT * FROM line WHERE x > 2000 AND x < 90000 AND y > 8000 AND y < 8900) SELECT (SELECT max(seq) + min(seq) FROM t) - seq AS seq, x * 2 AS x, round(y * 2, 6) AS y FROM t")
def _(spark, d):
    return r6(boundary.scale(boundary.reverse(boundary.truncate(fx.line(spark, d), 2000, 90000, 8000, 8900)), 2.0), "y")


_POLY = [(500.0, 400.0), (6000.0, 300.0), (8200.0, 2600.0), (4000.0, 2500.0), (3500.0, 4700.0), (900.0, 4000.0)]


@query("points_in_polygon", with_("scat") + f""", e AS (SELECT * FROM (VALUES {', '.join(f'({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)' for a, b in zip(_POLY, _POLY[1:] + _POLY[:1]))}) t(x1, y1, x2, y2))
SELECT id, coalesce(sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END), 0) % 2 = 1 AS inside FROM scat, e GROUP BY id""")
def _(spark, d):
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(_POLY)], "seq int, x double, y double")
    return boundary.contains_points(b, fx.scatter(spark, d).select("id", "x", "y")).select("id", "inside")


# --- reductions

for _how in ("sum", "mean", "std", "median"):
    _sql = {"sum": "coalesce(sum(val), 0)", "mean": "avg(val)", "std": "stddev_pop(val)", "median": "median(val)"}[_how]
    _skip = {"sum": "sum(val)", "mean": "avg(val)", "std": "stddev_pop(val)", "median": "median(val)"}[_how]

    @query(f"raster_{_how}_propagate", with_("partly") + f" SELECT col, round(CASE WHEN count(*) = count(val) THEN {_skip} END, 6) AS val FROM partly GROUP BY col")
    def _(spark, d, how=_how):
        return _val(fx.partly_holed(spark, d).reduce(how, 0))

    @query(f"raster_nan{_how}_axis", with_("holed") + f" SELECT row, round({_sql}, 6) AS val FROM holed GROUP BY row")
    def _(spark, d, how=_how):
        return _val(fx.holed(spark, d).reduce(f"nan{how}", 1))


@query("raster_downsample_zero_pad", with_("grid") + " SELECT row // 7 AS row, col // 5 AS col, round(sum(val) / 35, 6) AS val FROM grid GROUP BY 1, 2")
def _(spark, d):
    return _val(fx.grid(spark, d).downsample(7, 5))


@query("raster_downsample_callable", with_("grid") + " SELECT row // 8 AS row, col // 8 AS col, round(greatest(max(val), CASE WHEN count(*) < 64 THEN 0 END), 6) AS val FROM grid GROUP BY 1, 2")
def _(spark, d):
    return _val(fx.grid(spark, d).downsample_with(8, 8, lambda v: v.max()))


@query("raster_percentiles", with_("grid") + " SELECT round(quantile_cont(val, 0.05), 6) AS p5, round(quantile_cont(val, 0.999), 6) AS p999 FROM grid")
def _(spark, d):
    return r6(fx.grid(spark, d).cells.agg(F.percentile("val", 0.05).alias("p5"), F.percentile("val", 0.999).alias("p999")), "p5", "p999")


# --- stacks

for _how in ("mean", "median", "std"):

    @query(f"stack_{_how}", with_("mon") + f" SELECT row, col, round({dict(mean='avg', median='median', std='stddev_pop')[_how]}(val), 6) AS val FROM mon GROUP BY row, col")
    def _(spark, d, how=_how):
        return _val(stack.over_time(fx.moncube(spark, d), how))


@query("stack_slice", with_("mon") + " SELECT row, col, round(val, 6) AS val FROM mon WHERE k = 12")
def _(spark, d):
    return _val(stack.epoch(fx.moncube(spark, d), 12))


@query("stack_chunk", with_("mon") + " SELECT row, col, k, round(val, 6) AS val FROM mon WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 3")
def _(spark, d):
    return _val(stack.chunk(fx.moncube(spark, d), 2, 6, 1, 4).select("row", "col", "k", "val"))


@query("stack_timeseries_window", with_("mon") + " SELECT k, round(avg(val) / 3, 6) AS val FROM mon WHERE row BETWEEN 4 AND 6 AND col BETWEEN 2 AND 4 GROUP BY k")
def _(spark, d):
    return stack.timeseries(fx.moncube(spark, d), 5, 3, 3, 100, 7).select("k", F.round(F.col("val") / 3, 6).alias("val"))


@query("stack_timeseries_points", with_("mon") + " SELECT p.id, k, round(avg(val) / 3, 6) AS val FROM mon JOIN (VALUES (1, 3, 2), (2, 7, 4)) p(id, r, c) ON row BETWEEN r - 1 AND r + 1 AND col BETWEEN c - 1 AND c + 1 GROUP BY 1, 2")
def _(spark, d):
    return stack.points_timeseries(fx.moncube(spark, d), spark.createDataFrame([(1, 3, 2), (2, 7, 4)], "id int, row int, col int"), 3).select("id", "k", F.round(F.col("val") / 3, 6).alias("val"))


@query("stack_time_to_index", with_("mon", "mone") + " SELECT arg_min(k, struct_pack(d := abs(tdec - 1996.52::DOUBLE), k := k)) AS k FROM mone")
def _(spark, d):
    return stack.nearest_epoch(fx.mon_epochs(spark, d), 1996.52)


@query("stack_nearest_epochs", with_("mon", "mone", "tdec") + " SELECT event_id AS id, arg_min(k, struct_pack(d := abs(m.tdec - (t.tdec - 27)), k := k)) AS k FROM tdec t, mone m GROUP BY 1")
def _(spark, d):
    return stack.nearest_epochs(fx.mon_epochs(spark, d), fx.tdec(spark, d).select(F.col("event_id").alias("id"), (F.col("tdec") - 27).alias("t")))


@query("stack_dt_shape", with_("mon", "mone") + ", s AS (SELECT CAST(max(k) + 1 AS BIGINT) AS nt, CAST(max(row) + 1 AS BIGINT) AS ny, CAST(max(col) + 1 AS BIGINT) AS nx FROM mon), l AS (SELECT tdec - lag(tdec) OVER (ORDER BY tdec) AS d FROM mone) SELECT nt, ny, nx, (SELECT round((max(tdec) - min(tdec)) / (count(*) - 1), 6) FROM mone) AS dt, (SELECT round(median(d), 6) FROM l) AS median_dt FROM s")
def _(spark, d):
    e = fx.mon_epochs(spark, d)
    both = stack.mean_interval(e).crossJoin(stack.median_interval(e).withColumnRenamed("dt", "median_dt"))
    return r6(stack.shape(fx.moncube(spark, d)).crossJoin(both), "dt", "median_dt")


@query("magstack", with_("mon") + " SELECT a.row, a.col, a.k, round(sqrt(a.val * a.val + b.val * b.val), 6) AS val FROM mon a JOIN mon b ON a.row = b.row AND a.k = b.k AND b.col = 6 - a.col")
def _(spark, d):
    m = fx.moncube(spark, d)
    return _val(stack.combined([m, m.withColumn("col", (6 - F.col("col")).cast("int"))], "mag"))


@query("sumstack", with_("mon") + " SELECT a.row, a.col, a.k, round(a.val + b.val, 6) AS val FROM mon a JOIN mon b ON a.row = b.row AND a.k = b.k AND b.col = 6 - a.col")
def _(spark, d):
    m = fx.moncube(spark, d)
    return _val(stack.combined([m, m.withColumn("col", (6 - F.col("col")).cast("int"))], "sum"))


@query("magstack_timeseries", with_("mon") + ", s AS (SELECT k, avg(val) FILTER (col BETWEEN 1 AND 3) AS a, avg(val) FILTER (col BETWEEN 3 AND 5) AS b FROM mon WHERE row BETWEEN 4 AND 6 GROUP BY k) SELECT k, round(sqrt(a * a + b * b) / 3, 6) AS val FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    m = fx.moncube(spark, d)
    out = stack.combined_timeseries([m, m.withColumn("col", (6 - F.col("col")).cast("int"))], "mag", 5, 2, 3, 100, 7)
    return out.select("k", F.round(F.col("val") / 3, 6).alias("val"))


@query("stack_snapshot_sum", with_("mon") + " SELECT a.row, a.col, round(a.val + b.val, 6) AS val FROM mon a JOIN mon b ON a.row = b.row AND b.col = 6 - a.col AND b.k = a.k WHERE a.k = 12 AND a.col BETWEEN 1 AND 4")
def _(spark, d):
    m = fx.moncube(spark, d)
    return _val(stack.snapshot([m, m.withColumn("col", (6 - F.col("col")).cast("int"))], 12, 0, 1 << 30, 1, 5))


@query("stack_frame_difference", with_("mon") + " SELECT a.row, a.col, round(a.val - b.val, 6) AS val FROM mon a JOIN mon b ON a.row = b.row AND a.col = b.col WHERE a.k = 20 AND b.k = 3")
def _(spark, d):
    return _val(stack.difference(fx.moncube(spark, d), 20, 3))


@query("stack_crop_times", with_("mon", "mone") + ", a AS (SELECT arg_min(k, struct_pack(d := abs(tdec - 1996.0::DOUBLE), k := k)) AS k0 FROM mone), b AS (SELECT arg_min(k, struct_pack(d := abs(tdec - 1997.0::DOUBLE), k := k)) AS k1 FROM mone) SELECT row, col, CAST(k - k0 AS INT) AS k, round(val, 6) AS val FROM mon, a, b WHERE k >= k0 AND k < k1")
def _(spark, d):
    return _val(stack.crop_times(fx.moncube(spark, d).drop("wgt"), fx.mon_epochs(spark, d), 1996.0, 1997.0))


@query("stack_set_slice_chunk", with_("mon") + " SELECT row, col, k, round(CASE WHEN k = 5 THEN -1 WHEN row < 3 AND k = 6 THEN 0 ELSE val END, 6) AS val FROM mon")
def _(spark, d):
    m = fx.moncube(spark, d)
    a = stack.set_slice(m, m.where("k = 5").select("row", "col", F.lit(-1.0).alias("val")), 5)
    return _val(stack.set_chunk(a, m.where("row < 3 and k = 6").select("row", "col", "k", F.lit(0.0).alias("val"))))


# --- stencils

_DX = """CASE WHEN {i} = 0 THEN (-3 * {v} + 4 * lead({v}) OVER {w} - lead({v}, 2) OVER {w}) / (2 * {h}) WHEN {i} = {n} - 1 THEN (3 * {v} - 4 * lag({v}) OVER {w} + lag({v}, 2) OVER {w}) / (2 * {h}) ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / (2 * {h}) END"""
_GX = lambda v, n="64", h="100.0": _DX.format(v=v, i="col", n=n, h=h + "::DOUBLE", w="(PARTITION BY row ORDER BY col)")
_GY = lambda v, h="-100.0": _DX.format(v=v, i="row", n="(SELECT ny FROM hdr)", h=f"({h}::DOUBLE)", w="(PARTITION BY col ORDER BY row)")


@query("gradient_edge2", with_("grid", "hdr") + f" SELECT row, col, round(val, 6) AS val, round({_GY('val')}, 6) AS dval_dy, round({_GX('val')}, 6) AS dval_dx FROM grid")
def _(spark, d):
    return r6(stencil.gradients(fx.grid(spark, d)), "val", "dval_dy", "dval_dx")


@query("gradient_missing", with_("grid", "holed", "hdr") + f", g AS (SELECT row, col, val, {_GX('val')} AS g FROM holed) SELECT row, col, round(CASE WHEN val IS NOT NULL THEN g END, 6) AS g FROM g")
def _(spark, d):
    h = fx.holed(spark, d)
    return r6(stencil.gradient(h.cells, "col", ["row"], 100.0, out="g").select("row", "col", "g"), "g")


_K3 = stencil.triangular_kernel(3)


def _smooth_sql(src: str, axis: str, other: str, n: str, k: list[float]) -> str:
    r = len(k) // 2
    offs = ", ".join(f"({o - r}, {w!r}::DOUBLE)" for o, w in enumerate(k))
    return f"(SELECT {other}, t AS {axis}, sum(w * val) AS val FROM (SELECT t, CASE WHEN t + o < 0 THEN -1 - (t + o) WHEN t + o >= n THEN 2 * n - 1 - (t + o) ELSE t + o END AS s, w FROM (SELECT CAST(unnest(range(n)) AS INT) AS t, n FROM (SELECT {n} AS n FROM hdr)), (VALUES {offs}) q(o, w)) z JOIN {src} g ON g.{axis} = z.s GROUP BY {other}, t)"


@query("triangular_smooth", with_("grid", "hdr") + f", a AS {_smooth_sql('grid', 'col', 'row', 'nx', _K3)}, b AS {_smooth_sql('a', 'row', 'col', 'ny', _K3)} SELECT row, col, round(val, 6) AS val FROM b")
def _(spark, d):
    return _val(stencil.triangular_smooth(fx.grid(spark, d), 3))


_SG = stencil.savgol_kernels(5, 3)[2]


@query("savgol_gradient_x", with_("grid", "hdr") + f""", q AS (SELECT * FROM (VALUES {', '.join(f'({a - 2}, {b - 2}, {float(_SG[a, b])!r}::DOUBLE)' for a in range(5) for b in range(5))}) t(a, b, w)),
m AS (SELECT c.row, c.col, w, CASE WHEN c.row + a < 0 THEN -(c.row + a) WHEN c.row + a >= ny THEN 2 * ny - 2 - (c.row + a) ELSE c.row + a END AS r, CASE WHEN c.col + b < 0 THEN -(c.col + b) WHEN c.col + b >= nx THEN 2 * nx - 2 - (c.col + b) ELSE c.col + b END AS s FROM grid c, q, hdr)
SELECT m.row, m.col, round(sum(w * g.val) / 100, 6) AS val FROM m JOIN grid g ON g.row = m.r AND g.col = m.s GROUP BY 1, 2""")
def _(spark, d):
    return _val(stencil.savgol_gradient(fx.grid(spark, d), 5, 3)[1])


@query("adaptive_smooth")
def _(spark, d):
    g = fx.grid(spark, d)
    return _val(stencil.adaptive_smooth(g, stencil.radius_map(g.map(F.abs), 10, 90, 0.0, 3.0), 3))


@query("path_length", with_("line") + ", s AS (SELECT seq, coalesce(sqrt(pow(x - lag(x) OVER (ORDER BY seq), 2) + pow(y - lag(y) OVER (ORDER BY seq), 2)), 0) AS st FROM line) SELECT seq, round(sum(st) OVER (ORDER BY seq), 6) AS dist FROM s")
def _(spark, d):
    return r6(stencil.path_length(fx.line(spark, d)).select("seq", "dist"), "dist")


_FD = "({b1} * 0 + 0)"


@query("finite_difference_nonuniform", with_("prof") + """, w AS (SELECT i, x, h, x - lag(x) OVER o AS a, lead(x) OVER o - x AS b, lag(h) OVER o AS hm, lead(h) OVER o AS hp, row_number() OVER o AS n, count(*) OVER () AS c FROM prof WINDOW o AS (ORDER BY x))
SELECT i, round(CASE WHEN n = 1 THEN (hp - h) / b WHEN n = c THEN (h - hm) / a ELSE (a * a * hp + (b * b - a * a) * h - b * b * hm) / (a * b * (a + b)) END, 6) AS g FROM w""")
def _(spark, d):
    return r6(stencil.nonuniform_gradient(fx.profile(spark, d), "x", "h", [], 1, "g").select("i", "g"), "g")


@query("robust_gradient_ils")
def _(spark, d):
    return r6(fill.robust_gradient(fx.holed(spark, d), 5, 1), "fit", "dy", "dx")


# --- interpolation


@query("resample_order1", with_("grid", "hdr") + """, t AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, 0.4::DOUBLE + r * 0.8::DOUBLE AS rf, 0.3::DOUBLE + c * 0.9::DOUBLE AS cf FROM range(0, 1000000) a(r), range(0, 60) b(c), hdr WHERE r < ny),
w AS (SELECT row, col, floor(rf) + i AS sr, floor(cf) + j AS sc, (CASE WHEN i = 0 THEN 1 - (rf - floor(rf)) ELSE rf - floor(rf) END) * (CASE WHEN j = 0 THEN 1 - (cf - floor(cf)) ELSE cf - floor(cf) END) AS w FROM t, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j))
SELECT w.row, w.col, round(sum(w * val), 5) AS val FROM w JOIN grid g ON g.row = sr AND g.col = sc GROUP BY 1, 2""")
def _(spark, d):
    g = fx.grid(spark, d)
    out = interp.resample(g, replace(g.header, xstart=30.0, ystart=-40.0, dx=90.0, dy=-80.0, nx=60), 1)
    return out.cells.select("row", "col", F.round("val", 5).alias("val"))


@query("resample_order3_nearest_mode")
def _(spark, d):
    g = fx.grid(spark, d)
    return _val(interp.resample(g, replace(g.header, xstart=30.0, ystart=-40.0, dx=90.0, dy=-80.0, nx=60), 3, "nearest"))


@query("resample_order0", with_("grid") + " SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(val, 6) AS val FROM range(0, 40) a(r), range(0, 30) b(c), grid g WHERE g.row = floor(r * 1.5::DOUBLE + 0.3::DOUBLE + 0.5::DOUBLE) AND g.col = floor(c * 2.0::DOUBLE + 0.2::DOUBLE + 0.5::DOUBLE)")
def _(spark, d):
    g = fx.grid(spark, d)
    return _val(interp.resample(g, replace(g.header, xstart=20.0, ystart=-30.0, dx=200.0, dy=-150.0, nx=30, ny=40), 0))


@query("warp_polar_to_geographic", with_("grid", "hdr") + f""", t AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, -44.9::DOUBLE + 0.2::DOUBLE * c AS lon, 89.99::DOUBLE - 0.004::DOUBLE * r AS lat FROM range(0, 110) a(r), range(0, 40) b(c)),
q AS (SELECT row, col, lon, {crs._scale(70.0)!r}::DOUBLE * tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E!r}::DOUBLE * sin(radians(lat))) / (1 + {_E!r}::DOUBLE * sin(radians(lat))), {_E / 2!r}::DOUBLE) AS rho FROM t),
z AS (SELECT row, col, rho * sin(radians(lon + 45)) / 100 AS cf, rho * cos(radians(lon + 45)) / 100 AS rf FROM q),
w AS (SELECT row, col, rf BETWEEN 0 AND ny - 1 AND cf BETWEEN 0 AND 63 AS inside, floor(rf) + i AS sr, floor(cf) + j AS sc, (CASE WHEN i = 0 THEN 1 - (rf - floor(rf)) ELSE rf - floor(rf) END) * (CASE WHEN j = 0 THEN 1 - (cf - floor(cf)) ELSE cf - floor(cf) END) AS w FROM z, hdr, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j))
SELECT w.row, w.col, round(CASE WHEN bool_or(inside) THEN sum(w * val) ELSE 0 END, 5) AS val FROM w LEFT JOIN grid g ON g.row = sr AND g.col = sc GROUP BY 1, 2""")
def _(spark, d):
    out = interp.warp(fx.grid(spark, d), Header(-44.9, 89.99, 0.2, -0.004, 40, 110), 3413, 4326, 1)
    return out.cells.select("row", "col", F.round("val", 5).alias("val"))


@query("stack_resample_order1", with_("mon", "sup") + """, t AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, 0.4::DOUBLE + r AS rf, 0.3137::DOUBLE + 0.5::DOUBLE * c AS cf FROM range(0, 1000000) a(r), range(0, 12) b(c), sup WHERE r < ny - 1),
w AS (SELECT row, col, floor(rf) + i AS sr, floor(cf) + j AS sc, (CASE WHEN i = 0 THEN 1 - (rf - floor(rf)) ELSE rf - floor(rf) END) * (CASE WHEN j = 0 THEN 1 - (cf - floor(cf)) ELSE cf - floor(cf) END) AS w FROM t, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j))
SELECT w.row, w.col, m.k, round(sum(w * val), 3) AS val FROM w JOIN mon m ON m.row = sr AND m.col = sc GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def _(spark, d):
    ny = spark.read.parquet(f"{d}/supplier.parquet").count() + 1
    out = interp.resample_stack(fx.moncube(spark, d), Header(0.0, 0.0, 100.0, -100.0, 7, ny), Header(31.37, -40.0, 50.0, -100.0, 12, ny - 1), 1)
    return out.select("row", "col", "k", F.round("val", 3).alias("val"))


@query("transect_order1", with_("grid") + """, t AS (SELECT CAST(i AS INT) AS i, (5.0::DOUBLE + 45.0::DOUBLE * (i / 99.0::DOUBLE)) AS cf, (3.0::DOUBLE + 47.0::DOUBLE * (i / 99.0::DOUBLE)) AS rf FROM range(0, 100) a(i)),
w AS (SELECT i, rf, cf, floor(rf) + p AS sr, floor(cf) + q AS sc, (CASE WHEN p = 0 THEN 1 - (rf - floor(rf)) ELSE rf - floor(rf) END) * (CASE WHEN q = 0 THEN 1 - (cf - floor(cf)) ELSE cf - floor(cf) END) AS w FROM t, (VALUES (0), (1)) p(p), (VALUES (0), (1)) q(q))
SELECT i, round(sum(w * val), 5) AS val FROM w JOIN grid g ON g.row = sr AND g.col = sc GROUP BY i""")
def _(spark, d):
    return interp.transect(fx.grid(spark, d), (500.0, -300.0), (5000.0, -5000.0), 100, 1).select("i", F.round("val", 5).alias("val"))


@query("griddata_nearest", with_("scat") + """, c AS (SELECT CAST(r AS INT) AS row, CAST(k AS INT) AS col, k * 401.0::DOUBLE AS x, r * 203.0::DOUBLE AS y FROM range(0, 20) a(r), range(0, 20) b(k))
SELECT row, col, arg_min(z, struct_pack(d := pow(s.x - c.x, 2) + pow(s.y - c.y, 2), id := id)) AS val FROM c, scat s GROUP BY 1, 2""")
def _(spark, d):
    return interp.nearest_griddata(fx.scatter(spark, d), Header(0.0, 0.0, 401.0, 203.0, 20, 20), 300.0).cells


@query("inpaint_spring")
def _(spark, d):
    return _val(fill.inpaint(fx.holed(spark, d)))


@query("perpendicular_transects")
def _(spark, d):
    return r6(boundary.perpendicular_transects(fx.line(spark, d), 12, 500.0, 5), "x", "y")


@query("boundary_smoothed")
def _(spark, d):
    return r6(boundary.smoothed(fx.line(spark, d), 5), "x", "y")


@query("variogram_semi", with_("scat") + """, s AS (SELECT * FROM scat ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 1000),
p AS (SELECT CAST(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 500.0::DOUBLE) + 1 AS INT) AS bin, pow(a.z - b.z, 2) AS v FROM s a JOIN s b ON a.id > b.id)
SELECT bin, (bin + 0.5::DOUBLE) * 500.0::DOUBLE AS dist, count(*) AS n, round(0.5 * avg(v), 4) AS gamma, round(0.5 * stddev_pop(v), 4) AS gstd FROM p WHERE bin <= 8 GROUP BY bin""")
def _(spark, d):
    v = vario.variogram(fx.scatter(spark, d), 5000.0, 500.0)
    return v.select("bin", "dist", "n", F.round("gamma", 4).alias("gamma"), F.round("gstd", 4).alias("gstd"))


@query("variogram_detrended")
def _(spark, d):
    return r6(vario.variogram(fx.scatter(spark, d), 5000.0, 500.0, detrend=True), "gamma", "gstd")


# --- strain


def _strain_sql() -> str:
    gx, gy = (lambda v: _GX(v, "32")), _GY
    return with_("grid", "vel", "hdr") + f""", g AS (SELECT row, col, vx, vy, {gx('vx')} AS l11, {gy('vx')} AS l12, {gx('vy')} AS l21, {gy('vy')} AS l22 FROM vel),
e AS (SELECT *, l11 AS exx, l22 AS eyy, 0.5 * (l12 + l21) AS exy, sqrt(l11 * l11 + l22 * l22 + 0.25 * (l12 + l21) * (l12 + l21) + l11 * l22 + 1e-10::DOUBLE) AS eff FROM g),
s AS (SELECT *, sqrt(greatest(0.25 * (exx + eyy) * (exx + eyy) - (exx * eyy - exy * exy), 0)) AS sh FROM e)"""


@query("strain_rates", _strain_sql() + " SELECT row, col, round(exx, 6) AS e_xx, round(eyy, 6) AS e_yy, round(exy, 6) AS e_xy, round(l11 + l22, 6) AS dilatation, round(eff, 6) AS effective, round(sh, 6) AS shear_magnitude, round(0.5 * (exx + eyy) + 0.5 * sh, 6) AS e_max, round(0.5 * (exx + eyy) - 0.5 * sh, 6) AS e_min FROM s")
def _(spark, d):
    names = ("e_xx", "e_yy", "e_xy", "dilatation", "effective", "shear_magnitude", "e_max", "e_min")
    return r6(strain.strain(fx.velocity(spark, d)).select("row", "col", *names), *names)


@query("stress_driving", _strain_sql() + f""", t AS (SELECT *, 500 + 100 * vx AS h, 0.5 * pow(1e-16::DOUBLE, -1.0::DOUBLE / 3) * pow(eff, -2.0::DOUBLE / 3) AS eta FROM s),
u AS (SELECT *, {_GX('h', '32')} AS hx, {_GY('h')} AS hy FROM t)
SELECT row, col, round(eta / 1000, 3) AS eta, round(2 * eta * exx, 2) AS t_xx, round(2 * eta * exy, 2) AS t_xy, round(-917.0::DOUBLE * 9.80665::DOUBLE * h * hx, 2) AS tdx, round(-917.0::DOUBLE * 9.80665::DOUBLE * h * hy, 2) AS tdy FROM u""")
def _(spark, d):
    s = strain.stress(strain.strain(fx.velocity(spark, d)), 1e-16).withColumn("h", 500 + 100 * F.col("vx"))
    m = strain.membrane(s, 100.0, -100.0)
    return m.select("row", "col", F.round(F.col("eta") / 1000, 3).alias("eta"), *(F.round(c, 2).alias(c) for c in ("t_xx", "t_xy", "tdx", "tdy")))


@query("strain_rotated_membrane")
def _(spark, d):
    s = strain.stress(strain.strain(fx.velocity(spark, d), rotate=True)).withColumn("h", 500 + 100 * F.col("vx")).withColumn("b", F.lit(-100.0))
    return strain.membrane(s, 100.0, -100.0, rotate=True)


# --- functions of time

_T = "(tdec - 2024.0::DOUBLE)"


def _spline_sql(x: str, order: int, power: int) -> str:
    return "(" + " + ".join(f"{(-1) ** k * math.comb(order + 1, k)} * pow(greatest({x} - {k}, 0), {power})" for k in range(order + 2)) + ")"


_FNS = {
    "timefn_power": (timefn.Cubic(tref=2024.0), f"pow({_T}, 3)"),
    "timefn_exp": (timefn.Exp(tref=2024.0, tau=0.3), f"exp(-{_T} / 0.3::DOUBLE)"),
    "timefn_exp10": (timefn.Exp10(tref=2024.0, tau=0.3), f"pow(10.0::DOUBLE, -{_T} / 0.3::DOUBLE)"),
    "timefn_exp2": (timefn.Exp2(tref=2024.0, tau=0.3), f"pow(2.0::DOUBLE, -{_T} / 0.3::DOUBLE)"),
    "timefn_log": (timefn.Log(tref=2020.0, tau=0.5), "ln(abs((tdec - 2020.0::DOUBLE) / 0.5::DOUBLE))"),
    "timefn_log10": (timefn.Log10(tref=2020.0), "log10(abs(tdec - 2020.0::DOUBLE))"),
    "timefn_log2": (timefn.Log2(tref=2020.0), "log2(abs(tdec - 2020.0::DOUBLE))"),
    "timefn_geolog": (timefn.GeoLog(tref=2024.02, tau=0.1), "CASE WHEN tdec >= 2024.02::DOUBLE THEN ln(1 + abs((tdec - 2024.02::DOUBLE) / 0.1::DOUBLE)) ELSE 0 END"),
    "timefn_cos": (timefn.Cos(tref=2024.0, period=0.1), f"cos(2 * pi() * {_T} / 0.1::DOUBLE)"),
    "timefn_sin": (timefn.Sin(tref=2024.0, period=0.1), f"sin(2 * pi() * {_T} / 0.1::DOUBLE)"),
    "timefn_arctan": (timefn.Arctan(tref=2024.03, period=0.02), "atan((tdec - 2024.03::DOUBLE) / 0.02::DOUBLE)"),
    "timefn_step": (timefn.Constant(tmin=2024.04), "CASE WHEN tdec >= 2024.04::DOUBLE THEN 1.0 ELSE 0.0 END"),
    "timefn_bspline": (timefn.BSpline(tref=2024.03, scale=0.02, order=3), _spline_sql("((tdec - 2024.03::DOUBLE) / 0.02::DOUBLE + 2)", 3, 3) + " / 6"),
    "timefn_ispline": (timefn.ISpline(tref=2024.03, scale=0.02, order=3), _spline_sql("((tdec - 2024.03::DOUBLE) / 0.02::DOUBLE + 2)", 3, 4) + " * 0.02::DOUBLE / 24"),
    "timefn_bspline_quadratic": (timefn.BSpline(tref=2024.03, scale=0.02), _spline_sql("((tdec - 2024.03::DOUBLE) / 0.02::DOUBLE + 1.5)", 2, 2) + " / 2"),
    "timefn_pbspline": (timefn.PBSpline(tref=2024.0, scale=0.01, period=0.04, offset=0.01, order=3), _spline_sql(f"((({_T} - 0.01::DOUBLE) - 0.04::DOUBLE * round_even(({_T} - 0.01::DOUBLE) / 0.04::DOUBLE, 0)) / 0.01::DOUBLE + 2)", 3, 3) + " / 6"),
}
for _name, (_fn, _sql) in _FNS.items():

    @query(_name, with_("tdec") + f" SELECT event_id, round(CAST({_sql} AS DOUBLE), 5) AS val FROM tdec")
    def _(spark, d, fn=_fn):
        return fx.tdec(spark, d).select("event_id", F.round(fn.column(F.col("tdec")), 5).alias("val"))


@query("timefn_collection_parsed", with_("tdec") + f" SELECT event_id, round({_T}, 5) AS g1, round(cos(2 * pi() * {_T} / 0.5::DOUBLE), 5) AS g2, round(sin(2 * pi() * {_T} / 0.5::DOUBLE), 5) AS g3 FROM tdec")
def _(spark, d):
    c = timefn.parse("[linear(tref=2024);periodic(tref=2024,period=0.5)]")
    return fx.tdec(spark, d).select("event_id", *(F.round(x, 5).alias(f"g{i}") for i, x in enumerate(c.columns(F.col("tdec")), 1)))


_BUILT = builder.temporal_model(2024.0, 2024.08, degree=2, periods=(0.1,), steps=(2024.04,), isplines=(4,))


@query("temporal_model_built", with_("tdec") + f""" SELECT event_id, {_T} AS g1, pow({_T}, 2) AS g2, CASE WHEN tdec BETWEEN 2024.0::DOUBLE AND 2024.08::DOUBLE THEN cos(2 * pi() * {_T} / 0.1::DOUBLE) ELSE 0 END AS g3,
CASE WHEN tdec >= 2024.04::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS g5, {_spline_sql(f"(({_T}) / ((2024.08::DOUBLE - 2024.0::DOUBLE) / 3) + 2)", 3, 4)} * ((2024.08::DOUBLE - 2024.0::DOUBLE) / 3) / 24 AS g6 FROM tdec""".replace("AS g1", "AS g1x").replace("SELECT event_id, ", "SELECT event_id, round(").replace(" AS g1x, pow", ", 5) AS g1, round(pow").replace(", 2) AS g2, CASE", ", 2), 5) AS g2, round(CASE").replace("END AS g3,\nCASE", "END, 5) AS g3, round(CASE").replace("END AS g5, ", "END, 5) AS g5, round(").replace(" / 24 AS g6", " / 24, 5) AS g6"))
def _(spark, d):
    c = dict(enumerate(_BUILT.columns(F.col("tdec"))))
    return fx.tdec(spark, d).select("event_id", *(F.round(c[i], 5).alias(f"g{i}") for i in (1, 2, 3, 5, 6)))


# --- dates


@query("decimal_year", with_("tdec") + " SELECT event_id, round(tdec, 9) AS tdec FROM tdec")
def _(spark, d):
    return fx.tdec(spark, d).select("event_id", F.round("tdec", 9).alias("tdec"))


@query("decimal_year_round_trip", "SELECT event_id, CAST(date_trunc('second', ts) AS DATE) AS day FROM events")
def _(spark, d):
    return fx.tdec(spark, d).select("event_id", dates.from_decimal_year(F.col("tdec") + 1e-9).cast("date").alias("day"))


@query("modified_julian_day", "SELECT o_orderkey, CAST(date_diff('day', DATE '1858-11-17', CAST(o_orderdate AS DATE)) AS INT) AS mjd, CAST(o_orderdate AS DATE) AS back, CAST(dayofyear(o_orderdate) AS INT) AS doy FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", dates.date_to_mjd(F.col("o_orderdate").cast("date")).alias("mjd"))
    return o.select("o_orderkey", "mjd", dates.mjd_to_date(F.col("mjd")).alias("back"), dates.mjd_to_year_day(F.col("mjd"))["doy"].alias("doy"))


@query("time_of_day", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS sod, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0::DOUBLE, 6) AS hod FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", dates.seconds_of_day(F.col("ts")).alias("sod"), F.round(dates.hours_of_day(F.col("ts")), 6).alias("hod"))


@query("date_list", "WITH e AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders) SELECT CAST(a + CAST(12 * i AS INT) AS DATE) AS day FROM e, range(0, 10000) r(i) WHERE i <= CAST(ceil(date_diff('day', a, b) / 12.0) AS INT)")
def _(spark, d):
    ends = spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return ends.select(dates.every(F.col("a"), F.col("b"), 12).alias("day"))


# --- regression

_LINE = with_("mon", "mone") + """, o AS (SELECT row, col, val AS d, wgt * wgt AS w, tdec - 1998.0::DOUBLE AS t FROM mon JOIN mone USING (k)),
s AS (SELECT row, col, count(*) AS n, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * d) AS y0, sum(w * t * d) AS y1 FROM o GROUP BY 1, 2),
f AS (SELECT row, col, n, CASE WHEN n >= 20 THEN (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) END AS m0, CASE WHEN n >= 20 THEN (s0 * y1 - s1 * y0) / (s0 * s2 - s1 * s1) END AS m1 FROM s)"""


@query("decompose_linear", _LINE + " SELECT row, col, n, round(m0, 4) AS m0, round(m1, 4) AS m1 FROM f")
def decompose_linear(spark, d):
    """The flagship: a weighted line per pixel, inside the JVM."""
    f = solve.closed_form_line(fx.moncube(spark, d), fx.mon_epochs(spark, d), ["row", "col"], 1998.0)
    return f.select("row", "col", "n", F.round("m0", 4).alias("m0"), F.round("m1", 4).alias("m1"))


_LINEAR = timefn.Collection([timefn.Constant(), timefn.Linear(tref=1998.0)])


@query("fit_lsqr_weighted", _LINE + " SELECT row, col, CAST(CASE WHEN n >= 20 THEN 0 ELSE 1 END AS INT) AS status, n, round(m0, 4) AS m0, round(m1, 4) AS m1 FROM f")
def _(spark, d):
    f = solve.lsqr(fx.moncube(spark, d), fx.mon_epochs(spark, d), _LINEAR)
    return f.select("row", "col", "status", "n", F.round(F.col("m")[0], 4).alias("m0"), F.round(F.col("m")[1], 4).alias("m1"))


@query("fit_ridge", _LINE.replace("s2 * y0", "(s2 + 50) * y0").replace("s0 * s2 -", "s0 * (s2 + 50) -") + " SELECT row, col, round(m0, 4) AS m0, round(m1, 4) AS m1 FROM f")
def _(spark, d):
    f = solve.ridge(fx.moncube(spark, d), fx.mon_epochs(spark, d), _LINEAR, 50.0, [1])
    return f.select("row", "col", F.round(F.col("m")[0], 4).alias("m0"), F.round(F.col("m")[1], 4).alias("m1"))


@query("predict_full_sigma", _LINE + ", g AS (SELECT *, s0 * s2 - s1 * s1 AS det FROM s) SELECT f.row, f.col, e.k, round(m0 + m1 * (tdec - 1998.0::DOUBLE), 3) AS \"full\", round(sqrt((s2 - 2 * (tdec - 1998.0::DOUBLE) * s1 + (tdec - 1998.0::DOUBLE) * (tdec - 1998.0::DOUBLE) * s0) / det), 6) AS sigma FROM f JOIN g USING (row, col), mone e WHERE f.n >= 20")
def _(spark, d):
    m, e = fx.moncube(spark, d), fx.mon_epochs(spark, d)
    p = solve.predict(solve.lsqr(m, e, _LINEAR), e, _LINEAR)
    return p.select("row", "col", "k", F.round("full", 3).alias("full"), F.round("sigma", 6).alias("sigma"))


@query("residual_std", _LINE + " SELECT row, col, round(stddev_pop(d - m0 - m1 * t), 4) AS sd FROM o JOIN f USING (row, col) WHERE n >= 20 GROUP BY 1, 2")
def _(spark, d):
    m, e = fx.moncube(spark, d), fx.mon_epochs(spark, d)
    r = solve.residuals(m, solve.lsqr(m, e, _LINEAR), e, _LINEAR)
    return r.groupBy("row", "col").agg(F.round(F.stddev_pop("res"), 4).alias("sd"))


@query("outlier_iterate", _LINE.replace("f AS (", "f0 AS (") + """, r AS (SELECT row, col, o.d, o.w, o.t, o.d - m0 - m1 * o.t AS res FROM o JOIN f0 USING (row, col) WHERE n >= 20),
q AS (SELECT *, stddev_pop(res) OVER (PARTITION BY row, col) AS sd FROM r), k AS (SELECT * FROM q WHERE abs(res) <= 2 * sd),
s2 AS (SELECT row, col, count(*) AS n, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * d) AS y0, sum(w * t * d) AS y1 FROM k GROUP BY 1, 2)
SELECT row, col, n, round(CASE WHEN n >= 20 THEN (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) END, 4) AS m0, round(CASE WHEN n >= 20 THEN (s0 * y1 - s1 * y0) / (s0 * s2 - s1 * s1) END, 4) AS m1 FROM s2""")
def _(spark, d):
    fits, _ = solve.iterate(fx.moncube(spark, d), fx.mon_epochs(spark, d), _LINEAR, 2.0, 2)
    return fits.select("row", "col", "n", F.round(F.col("m")[0], 4).alias("m0"), F.round(F.col("m")[1], 4).alias("m1"))


@query("inversion_masked", _LINE + """, p AS (SELECT row, col, e.k, CASE WHEN row % 2 = 0 THEN m0 + m1 * (tdec - 1998.0::DOUBLE) ELSE 0 END AS v, n FROM f, mone e )
SELECT row, col, k, round(v, 3) AS secular FROM p WHERE n >= 20 OR row % 2 = 1""")
def _(spark, d):
    m, e = fx.moncube(spark, d), fx.mon_epochs(spark, d)
    out = solve.inversion(m, e, e, _LINEAR, mask=m.where("row % 2 = 0").select("row", "col").distinct())
    return out["parts"].select("row", "col", "k", F.round("secular", 3).alias("secular"))


@query("detrend", _LINE + " SELECT m.row, m.col, m.k, round(m.val - (m0 + m1 * (tdec - 1998.0::DOUBLE)), 3) AS val FROM mon m JOIN mone USING (k) JOIN f ON f.row = m.row AND f.col = m.col WHERE n >= 20")
def _(spark, d):
    m, e = fx.moncube(spark, d), fx.mon_epochs(spark, d)
    out = solve.detrend(m, solve.lsqr(m, e, _LINEAR), e, _LINEAR, ("secular",))
    return out.select("row", "col", "k", F.round("val", 3).alias("val"))


_SEASON = timefn.Collection([timefn.Constant(), timefn.Linear(tref=1998.0), *timefn.periodic(1998.0, 1.0)])


@query("seasonal_amplitude_phase")
def _(spark, d):
    f = solve.lsqr(fx.moncube(spark, d), fx.mon_epochs(spark, d), _SEASON).where("status = 0")
    amp, phase = solve.amp_phase(F.col("m")[2], F.col("m")[3])
    return f.select("row", "col", F.round(amp, 4).alias("amp"), F.round(phase, 4).alias("phase"))


@query("fit_lasso")
def _(spark, d):
    return solve.lasso(fx.pixstack(spark, d), fx.pix_epochs(spark, d), timefn.Collection([timefn.Constant(), *timefn.ispline_set(2024.0, 2024.1, 6)]), 5.0).select("row", "col", "status", "m")


@query("fit_omp")
def _(spark, d):
    return solve.omp(fx.moncube(spark, d), fx.mon_epochs(spark, d), _SEASON, 2).select("row", "col", "status", "m")


@query("fit_ransac")
def _(spark, d):
    return solve.ransac(fx.moncube(spark, d), fx.mon_epochs(spark, d), _LINEAR)


@query("butterworth_split")
def _(spark, d):
    return r6(solve.butterworth(fx.moncube(spark, d), 0.5, 1 / 12), "long", "short")


@query("reweighting", with_("grid") + ", a AS (SELECT row, list(val ORDER BY col) AS m FROM grid GROUP BY row), s AS (SELECT row, m, list_sum(list_transform(m, lambda x: abs(x))) + 64 * 1e-4::DOUBLE AS t FROM a) SELECT row, round(list_sum(list_transform(m, lambda x: ln(t / (abs(x) + 1e-4::DOUBLE)))), 5) AS w FROM s")
def _(spark, d):
    a = fx.grid(spark, d).cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "val"))), lambda x: x["val"]).alias("m"))
    return a.select("row", F.round(F.aggregate(solve.reweight_columns("m", "log"), F.lit(0.0), lambda s, x: s + x), 5).alias("w"))


@query("magnitude_rank", with_("mon") + " SELECT row, col, k, CAST(row_number() OVER (PARTITION BY row, col ORDER BY abs(val) DESC, k) AS INT) AS rank FROM mon")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row", "col").orderBy(F.abs("val").desc(), "k")
    return fx.moncube(spark, d).select("row", "col", "k", F.row_number().over(w).alias("rank"))


# --- offsets


@query("ncc_integer_offset", with_("grid", "hdr") + """, t AS (SELECT cy, cx, i, j, g.val AS b FROM (SELECT CAST(unnest(range(0, (ny - 18) // 16 + 1)) AS INT) AS cy FROM hdr), (SELECT CAST(unnest(range(0, 3)) AS INT) AS cx), (SELECT CAST(unnest(range(0, 12)) AS INT) AS i), (SELECT CAST(unnest(range(0, 12)) AS INT) AS j), grid g WHERE g.row = 3 + cy * 16 + i + 1 AND g.col = 3 + cx * 16 + j + 2),
s AS (SELECT cy, cx, dy, dx, sum(a.val * b) AS ab, sum(a.val * a.val) AS aa, sum(b * b) AS bb FROM t, (SELECT CAST(unnest(range(-3, 4)) AS INT) AS dy), (SELECT CAST(unnest(range(-3, 4)) AS INT) AS dx), grid a WHERE a.row = cy * 16 + 3 + i + dy AND a.col = cx * 16 + 3 + j + dx GROUP BY 1, 2, 3, 4),
c AS (SELECT *, ab / sqrt(aa * bb) AS corr FROM s)
SELECT cy, cx, arg_min(dy, struct_pack(c := -corr, dy := dy, dx := dx)) AS dy, arg_min(dx, struct_pack(c := -corr, dy := dy, dx := dx)) AS dx, round(max(corr) / median(abs(corr)), 5) AS snr FROM c GROUP BY 1, 2""")
def _(spark, d):
    g = fx.grid(spark, d)
    sec = g.cells.select((F.col("row") - 1).alias("row"), (F.col("col") - 2).alias("col"), "val").where("row >= 0 and col >= 0")
    p = offsets.peaks(offsets.ncc(g.cells, sec, 12, 3, 16, g.header.ny, 64))
    return p.select("cy", "cx", "dy", "dx", F.round("snr", 5).alias("snr"))


@query("offset_map_dft")
def _(spark, d):
    g = fx.grid(spark, d)
    sec = g.cells.select((F.col("row") + 1).alias("row"), (F.col("col") - 2).alias("col"), "val").where("col >= 0")
    return offsets.offset_map(g.cells, sec, 16, 16, g.header.ny, 64)


# --- profiles

_ALPHA = """w AS (SELECT i, x, h, b, u, b + h AS s, x - lag(x) OVER o AS a, lead(x) OVER o - x AS c, lag(b + h) OVER o AS sm, lead(b + h) OVER o AS sp, lead(x, 2) OVER o - lead(x) OVER o AS c2, lag(x) OVER o - lag(x, 2) OVER o AS a2, lead(b + h, 2) OVER o AS sp2, lag(b + h, 2) OVER o AS sm2, row_number() OVER o AS n, count(*) OVER () AS cnt FROM prof WINDOW o AS (ORDER BY x)),
p AS (SELECT i, x, h, b, u, s, -(CASE WHEN n = 1 THEN -(2 * c + c2) / (c * (c + c2)) * s + (c + c2) / (c * c2) * sp - c / (c2 * (c + c2)) * sp2 WHEN n = cnt THEN a / (a2 * (a + a2)) * sm2 - (a + a2) / (a * a2) * sm + (2 * a + a2) / (a * (a + a2)) * s ELSE (a * a * sp + (c * c - a * a) * s - c * c * sm) / (a * c * (a + c)) END) AS alpha FROM w)"""


@query("profile_derived", with_("prof") + f", {_ALPHA} SELECT i, round(s, 6) AS s, round(alpha, 8) AS alpha, round(-b, 6) AS depth, round(-b / h, 6) AS depth_ratio, round(1024.0::DOUBLE / 917.0::DOUBLE * (-b / h), 6) AS pwpi, round(b + h * 917.0::DOUBLE / 1024.0::DOUBLE, 6) AS haf FROM p")
def _(spark, d):
    p = sim.derived(fx.profile(spark, d))
    return r6(p.select("i", "s", F.round("alpha", 8).alias("alpha"), "depth", "depth_ratio", "pwpi", "haf"), "s", "depth", "depth_ratio", "pwpi", "haf")


@query("profile_grounded", with_("prof") + f", {_ALPHA} SELECT i, round(alpha, 8) AS alpha FROM p WHERE 917.0::DOUBLE * h - 1024.0::DOUBLE * -b > 700000")
def _(spark, d):
    return sim.subset_grounded(fx.profile(spark, d), 700000.0).select("i", F.round("alpha", 8).alias("alpha"))


@query("lateral_shear_velocities")
def _(spark, d):
    return sim.wave_speeds(sim.lateral(sim.derived(fx.profile(spark, d)), -10.0, 2000.0)).select("i", "u_s", "c", "d", "vk", "pe")


@query("basal_sliding_velocities")
def _(spark, d):
    return sim.wave_speeds(sim.basal(sim.derived(fx.profile(spark, d)).where("alpha > 0"), 1e-3)).select("i", "u_s", "c", "d", "vk", "pe")


@query("calving_force", with_("scat") + " SELECT id, round((0.2::DOUBLE * sin(2 * pi() / 1.0 * (x / 1000)) + 1) * 1e-16::DOUBLE * pow(0.25::DOUBLE * 917.0::DOUBLE * 9.80665::DOUBLE * (y / 10) * (1 - 917.0::DOUBLE / 1024.0::DOUBLE), 3), 6) AS f FROM scat")
def _(spark, d):
    return r6(fx.scatter(spark, d).select("id", sim.calving_force(F.col("x") / 1000, F.col("y") / 10, 1e-16, "periodic").alias("f")), "f")


@query("synthetic_bed", "SELECT CAST(i AS INT) AS i, round(CASE WHEN i * 1000.0::DOUBLE >= 120000 THEN -500 ELSE (-500.0::DOUBLE - 300) / 120000 * (i * 1000.0::DOUBLE) + 300 END, 6) AS b FROM range(0, 150) r(i)")
def _(spark, d):
    return r6(spark.range(150).select(F.col("id").cast("int").alias("i"), sim.sloping_bed(F.col("id") * 1000.0, 0.0).alias("b")), "b")


@query("quadratic_roots", with_("scat") + ", q AS (SELECT id, x / 100 - 40 AS b, y / 100 - 20 AS c FROM scat), d AS (SELECT *, b * b - 4 * 2 * c AS disc FROM q) SELECT id, round(CASE WHEN disc < 0 THEN NULL WHEN abs((-b + sqrt(greatest(disc, 0))) / 4) <= abs((-b - sqrt(greatest(disc, 0))) / 4) THEN (-b + sqrt(greatest(disc, 0))) / 4 ELSE (-b - sqrt(greatest(disc, 0))) / 4 END, 6) AS root FROM d")
def _(spark, d):
    return r6(fx.scatter(spark, d).select("id", sim.quadratic_root(F.lit(2.0), F.col("x") / 100 - 40, F.col("y") / 100 - 20).alias("root")), "root")


@query("flow_residual")
def _(spark, d):
    return sim.residual(fx.profile(spark, d), 1e-16, 1e3, 1e-3)


@query("grid_refinement")
def _(spark, d):
    return sim.refine(fx.profile(spark, d), 1.5)


@query("profile_coordinates_updated")
def _(spark, d):
    import numpy as np

    p = fx.profile(spark, d)
    ends = p.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    return r6(sim.update_coordinates(p, np.linspace(ends["a"], ends["b"], 333)), "x", "h", "b", "u")


def _tongue(spark, d, slope: float) -> DataFrame:
    """A profile whose height above flotation falls through zero near its front."""
    return fx.profile(spark, d).select("i", (F.col("i") * 100.0).alias("x"), (500.0 - slope * F.col("i")).alias("h"), (-300.0 - 0.1 * F.col("i")).alias("b"), "u")


@query("terminus_advanced")
def _(spark, d):
    n = spark.read.parquet(f"{d}/supplier.parquet").count()
    return r6(sim.advance_terminus(_tongue(spark, d, 80.0 / n)), "x", "h", "b", "u")


@query("terminus_retreated")
def _(spark, d):
    n = spark.read.parquet(f"{d}/supplier.parquet").count()
    return r6(sim.retreat_terminus(_tongue(spark, d, 300.0 / n)), "x", "h", "b", "u")


@query("flow_ensemble")
def _(spark, d):
    p = fx.profile(spark, d).agg(F.array_sort(F.collect_list(F.struct("x", "h", "b", "u"))).alias("n"))
    rows = p.select(*(F.col(f"n.{c}").alias(n) for c, n in (("x", "x"), ("h", "h"), ("b", "b"), ("u", "u0"))))
    return rows.crossJoin(spark.range(4)).select("id", F.lit(1e-16).alias("a"), (1e3 * (F.col("id") + 1)).alias("cb"), F.lit(1e-3).alias("fs"), "x", "h", "b", "u0").transform(sim.ensemble)


# --- text sources, set operations


@query("annotation_parse", "SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS key, 'm' AS unit, CAST(s_suppkey * 2 AS VARCHAR) AS value FROM supplier")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return text.annotations(s.select(F.concat(F.lit("  k"), F.col("s_suppkey"), F.lit(" (m) = "), (F.col("s_suppkey") * 2).cast("string"), F.lit("  ; a comment")).alias("value")))


@query("kml_parse", "SELECT s_suppkey AS id, CAST(p AS INT) AS seq, CAST(s_suppkey + p AS DOUBLE) AS x, 0.5::DOUBLE * p AS y FROM supplier, range(0, 3) r(p)")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    points = F.concat_ws(" ", *(F.concat_ws(",", (F.col("id") + p).cast("string"), F.lit(str(0.5 * p)), F.lit("0")) for p in range(3)))
    return text.kml(s.select("id", F.concat(F.lit("<kml><coordinates>9,9</coordinates><coordinates> "), points, F.lit(" </coordinates></kml>")).alias("text")))


@query("segments_parse", "SELECT CAST(s_suppkey AS VARCHAR) AS file, CAST(p AS INT) AS seq, CAST(s_suppkey * p AS DOUBLE) AS x, CAST(p AS DOUBLE) AS y FROM supplier, range(0, 2) r(p)")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("file"), F.col("s_suppkey").alias("k"))
    lines = s.select("file", F.posexplode(F.array(F.lit("> other"), F.lit("9 9"), F.lit("> my front 2001"), F.concat_ws(" ", F.lit("0"), F.lit("0")), F.concat_ws(" ", F.col("k").cast("string"), F.lit("1")), F.lit("> my front 2002"), F.lit("7 7"))).alias("n", "value"))
    return text.segments(lines, "front")


@query("unique_rows", with_("grid") + " SELECT DISTINCT CAST(floor(val * 10) AS INT) AS a, col % 4 AS b FROM grid")
def _(spark, d):
    return fx.grid(spark, d).cells.select(F.floor(F.col("val") * 10).cast("int").alias("a"), (F.col("col") % 4).alias("b")).distinct()


@query("set_difference_xor", with_("mon") + ", a AS (SELECT DISTINCT k FROM mon WHERE row < 3), b AS (SELECT DISTINCT k FROM mon WHERE row >= 3 AND k % 2 = 0) SELECT k, 'diff' AS what FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'xor' FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))")
def _(spark, d):
    m = fx.moncube(spark, d)
    a, b = m.where("row < 3").select("k").distinct(), m.where("row >= 3 and k % 2 = 0").select("k").distinct()
    diff = a.exceptAll(b)
    return diff.withColumn("what", F.lit("diff")).unionByName(diff.unionByName(b.exceptAll(a)).withColumn("what", F.lit("xor")))
