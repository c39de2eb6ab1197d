"""NumPy goldens and properties, each with a wrong variant that must differ."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs, dates, timefn
from gridloom.header import Header
from gridloom.operators import boundary, fill, interp, offsets, raster, sim, solve, stencil
from gridloom.operators.raster import Raster


def cells(spark, a):
    rows = [(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return Raster(spark.createDataFrame(rows, "row int, col int, val double"), Header(0.0, 0.0, 2.0, -3.0, a.shape[1], a.shape[0]))


def dense(df, shape, value="val"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(0).normal(size=(12, 15))


def test_gradient(spark, a):
    g = stencil.gradients(cells(spark, a))
    want = np.gradient(a, -3.0, 2.0, edge_order=2)
    assert np.allclose(dense(g, a.shape, "dval_dy"), want[0]) and np.allclose(dense(g, a.shape, "dval_dx"), want[1])
    assert not np.allclose(want[1], np.gradient(a, 2.0, axis=1))


def test_triangular_smooth(spark, a):
    k = np.array(stencil.triangular_kernel(2))
    p = np.pad(a, 2, mode="symmetric")
    want = sum(k[i] * k[j] * p[i : i + 12, j : j + 15] for i in range(5) for j in range(5))
    assert np.allclose(dense(stencil.triangular_smooth(cells(spark, a), 2).cells, a.shape), want)


def test_savgol_exact_on_polynomials(spark):
    y, x = np.mgrid[0:14, 0:14].astype(float)
    dy, dx = stencil.savgol_gradient(cells(spark, x**2 + 3 * x * y), 5, 3)
    inner = np.s_[2:-2, 2:-2]
    assert np.allclose(dense(dx.cells, x.shape)[inner], ((2 * x + 3 * y) / 2)[inner])
    assert np.allclose(dense(dy.cells, x.shape)[inner], (3 * x / -3)[inner])
    with pytest.raises(ValueError):
        stencil.savgol_kernels(3, 4)


def test_interpolation_orders(spark, a):
    r = cells(spark, a)
    t = spark.createDataFrame([(0, 5.3, -7.1)], "i int, x double, y double")
    got = {o: interp.interpolate(r, t, ["i"], o).first()["val"] for o in range(4)}
    c, w = 5.3 / 2, 7.1 / 3
    assert got[0] == pytest.approx(a[round(w), round(c)])
    fy, fx = w - 2, c - 2
    assert got[1] == pytest.approx((1 - fy) * ((1 - fx) * a[2, 2] + fx * a[2, 3]) + fy * ((1 - fx) * a[3, 2] + fx * a[3, 3]))
    const = cells(spark, np.full((12, 15), 4.0))
    assert all(interp.interpolate(const, t, ["i"], o).first()["val"] == pytest.approx(4.0) for o in range(4))
    out = spark.createDataFrame([(0, 500.0, 0.0)], "i int, x double, y double")
    assert interp.interpolate(r, out, ["i"], 1).first()["val"] == 0.0
    assert interp.interpolate(r, out, ["i"], 1, "nearest").first()["val"] == pytest.approx(a[0, 14])


def test_headers(spark, a):
    h = Header(0.0, 0.0, 2.0, -3.0, 15, 12, epsg=3413)
    assert h == Header(0.0, 1e-9, 2.0, -3.0, 15, 12) and h != Header(0.0, 0.0, 2.0, -3.0, 15, 12, units="km")
    assert h.subset_bounds(-100.0, 0.0, 4.0, -6.0) == (0, 12, 0, 15)
    assert h.crop_bounds(2.0, 6.0, -9.0, -3.0) == (1, 4, 1, 4)
    assert h.convert("km").units == "km" and h.convert("km").dx == 0.002
    half = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double").select(h.col_of(F.col("x")).alias("c"))
    assert [r["c"] for r in half.collect()] == [0, 2, 2]
    with pytest.raises(ValueError):
        cells(spark, a) + Raster(cells(spark, a).cells, h.window(0, 3, 0, 3))


def test_pad_then_crop_is_identity(spark, a):
    r = raster.pad(cells(spark, a), 3, "reflect")
    assert np.allclose(dense(r.cells, (18, 21)), np.pad(a, 3, mode="reflect"))
    assert np.allclose(dense(r.window(3, 15, 3, 18).cells, a.shape), a)


def test_inpaint_and_holes(spark):
    y, x = np.mgrid[0:9, 0:9].astype(float)
    a = x + 2 * y
    a[2:5, 3:6] = np.nan
    a[7, 7] = np.nan
    got = dense(fill.inpaint(cells(spark, a)).cells, a.shape)
    assert np.allclose(got, x + 2 * y)
    assert fill.holes(cells(spark, a)).select("hole").distinct().count() == 2


def test_robust_gradient_ignores_a_spike(spark):
    y, x = np.mgrid[0:15, 0:15].astype(float)
    a = 2 * x - y
    a[7, 7] = 500.0
    g = fill.robust_gradient(cells(spark, a), 7, 1, "ils")
    assert dense(g, a.shape, "dx")[7, 6] == pytest.approx(1.0, abs=1e-6)
    assert abs(dense(fill.robust_gradient(cells(spark, a), 7, 1, "lsq"), a.shape, "dx")[7, 6] - 1.0) > 0.1


def test_timefn_identities(spark):
    t = spark.range(200).select((F.col("id") / 20.0 + 2000.0).alias("t"))
    unity = sum((f.column(F.col("t")) for f in timefn.bspline_set(1995.0, 2015.0, 21)), F.lit(0.0))
    i = timefn.ISpline(tref=2005.0, scale=1.0)
    slope = (i.column(F.col("t") + 1e-4) - i.column(F.col("t") - 1e-4)) / 2e-4
    for r in t.select(unity.alias("u"), slope.alias("s"), timefn.BSpline(tref=2005.0, scale=1.0).column(F.col("t")).alias("b")).collect():
        assert r["u"] == pytest.approx(1.0, abs=1e-9) and r["s"] == pytest.approx(r["b"], abs=1e-5)


def test_parser_round_trip():
    c = timefn.parse("[poly(tref=2000,order=2); cos(tref=2000,period=0.5); geolog(tref=2001,side=right)]")
    assert str(timefn.parse(str(c))) == str(c) and len(c) == 5
    assert c.partitions()["secular"] == [0, 1, 2] and c.partitions()["transient"] == [4]
    with pytest.raises(ValueError):
        c.append(timefn.Constant())
    with pytest.raises(ValueError):
        timefn.parse("[nothing(x=1)]")


def series(spark, f, n=120):
    t = np.linspace(2000, 2010, n)
    obs = spark.createDataFrame([(0, 0, k, float(v)) for k, v in enumerate(f(t))], "row int, col int, k int, val double")
    return obs, spark.createDataFrame([(k, float(x)) for k, x in enumerate(t)], "k int, tdec double")


def test_decomposition_recovers_parts(spark):
    model = timefn.Collection([timefn.Constant(), timefn.Linear(tref=2000.0), *timefn.periodic(2000.0, 1.0)])
    obs, e = series(spark, lambda t: -3 + (t - 2000) + 2 * np.cos(2 * np.pi * (t - 2000)))
    fit = solve.lsqr(obs, e, model).first()
    assert np.allclose(fit["m"], [-3, 1, 2, 0], atol=1e-9)
    p = solve.predict(solve.lsqr(obs, e, model), e, model).where("k = 0").first()
    assert p["secular"] == pytest.approx(-3) and p["seasonal"] == pytest.approx(2)
    assert solve.lsqr(obs, e, model, n_min=500).first()["status"] == 1


def test_outliers_go(spark):
    model = timefn.Collection([timefn.Constant(), timefn.Linear(tref=2000.0)])
    f = lambda t: np.where(np.arange(len(t)) == 50, 100.0, t - 2000)
    obs, e = series(spark, f)
    fits, clean = solve.iterate(obs, e, model, 3.0, 4)
    assert np.allclose(fits.first()["m"], [0, 1], atol=1e-6) and clean.where("val is null").count() == 1
    m = solve.ransac(obs, e, model).first()
    assert np.allclose(m["m"], [0, 1], atol=1e-6) and m["inliers"] >= 100


def test_lasso_kkt_and_limit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    d = x[:, 0] * 3 - x[:, 4] * 2 + rng.normal(size=60) * 0.01
    a, b = x.T @ x, x.T @ d
    for lam in (5.0, 0.0):
        m = solve._lasso_one(a, b, np.full(8, lam))
        g = b - a @ m
        assert np.all(np.abs(g) <= lam + 1e-4) and np.allclose(g[np.abs(m) > 1e-9], lam * np.sign(m[np.abs(m) > 1e-9]), atol=1e-4)
    assert np.allclose(solve._lasso_one(a, b, np.zeros(8)), np.linalg.lstsq(x, d, rcond=None)[0], atol=1e-6)
    assert set(solve.best_basis(a, b, d @ d, np.linalg.lstsq(x, d, rcond=None)[0])) == {0, 4}


def test_butterworth_keeps_slow_and_drops_fast(spark):
    obs, _ = series(spark, lambda t: np.sin(2 * np.pi * t / 10) + np.sin(2 * np.pi * t * 4), 400)
    out = solve.butterworth(obs, 0.5, 10 / 399).orderBy("k").toPandas()
    t = np.linspace(2000, 2010, 400)
    assert np.abs(out["long"] - np.sin(2 * np.pi * t / 10))[40:-40].max() < 0.05


def test_offsets(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(64, 64))
    b = np.roll(a, (2, -3), (0, 1))
    assert offsets.register(a, b)[:2] == pytest.approx((2, -3), abs=0.05)
    assert offsets.phase_ramp(a, b) == pytest.approx((2, -3), abs=0.1)
    p = offsets.peaks(offsets.ncc(cells(spark, a).cells, cells(spark, b).cells, 16, 4, 20, 64, 64)).collect()
    assert p and all((r["dy"], r["dx"]) == (-2, 3) for r in p)


def test_sim_residual_and_jacobian(spark):
    x = np.cumsum(np.random.default_rng(3).uniform(800, 1200, 20))
    h, b, u = 900 - 0.002 * x, -0.001 * x, 100 + 0.01 * x
    d = sim.difference_matrix(x)
    assert np.allclose(d @ x**2, 2 * x)
    args = (d, h, -d @ (h + b), 1e-16, 1e3, 1e-3)
    j = sim.jacobian(u, *args)
    num = np.column_stack([(sim.pde(u + e, *args) - sim.pde(u - e, *args)) / 2e-4 for e in np.eye(20) * 1e-4])
    assert np.allclose(j, num, rtol=1e-3, atol=1e-3 * np.abs(j).max())
    p = spark.createDataFrame([(i, float(a), float(c), float(e), float(v)) for i, (a, c, e, v) in enumerate(zip(x, h, b, u))], "i int, x double, h double, b double, u double")
    got = [r["f"] for r in sim.residual(p, 1e-16, 1e3, 1e-3).where("part = 'pde'").orderBy("i").collect()]
    assert np.allclose(got, sim.pde(u, *args)[:-2], rtol=1e-6)


def test_ransac_solves_batches_with_the_draws_of_choice(spark):
    for n, size in ((10, 10), (20, 10), (84, 10), (600, 3)):
        a, b = (np.random.default_rng([5, n]) for _ in range(2))
        assert np.array_equal(solve._draws_at_once(a, n, size, 40), np.stack([b.choice(n, size, replace=False) for _ in range(40)]))
    k, r = np.arange(40), np.random.default_rng(1)
    d = 2.0 + 0.5 * k + r.standard_normal(40) * 0.1 + np.where(k % 7 == 0, 30.0, 0.0)
    model = timefn.Collection([timefn.Constant(), timefn.Linear(tref=0.0)])
    obs = spark.createDataFrame([(p, 1, int(i), float(v)) for p in (2, 3) for i, v in zip(k, d) if p == 2 or i < 12], "row int, col int, k int, val double")
    epochs = spark.createDataFrame([(int(i), float(i)) for i in k], "k int, tdec double")
    x, limit, best = np.column_stack([np.ones(40), k]), np.median(np.abs(d - np.median(d))), np.zeros(40, bool)
    rng = np.random.default_rng([0, 2, 1])
    for _ in range(100):
        s = rng.choice(40, 10, replace=False)
        inside = np.abs(d - x @ np.linalg.lstsq(x[s], d[s], rcond=None)[0]) <= limit
        best = inside if inside.sum() > best.sum() else best
    fits = solve.ransac(obs, epochs, model)
    assert "FlatMapGroupsInPandas" not in fits._jdf.queryExecution().executedPlan().toString()
    got = {r["row"]: r for r in fits.collect()}
    assert np.allclose(got[2]["m"], np.linalg.lstsq(x[best], d[best], rcond=None)[0]) and (got[2]["status"], got[2]["n"], got[2]["inliers"]) == (0, 40, best.sum())
    assert (got[3]["status"], got[3]["n"], got[3]["m"], got[3]["inliers"]) == (1, 12, None, 0)
    same = np.stack([np.column_stack([np.ones(10), np.zeros(10)])] * 2)  # a function that is not met: the least norm
    assert np.allclose(solve.stacked_lstsq(same, np.full((2, 10), 3.0)), [3.0, 0.0])


def test_butterworth_filters_pixels_of_a_length_together(spark):
    lengths, r = {0: 1, 1: 2, 2: 9, 3: 60, 4: 60}, np.random.default_rng(2)
    rows = [(p, 0, i * 2, float(r.standard_normal())) for p, n in lengths.items() for i in range(n)]
    out = solve.butterworth(spark.createDataFrame(rows[::-1] + [(3, 0, 1, None)], "row int, col int, k int, val double"), 0.5, 1 / 12)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas().sort_values(["row", "k"])
    b, a = solve.butterworth_coeffs(0.5, 1 / 12)
    for p, n in lengths.items():
        x = np.array([v for row, _, _, v in rows if row == p])
        y = x if n == 1 else solve._filtfilt(b, a, x[None])[0]
        q = got[got["row"] == p]
        assert q["k"].tolist() == [2 * i for i in range(n)] and np.allclose(q["long"], y) and np.allclose(q["short"], x - y)


def test_sim_banded_steps_equal_dense_ones():
    for n in (8, 33, 100):
        r = np.random.default_rng(n)
        x = np.cumsum(r.uniform(800, 1200, n))
        h, b, u = 900 + 50 * r.standard_normal(n), -0.001 * x, 100 + 0.01 * x + r.standard_normal(n)
        d, few = sim.difference_matrix(x), sim.Differences(x)
        args, same = ((k, h, -(k @ (h + b)), 1e-16, 1e3, 1e-3) for k in (d, few))
        j, y, (first, values) = sim.jacobian(u, *args), sim.pde(u, *args), sim.banded_jacobian(u, *same)
        full = np.zeros_like(j)
        np.put_along_axis(full, first[:, None] + np.arange(5), values, 1)
        assert np.allclose(full, j, rtol=1e-9, atol=1e-12 * np.abs(j).max()) and np.allclose(sim.pde(u, *same), y, rtol=1e-9, atol=1e-12 * np.abs(y).max())
        want = np.linalg.lstsq(j, y, rcond=None)[0]
        assert np.allclose(sim.banded_lstsq(first, values, y, n), want, rtol=1e-6, atol=1e-8 * np.abs(want).max())


def test_sim_ensemble_of_many_nodes_and_a_task_a_scenario(spark):
    n = 4000
    x = np.arange(n) * 1000.0
    h, b, u = 900 - 1e-5 * x, -1e-5 * x, 100 + 1e-4 * x
    rows = spark.createDataFrame([(x.tolist(), h.tolist(), b.tolist(), u.tolist())], "x array<double>, h array<double>, b array<double>, u0 array<double>")
    # the dense step took 8 x n² bytes and n³ operations
    out = sim.ensemble(rows.coalesce(1).crossJoin(spark.range(4)).selectExpr("id", "1e-16D a", "1e3D cb", "1e-3D fs", "x", "h", "b", "u0"), n_iter=3)
    got = out.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("id").alias("scenarios"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(r["scenarios"] == 1 and r["n"] == n for r in got)


def test_interpolation_meets_one_row_a_target(spark):
    a = np.random.default_rng(4).standard_normal((37, 21))
    a[5, 6] = np.nan
    h = Header(0.0, 0.0, 1.0, 1.0, 21, 37)
    src = Raster(cells(spark, a).cells.where("val is not null and not (row = 20 and col = 3)"), h)
    points = [(0, 3.3, 4.4), (1, -9.5, 50.2), (2, 15.5, 16.5), (3, 5.7, 5.2), (4, 20.0, 36.0), (5, 3.1, 19.9), (6, 16.0, 32.0)]
    targets = spark.createDataFrame(points, "id int, x double, y double")
    out = interp.interpolate(src, targets, ["id"], 3, "nearest")
    # 16 rows a target were joined and summed by it
    assert "Aggregate [id#" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == len(points)
    weight = lambda f: np.array([(1 - f) ** 3, 4 - 6 * f**2 + 3 * f**3, 1 + 3 * f + 3 * f**2 - 3 * f**3, f**3]) / 6
    a[20, 3] = np.nan
    for row in out.collect():
        (i, f), (j, g) = ((int(np.floor(t)), t - np.floor(t)) for t in (row["y"], row["x"]))
        w = np.outer(weight(f), weight(g))
        v = a[np.ix_(np.clip(np.arange(i - 1, i + 3), 0, 36), np.clip(np.arange(j - 1, j + 3), 0, 20))]
        want = (w * v)[w != 0].sum()
        assert row["val"] == pytest.approx(want) if np.isfinite(want) else row["val"] is None


def test_ncc_shuffles_cells_and_not_their_shifts(spark):
    r = np.random.default_rng(6)
    a, b = r.standard_normal((12, 12)), r.standard_normal((12, 12))
    a[3, 4] = b[5, 5] = np.nan
    out = offsets.ncc(cells(spark, a).cells, cells(spark, b).cells.where("row != 6 or col != 6"), 6, 2, 5, 12, 12)
    assert "sequence(-2, 2" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["cy"], r["cx"], r["dy"], r["dx"]): r["corr"] for r in out.collect()}
    assert len(got) == 25
    there = np.ones((12, 12), bool)
    there[6, 6] = False
    for (cy, cx, dy, dx), corr in got.items():
        t, s = (slice(2, 8), slice(2, 8)), (slice(2 + dy, 8 + dy), slice(2 + dx, 8 + dx))
        x, y = a[s][there[t]], b[t][there[t]]
        assert (cy, cx) == (0, 0) and corr == pytest.approx(np.nansum(x * y) / np.sqrt(np.nansum(x * x) * np.nansum(y * y)))


def test_griddata_joins_a_place_once(spark):
    points = spark.createDataFrame([(i, float(i % 3) * 10, 5.0, float(i)) for i in range(3000)], "id bigint, x double, y double, z double")
    out = interp.nearest_griddata(points, Header(0.0, 0.0, 10.0, 10.0, 3, 1), 10.0).cells
    assert {r["col"]: r["val"] for r in out.collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_inpaint_fills_single_cells_without_a_group_each(spark, monkeypatch):
    a = np.random.default_rng(9).standard_normal((7, 6))
    a[0, 0] = a[3, 3] = a[6, 2] = np.nan
    want = fill._springs({(i, j): None if np.isnan(v) else float(v) for (i, j), v in np.ndenumerate(a)}, Header(0.0, 0.0, 2.0, -3.0, 6, 7))

    def no_group(cells, h):
        raise AssertionError("a hole of one cell came as a group")

    monkeypatch.setattr(fill, "_springs", no_group)
    got = dense(fill.inpaint(cells(spark, a)).cells, a.shape)
    assert not np.isnan(got).any() and all(got[at] == pytest.approx(v) for at, v in want.items())
    assert got[3, 3] == pytest.approx((a[2, 3] + a[4, 3] + a[3, 2] + a[3, 4]) / 4)
    assert dense(fill.inpaint(cells(spark, np.array([[np.nan]]))).cells, (1, 1))[0, 0] == 0.0


@pytest.mark.parametrize("method", ("ils", "irls", "lsq"))
def test_robust_gradient_of_tiles_equals_single_windows(spark, method):
    r = np.random.default_rng(8)
    a = r.standard_normal((35, 34))
    a[r.random(a.shape) < 0.3], a[10:22, 8:20] = np.nan, np.nan
    a[4, 4] = 60.0
    out = fill.robust_gradient(cells(spark, a), 5, 1, method)
    # a cell was sent to 25 windows
    assert "sequence(-2, 2" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, padded = {(q["row"], q["col"]): q for q in out.collect()}, np.pad(a, 2, "edge")
    for i in range(35):
        for j in range(34):
            w = padded[i : i + 5, j : j + 5]
            y, x = np.nonzero(~np.isnan(w))
            if not len(y):
                assert (i, j) not in got
            elif len(y) < 3:
                assert got[i, j]["fit"] is None
            else:
                m = fill.robust_fit(np.column_stack([np.ones(len(y)), x - 2.0, y - 2.0]), w[y, x], method)
                assert np.allclose([got[i, j]["fit"], got[i, j]["dx"] * 2.0, got[i, j]["dy"] * -3.0], m, atol=1e-6)


def test_dates(spark):
    ts = datetime.datetime(2023, 7, 2, 12, 0, 0)
    row = spark.createDataFrame([(ts, 59000)], "ts timestamp, mjd int").select(dates.to_decimal_year(F.col("ts")).alias("t"), dates.mjd_to_date(F.col("mjd")).alias("d")).select("t", "d", dates.from_decimal_year(F.col("t") + 1e-9).alias("back")).first()
    assert row["t"] == pytest.approx(2023 + (182 + 0.5) / 365) and row["d"] == datetime.date(2020, 5, 31) and row["back"] == ts


def test_crs_round_trips(spark):
    p = spark.createDataFrame([(-49.8, 69.2), (10.0, 75.0)], "lon double, lat double")
    for code in (3413, 32622):
        x, y = crs.transform(F.col("lon"), F.col("lat"), 4326, code)
        q = p.select("lon", "lat", x.alias("x"), y.alias("y")).where("lon < 0 or " + str(code == 3413).lower())
        lon, lat = crs.transform(F.col("x"), F.col("y"), code, 4326)
        for r in q.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-6)
    with pytest.raises(ValueError):
        crs.transform(F.col("lon"), F.col("lat"), 4326, 2154)


def test_boundary(spark):
    sq = spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 3.0)], "seq int, x double, y double")
    assert [r["dist"] for r in stencil.path_length(sq).orderBy("seq").collect()] == [0.0, 4.0, 7.0]
    at = boundary.along(sq, 8).orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in at][::4] == [(0.0, 0.0), (4.0, 0.0)] and at[-1]["y"] == 3.0
    across = boundary.perpendicular_transects(sq, 8, 1.0, 3).where("i = 1").orderBy("j").collect()
    assert [(r["x"], r["y"]) for r in across] == [(1.0, 1.0), (1.0, 0.0), (1.0, -1.0)]


def test_plans_stay_in_the_jvm(spark):
    from gridloom.plans.queries import QUERIES

    for name in ("decompose_linear", "strain_rates", "triangular_smooth", "resample_order1", "stack_mean"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
    assert math.isfinite(1.0)


def test_spline_is_exact_on_cubics_and_finds_zeros():
    r = np.random.default_rng(3)
    x = np.sort(r.uniform(0, 10, 12))
    f = lambda t: 0.3 * t**3 - 2 * t**2 + t + 1
    s = sim.Spline(x, f(x))
    t = np.linspace(x[0] - 1, x[-1] + 1, 50)
    assert np.allclose(s(t), f(t)) and np.allclose(s(x), f(x))
    zeros = [z.real for z in np.roots([0.3, -2, 1, 1]) if abs(z.imag) < 1e-9 and x[0] <= z.real <= x[-1]]
    assert np.allclose(np.sort(s.roots()), np.sort(zeros))
    assert np.allclose(sim.Spline(x[:3], x[:3] ** 2)(t), t**2)


def test_termini_and_refinement():
    import pandas as pd

    x = np.arange(0, 4000.0, 100)
    q = pd.DataFrame({"x": x, "h": 500 - 0.06 * x, "b": -300 - 0.001 * x, "u": 100 + 0.002 * x})
    zero = (500 * sim.RHO_ICE / sim.RHO_WATER - 300) / (0.06 * sim.RHO_ICE / sim.RHO_WATER + 0.001)
    back = sim.retreated(q)
    assert np.isclose(back["x"].iloc[-1], zero) and zero < x[-1] and abs(back["x"].diff().iloc[1] - 100) < 6
    front = sim.advanced(q[q["x"] <= zero - 300].reset_index(drop=True))
    assert np.isclose(front["x"].iloc[-1], zero) and np.allclose(front["h"], 500 - 0.06 * front["x"])
    u = np.where(x < 2000, 100.0, 160.0)
    fine = sim.refined_coordinates(x, u, 5.0)
    step = np.diff(fine)
    assert set(x) <= set(fine) and step.min() >= 10 and step.min() < 30
    assert (np.diff(sim.Spline(x, u)(fine))[step > 20] <= 5).all()
    assert np.array_equal(sim.refined_coordinates(x, -u, 5.0), sim.refined_coordinates(x, -u, 5.0)) and sim.refined_coordinates(x, 0 * u).size == x.size
    with pytest.raises(ValueError):
        sim.moved(q, x + 5000)


def test_outliers_of_exact_pixels_are_none(spark):
    obs = spark.createDataFrame([(0, c, k, (7.0 if c else 3.0 + 0.1 * k), 1.0) for c in (0, 1) for k in range(40)], "row int, col int, k int, val double, wgt double")
    epochs = spark.createDataFrame([(k, 2000 + k / 12) for k in range(40)], "k int, tdec double")
    model = timefn.Collection([timefn.Constant(), timefn.Linear(tref=2000.0)])
    fits, clean = solve.iterate(obs, epochs, model, 2.0, 4)
    assert [r["n"] for r in fits.collect()] == [40, 40] and clean.where("val is null").count() == 0


def test_built_model_and_windows(spark):
    from gridloom.functions import builder

    m = builder.temporal_model(2000.0, 2004.0, degree=2, periods=(1.0,), steps=(2001.5,), isplines=(8, 4), bsplines=(5,), seasonal_spacing=0.5)
    assert len(m) == 3 + 2 + 1 + 5 + 9 + 12
    assert stencil.windows(500.0, (100.0, -90.0)) == (5, 7) and stencil.windows((400.0, 10.0), 100.0) == (5, 1)
    with pytest.raises(ValueError):
        timefn.BSpline(scale=0.0)
