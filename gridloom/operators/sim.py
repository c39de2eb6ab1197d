"""Flowline profiles (i, x, h, b, u) and one-dimensional ice-flow models.

Profiles, forces, sliding laws and residuals are projections and window differences; keys separate
scenarios. Root finding is a NumPy kernel, one scenario a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.stencil import nonuniform_gradient
from gridloom.operators.strain import glen_rate

RHO_ICE, RHO_WATER, G = 917.0, 1024.0, 9.80665


def line(x: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    slope = (y2 - y1) / (x2 - x1)
    return slope * x + (y1 - slope * x1)


def sloping_bed(x: Column, x0: float, xt: float = 120.0e3) -> Column:
    return F.when(x >= xt, -500.0).otherwise(line(x, x0, 300.0, xt, -500.0))


def flat_bed(b0: float = -500.0) -> Column:
    return F.lit(b0)


def sinusoidal_bed(x: Column, x0: float, first: float, xt: float = 75.0e3) -> Column:
    """first: the first x beyond xt. Unsmoothed."""
    wave = 300.0 * F.cos(2 * np.pi / 105000.0 * (x - first)) - 500.0
    return F.when(x > xt, wave).otherwise(line(x, x0, 150.0, xt, -200.0))


def surface(x: Column, xmax: float, first: float, x_pin: float = 50.0e3, s0: float = 1000.0, amp: float = 750.0) -> Column:
    """Flat, then logarithmic decay beyond x_pin; first: the first x beyond it. Unsmoothed."""
    fall = amp * F.ln(1 + (xmax - x) / 40000.0)
    return F.when(x > x_pin, fall + s0 - amp * F.ln(F.lit(1 + (xmax - first) / 40000.0))).otherwise(s0)


def derived(p: DataFrame, keys: list[str] | None = None, shelf: bool = False, rho_ice: float = RHO_ICE, rho_water: float = RHO_WATER, edge_order: int = 2) -> DataFrame:
    """Adds s, depth, alpha, depth_ratio, pwpi, haf; a shelf floats, its bed follows from the thickness."""
    h = F.col("h")
    if shelf:
        p = p.withColumn("b", -h * rho_ice / rho_water).withColumn("s", h * (1 - rho_ice / rho_water))
    else:
        p = p.withColumn("s", F.col("b") + h)
    p = nonuniform_gradient(p, "x", "s", keys or [], edge_order, "ds").withColumn("alpha", -F.col("ds")).drop("ds")
    p = p.withColumn("depth", -F.col("b")).withColumn("depth_ratio", F.try_divide(F.col("depth"), h))
    return p.withColumn("pwpi", rho_water / rho_ice * F.col("depth_ratio")).withColumn("haf", F.col("b") + h * rho_ice / rho_water)


def flotation(p: DataFrame, rho_ice: float = RHO_ICE, rho_water: float = RHO_WATER) -> Column:
    """Weight of the ice over that of the water it displaces: positive where grounded."""
    return rho_ice * F.col("h") - rho_water * -F.col("b")


def subset_grounded(p: DataFrame, eps: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Grounded nodes; the slope is that of the whole profile."""
    d = derived(p, keys)
    return d.where(flotation(d) > eps)


def terminus(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x): the last grounded node."""
    return p.where(flotation(p) > 0).groupBy(*keys).agg(F.max(F.struct("i", "x")).alias("m")).select(*keys, "m.i", "m.x")


def quadratic_root(a: Column, b: Column, c: Column) -> Column:
    """The real root of ax² + bx + c nearest to zero; missing without one."""
    d = b * b - 4 * a * c
    r = F.when(d >= 0, F.sqrt(d))
    x, y = F.try_divide(-b + r, 2 * a), F.try_divide(-b - r, 2 * a)
    return F.when(a == 0, F.try_divide(-c, b)).when(F.abs(x) <= F.abs(y), x).otherwise(y)


class Spline:
    """Cubic through all points, not-a-knot at both ends; fewer than four points: the polynomial through them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n, h = len(x), np.diff(self.x)
        self.poly = np.polyfit(self.x - self.x[0], self.y, n - 1) if n < 4 else None
        if self.poly is not None:
            return
        rhs = 6 * np.diff(np.diff(self.y) / h)
        low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        # the outer second derivatives continue the line through the next two
        mid[0], up[0] = mid[0] + h[0] * (1 + h[0] / h[1]), up[0] - h[0] ** 2 / h[1]
        mid[-1], low[-1] = mid[-1] + h[-1] * (1 + h[-1] / h[-2]), low[-1] - h[-1] ** 2 / h[-2]
        for i in range(1, n - 2):
            f = low[i] / mid[i - 1]
            mid[i] -= f * up[i - 1]
            rhs[i] -= f * rhs[i - 1]
        m = np.zeros(n)
        for i in range(n - 2, 0, -1):
            m[i] = (rhs[i - 1] - (up[i - 1] * m[i + 1] if i < n - 2 else 0.0)) / mid[i - 1]
        m[0], m[-1] = m[1] - h[0] / h[1] * (m[2] - m[1]), m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
        self.m, self.h = m, h

    def __call__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, float)
        if self.poly is not None:
            return np.polyval(self.poly, at - self.x[0])
        i = np.clip(np.searchsorted(self.x, at, side="right") - 1, 0, len(self.x) - 2)
        h, a, b = self.h[i], self.x[i + 1] - at, at - self.x[i]
        return (self.m[i] * a**3 + self.m[i + 1] * b**3) / (6 * h) + (self.y[i] / h - self.m[i] * h / 6) * a + (self.y[i + 1] / h - self.m[i + 1] * h / 6) * b

    def roots(self) -> np.ndarray:
        """Where it is zero between its first and last point."""
        found = []
        for i in range(len(self.x) - 1):
            t = np.linspace(self.x[i], self.x[i + 1], 4)
            c = np.polyfit(t - t[0], self(t), 3)
            r = np.roots(c)
            r = np.sort(r[np.abs(r.imag) < 1e-9 * max(1.0, t[-1] - t[0])].real) + t[0]
            found += [v for v in r if t[0] <= v < t[-1] or i == len(self.x) - 2 and v == t[-1]]
        return np.array(found)


_NODES = ("x", "h", "b", "u")


def moved(p: pd.DataFrame, x: np.ndarray, extrapolate: bool = False) -> pd.DataFrame:
    """The profile (sorted by x) at other coordinates, h, b and u by cubic splines."""
    old = p["x"].to_numpy(float)
    if not extrapolate and (x.min() < old[0] or x.max() > old[-1]):
        raise ValueError("coordinates beyond the profile")
    return pd.DataFrame({"i": np.arange(len(x), dtype=np.int32), "x": x} | {c: Spline(old, p[c].to_numpy(float))(x) for c in _NODES[1:]})


def _each(p: DataFrame, keys: list[str] | None, f) -> DataFrame:
    """f over each scenario's profile, a bounded list of nodes in order of x."""
    keys = keys or []
    schema = ", ".join([*(f"`{k}` {p.schema[k].dataType.simpleString()}" for k in keys), "i int", *(f"{c} double" for c in _NODES)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("x", ignore_index=True))
        return pd.concat([pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys}), out], axis=1) if keys else out

    return p.select(*keys, "i", *_NODES).groupBy(*keys).applyInPandas(run, schema)


def update_coordinates(p: DataFrame, x: np.ndarray, keys: list[str] | None = None, extrapolate: bool = False) -> DataFrame:
    return _each(p, keys, lambda q: moved(q, np.asarray(x, float), extrapolate))


def set_ydata(p: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """p with the columns of h, b, u that new (keys, i, ...) has taken from it; derived() follows anew."""
    on, names = [*(keys or []), "i"], [c for c in ("h", "b", "u") if c in new.columns]
    met = p.join(new.select(*on, *(F.col(c).alias(f"new_{c}") for c in names)), on, "left")
    return met.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in names else c for c in p.columns))


def refined_coordinates(x: np.ndarray, u: np.ndarray, thresh: float = 5.0, dx_min: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Cells wider than 2 * dx_min across which u grows by more than thresh are halved, until none is or
    the rounds end; u between the given nodes is their cubic spline."""
    x, f, v = np.asarray(x, float), Spline(x, u), np.asarray(u, float)
    for _ in range(rounds):
        split = np.flatnonzero((np.diff(v) > thresh) & (np.diff(x) > 2 * dx_min))
        if not len(split):
            break
        x = np.insert(x, split + 1, (x[split] + x[split + 1]) / 2)
        v = f(x)
    return x


def refine(p: DataFrame, thresh: float = 5.0, keys: list[str] | None = None, dx_min: float = 10.0, rounds: int = 10) -> DataFrame:
    """The profile at its refined coordinates."""
    return _each(p, keys, lambda q: moved(q, refined_coordinates(q["x"].to_numpy(), q["u"].to_numpy(), thresh, dx_min, rounds)))


def _height(q: pd.DataFrame) -> np.ndarray:
    """Above flotation."""
    return (q["b"] + q["h"] * RHO_ICE / RHO_WATER).to_numpy(float)


def _spaced(first: float, last: float, n: int, dx: float, most: float, more: int) -> np.ndarray:
    """n even nodes; one more or less if the spacing passes the bound most (in units of dx)."""
    x = np.linspace(first, last, n)
    beyond = x[1] - x[0] > most * dx if more > 0 else x[1] - x[0] < most * dx
    return np.linspace(first, last, n + more) if beyond else x


def advanced(q: pd.DataFrame, pad: int = 5) -> pd.DataFrame:
    """The front moves to where a parabola through the last heights above flotation is zero."""
    x = q["x"].to_numpy(float)
    roots = np.roots(np.polyfit(x[-pad:] - x[-1], _height(q)[-pad:], 2))
    roots = roots[np.isreal(roots)].real
    if not len(roots):
        raise ValueError("the height above flotation has no zero")
    front, dx = roots[np.abs(roots).argmin()] + x[-1], x[1] - x[0]
    return moved(q, _spaced(x[0], front, len(x) + int(np.round((front - x[-1]) / dx)), dx, 1.05, 1), True)


def retreated(q: pd.DataFrame) -> pd.DataFrame:
    """The front moves back to the one zero of the height above flotation."""
    x, roots = q["x"].to_numpy(float), Spline(q["x"].to_numpy(float), _height(q)).roots()
    if len(roots) != 1:
        raise ValueError(f"{len(roots)} zeros of the height above flotation")
    dx = x[1] - x[0]
    return moved(q, _spaced(x[0], roots[0], len(x) - int(np.round((x[-1] - roots[0]) / dx)), dx, 0.95, -1))


def advance_terminus(p: DataFrame, keys: list[str] | None = None, pad: int = 5) -> DataFrame:
    return _each(p, keys, lambda q: advanced(q, pad))


def retreat_terminus(p: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _each(p, keys, retreated)


def calving_force(t: Column, h: Column, a: float, mode: str = "constant", cval: float = 1.0, amplitude: float = 0.2, period: float = 1.0, n: float = 3.0, fs=None) -> Column:
    f = fs(t) if fs else {"constant": F.lit(cval), "periodic": amplitude * F.sin(2 * np.pi / period * t) + 1.0, "step": F.when(t < 0.5, 1.5).otherwise(1.0)}[mode]
    return f * a * F.pow(0.25 * RHO_ICE * G * h * (1 - RHO_ICE / RHO_WATER), F.lit(n))


def basal(p: DataFrame, k: float, n: float = 3.0, m: float = 2.0) -> DataFrame:
    """Adds u_s, c, d of power-law basal sliding; p: derived()."""
    gap, al, h = 1 - F.col("pwpi"), F.col("alpha"), F.col("h")
    u = k * F.pow(al, F.lit(n)) * F.pow(h, F.lit(n - m)) / F.pow(gap, F.lit(m))
    c = u * (1 + ((n - m) - n * F.col("pwpi")) / F.pow(gap, F.lit(m)))
    return p.withColumns({"u_s": u, "c": c, "d": k * n * F.pow(al, F.lit(n - 1)) * F.pow(h, F.lit(n - m + 1)) / F.pow(gap, F.lit(m))})


def lateral(p: DataFrame, temp: float, half_width: float, n: float = 3.0, power: float | None = None) -> DataFrame:
    """Lateral shear; with ``power`` the drive is reduced by the water pressure (lateral and basal)."""
    drive = F.lit(RHO_ICE * G) if power is None else RHO_ICE * G * (1 - F.pow(1 - F.col("pwpi"), F.lit(power)))
    k = 2 * glen_rate(temp) / (n + 1) * half_width ** (n + 1) * F.pow(drive, F.lit(n))
    c = k * F.pow("alpha", F.lit(n))
    return p.withColumns({"u_s": c, "c": c, "d": k * F.col("h") * n * F.pow("alpha", F.lit(n - 1))})


def wave_speeds(v: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds cp, dp (derivatives along x), vk = c - dp and the Péclet number pe."""
    for value, out in (("c", "cp"), ("d", "dp")):
        v = nonuniform_gradient(v, "x", value, keys or [], 2, out)
    top = F.max("s").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return v.withColumn("vk", F.col("c") - F.col("dp")).withColumn("pe", F.try_divide(F.col("vk"), F.col("d")) * (top - F.col("s")))


def residual(p: DataFrame, a: float, cb: float, fs: float, n: float = 3.0, m: float = 3.0, scale: float = 1e-2, boundary_scale: float = 1.0, nu_eps: float = 1e-8, keys: list[str] | None = None, width: float | None = None, mu: float = 1.0, inflow: str = "gradient") -> DataFrame:
    """(keys, i, part, f): membrane - drag + driving at every node, and the two boundary rows (part "inflow", "front").
    With ``width`` the drag is lateral (half width) plus basal by depth."""
    keys = keys or []
    q = nonuniform_gradient(derived(p, keys), "x", "u", keys, 2, "du")
    nu = a ** (-1 / n) / (F.pow(F.abs("du"), F.lit((n - 1) / n)) + nu_eps)
    q = nonuniform_gradient(q.withColumn("flux", F.col("h") * nu * F.col("du")), "x", "flux", keys, 2, "dflux")
    speed, sign = F.abs("u"), F.try_divide(F.col("u"), F.abs("u"))
    if width is None:
        drag = sign * cb * F.pow(speed, F.lit(1 / m))
    else:
        effective = F.col("h") - RHO_WATER / RHO_ICE * F.col("depth")
        drag = mu * a ** (-1 / n) * sign * cb * F.pow(F.greatest(effective, F.lit(0.0)) * speed, F.lit(1 / m)) + F.col("h") / width * F.pow(5 * speed / (a * width), F.lit(1 / n)) * sign
    f = scale * (2 * F.col("dflux") - drag + RHO_ICE * G * F.col("h") * F.col("alpha"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    ends = q.withColumn("lo", F.min("i").over(w)).withColumn("hi", F.max("i").over(w))
    first = ends.where("i = lo").select(*keys, "i", F.lit("inflow").alias("part"), (boundary_scale * F.col("du" if inflow == "gradient" else "u")).alias("f"))
    last = ends.where("i = hi").select(*keys, "i", F.lit("front").alias("part"), (boundary_scale * (F.col("du") - fs)).alias("f"))
    return q.select(*keys, "i", F.lit("pde").alias("part"), f.alias("f")).unionByName(first).unionByName(last)


def difference_matrix(x: np.ndarray) -> np.ndarray:
    """First derivative on uneven spacing, second-order ends."""
    n = len(x)
    d = np.zeros((n, n))
    for i in range(1, n - 1):
        a, b = x[i] - x[i - 1], x[i + 1] - x[i]
        d[i, i - 1 : i + 2] = -b / (a * (a + b)), (b - a) / (a * b), a / (b * (a + b))
    a, b = x[1] - x[0], x[2] - x[1]
    d[0, :3] = -(2 * a + b) / (a * (a + b)), (a + b) / (a * b), -a / (b * (a + b))
    a, b = x[-1] - x[-2], x[-2] - x[-3]
    d[-1, -3:] = a / (b * (a + b)), -(a + b) / (a * b), (2 * a + b) / (a * (a + b))
    return d


def pde(u: np.ndarray, d: np.ndarray, h: np.ndarray, alpha: np.ndarray, a: float, cb: float, fs: float, n: float = 3.0, m: float = 3.0, scale: float = 1e-2, boundary_scale: float = 1.0, nu_eps: float = 1e-8) -> np.ndarray:
    du = d @ u
    nu = a ** (-1 / n) / (np.abs(du) ** ((n - 1) / n) + nu_eps)
    f = scale * (2 * (d @ (h * nu * du)) - np.sign(u) * cb * np.abs(u) ** (1 / m) + RHO_ICE * G * h * alpha)
    return np.concatenate([f, boundary_scale * np.array([du[0], du[-1] - fs])])


def jacobian(u: np.ndarray, d: np.ndarray, h: np.ndarray, alpha: np.ndarray, a: float, cb: float, fs: float, n: float = 3.0, m: float = 3.0, scale: float = 1e-2, boundary_scale: float = 1.0, nu_eps: float = 1e-8) -> np.ndarray:
    """The derivative of pde by u."""
    du, e = d @ u, (n - 1) / n
    g = np.abs(du) ** e + nu_eps
    slope = a ** (-1 / n) * (g - e * np.abs(du) ** e) / g**2
    j = 2 * d @ ((h * slope)[:, None] * d) - np.diag(cb / m * np.abs(u) ** (1 / m - 1))
    return np.vstack([scale * j, boundary_scale * d[0], boundary_scale * d[-1]])


def find_root(f, jac, u: np.ndarray, delta: float = 0.2, tol: float = 1e-5, reltol: float = 1e-10, n_iter: int = 500, solve=lambda j, y: np.linalg.lstsq(j, y, rcond=None)[0]) -> tuple[np.ndarray, float, int]:
    """Damped Gauss-Newton: (u, norm of the residual, steps). It ends at the tolerance, or after more than
    five steps where the residual moves by less than reltol."""
    now, k = f(u), 0
    while k < n_iter and np.linalg.norm(now) >= tol:
        u = u - delta * solve(jac(u), now)
        before, now, k = now, f(u), k + 1
        if k > 5 and np.linalg.norm(now - before) < reltol:
            break
    return u, float(np.linalg.norm(now)), k


def difference_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """difference_matrix without its zeros: (first column, three coefficients) of each row."""
    n, s = len(x), np.diff(x)
    a, b = s[:-1], s[1:]
    rows = np.empty((n, 3))
    rows[1:-1] = np.column_stack([-b / (a * (a + b)), (b - a) / (a * b), a / (b * (a + b))])
    for i, p, q, sign in ((0, s[0], s[1], 1), (n - 1, s[-1], s[-2], -1)):
        rows[i] = np.array([-(2 * p + q) / (p * (p + q)), (p + q) / (p * q), -p / (q * (p + q))])[::sign] * sign
    return np.clip(np.arange(n) - 1, 0, n - 3), rows


class Differences:
    """difference_matrix(x) for products: ``self @ v`` takes time and memory that grow as the nodes."""

    def __init__(self, x: np.ndarray):
        self.first, self.rows = difference_rows(x)
        self.at = self.first[:, None] + np.arange(3)

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return (self.rows * v[self.at]).sum(1)


def banded_jacobian(u: np.ndarray, d: Differences, h: np.ndarray, alpha: np.ndarray, a: float, cb: float, fs: float, n: float = 3.0, m: float = 3.0, scale: float = 1e-2, boundary_scale: float = 1.0, nu_eps: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """jacobian without its zeros: (first column, five values) of each row, the rows in the order of pde."""
    du, e, size = d @ u, (n - 1) / n, len(u)
    g = np.abs(du) ** e + nu_eps
    slope = a ** (-1 / n) * (g - e * np.abs(du) ** e) / g**2
    inner, base = (h * slope)[:, None] * d.rows, np.clip(np.arange(size) - 2, 0, size - 5)
    j, i = np.zeros((size + 2, 5)), np.arange(size)
    for k in range(3):
        row = d.first + k
        for c in range(3):
            j[i, d.first[row] + c - base] += 2 * scale * d.rows[:, k] * inner[row, c]
    j[i, i - base] -= scale * cb / m * np.abs(u) ** (1 / m - 1)
    j[size, :3], j[size + 1, 2:] = boundary_scale * d.rows[0], boundary_scale * d.rows[-1]
    return np.concatenate([base, [0, size - 5]]), j


def banded_lstsq(first: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, block: int = 48) -> np.ndarray:
    """Least squares of full column rank by orthogonal steps over blocks of columns: row i has
    values[i] from column first[i] on. Time and memory grow as n."""
    order, width = np.argsort(first, kind="stable"), values.shape[1]
    first, values, y = first[order], values[order], y[order]
    if not (np.isfinite(values).all() and np.isfinite(y).all()):
        raise np.linalg.LinAlgError("values that are not finite")
    starts = np.arange(0, n, block)
    cuts, done = np.searchsorted(first, [*starts, n]), []
    carried = np.zeros((0, width))
    for s, lo, hi in zip(starts, cuts[:-1], cuts[1:]):
        size, wide = min(block, n - s), min(block + width - 1, n - s)
        m = np.zeros((len(carried) + hi - lo, wide + width))
        m[: len(carried), : carried.shape[1] - 1], m[: len(carried), wide] = carried[:, :-1], carried[:, -1]
        r = np.arange(len(carried), len(m))
        m[r[:, None], first[lo:hi, None] - s + np.arange(width)] = values[lo:hi]
        m[r, wide] = y[lo:hi]
        q = np.linalg.qr(m[:, : wide + 1], "r")
        if len(q) < size or not np.diag(q)[:size].all():
            raise np.linalg.LinAlgError("columns that depend on each other")
        done.append(q[:size])
        carried = q[size:wide, size:]
    x = np.zeros(n + width)
    for s, q in zip(starts[::-1], done[::-1]):
        size = len(q)
        x[s : s + size] = np.linalg.solve(q[:, :size], q[:, -1] - q[:, size:-1] @ x[s + size : s + q.shape[1] - 1])
    return x[:n]


def find_root_banded(f, jac, u: np.ndarray, **more) -> tuple[np.ndarray, float, int]:
    """find_root with jac in the form of banded_jacobian."""
    return find_root(f, jac, u, solve=lambda j, y: banded_lstsq(*j, y, len(u)), **more)


def ensemble(scenarios: DataFrame, n_iter: int = 500) -> DataFrame:
    """scenarios: id, a, cb, fs and arrays x, h, b, u0. (id, i, x, u, norm, steps): one solve a row, in parallel,
    whose memory and time a step grow as the nodes."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                x, h, b, u0 = (np.asarray(getattr(r, c), float) for c in ("x", "h", "b", "u0"))
                dense = len(x) < 8 or r.cb == 0  # without drag the speed is free by a constant and the least norm decides
                d = difference_matrix(x) if dense else Differences(x)
                args = (d, h, -(d @ (h + b)), r.a, r.cb, r.fs)
                find, jac = (find_root, jacobian) if dense else (find_root_banded, banded_jacobian)
                u, norm, steps = find(lambda v: pde(v, *args), lambda v: jac(v, *args), u0, n_iter=n_iter)
                yield pd.DataFrame({"id": r.id, "i": np.arange(len(x), dtype=np.int32), "x": x, "u": u, "norm": norm, "steps": np.int32(steps)})

    # rows made by a cross join lie in one partition; dealt in turn, every row has a task
    dealt = scenarios.repartition(max(scenarios.sparkSession.sparkContext.defaultParallelism, 2))
    return dealt.mapInPandas(run, "id bigint, i int, x double, u double, norm double, steps int")
