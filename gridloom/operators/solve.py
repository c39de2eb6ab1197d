"""Per-pixel regression: normal equations as mergeable sums, dense solves in batches.

For P basis functions the P(P+1)/2 + P sums of G'W²G and G'W²d are one map-side combined
aggregation; what is left to solve is a P x P system per pixel, done for a whole Arrow batch by one
NumPy call. Sparse and robust fits need the rows themselves: a pixel's series is packed into arrays, and batches of pixels are solved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.timefn import Collection

PIXEL = ["row", "col"]


def design(epochs: DataFrame, model: Collection) -> DataFrame:
    """(k, g array<double>) of each epoch (k, tdec)."""
    return epochs.select("k", F.array(*(c.cast("double") for c in model.columns(F.col("tdec")))).alias("g"))


def gram(obs: DataFrame, g: DataFrame, p: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, a array of the upper triangle, b array). Missing and non-finite values take no part.
    g is a row an epoch: broadcast by its size, or joined by k."""
    keys = PIXEL if keys is None else keys
    good = F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf"))
    w2 = F.col("wgt") * F.col("wgt") if "wgt" in obs.columns else F.lit(1.0)
    met = obs.where(good).join(g, "k").select(*keys, F.col("val").alias("d"), w2.alias("w2"), *(F.col("g")[i].alias(f"g{i}") for i in range(p)))
    sums = [F.sum(F.col(f"g{i}") * F.col(f"g{j}") * F.col("w2")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"g{i}") * F.col("d") * F.col("w2")).alias(f"b{i}") for i in range(p)]
    out = met.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    return out.select(*keys, "n", F.array(*(F.col(f"a{i}_{j}") for i in range(p) for j in range(i, p))).alias("a"), F.array(*(F.col(f"b{i}") for i in range(p))).alias("b"))


def _unpacked(a: np.ndarray, p: int) -> np.ndarray:
    full = np.zeros((len(a), p, p))
    i, j = np.triu_indices(p)
    full[:, i, j] = a
    full[:, j, i] = a
    return full


def _batched(sums: DataFrame, p: int, solve: Callable, keys: list[str], n_min: int) -> DataFrame:
    schema = T.StructType([*sums.select(*keys).schema.fields, T.StructField("status", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok = (pdf["n"] >= n_min).to_numpy()
            m, cov = [None] * len(pdf), [None] * len(pdf)
            if ok.any():
                full = _unpacked(np.stack(pdf.loc[ok, "a"].to_list()), p)
                b = np.stack(pdf.loc[ok, "b"].to_list())
                x, c, good = solve(full, b)
                for at, i in enumerate(np.flatnonzero(ok)):
                    if good[at]:
                        m[i], cov[i] = x[at], c[at].ravel()
                    else:
                        ok[i] = False
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "status": np.where(ok, 0, 1), "n": pdf["n"], "m": m, "cov": cov})

    return sums.mapInPandas(run, schema)


def _inverse(a: np.ndarray, b: np.ndarray):
    good = np.linalg.matrix_rank(a) == a.shape[1]
    safe = np.where(good[:, None, None], a, np.eye(a.shape[1]))
    inv = np.linalg.inv(safe)
    return np.einsum("nij,nj->ni", inv, b), inv, good


def lsqr(obs: DataFrame, epochs: DataFrame, model: Collection, n_min: int = 20, keys: list[str] | None = None) -> DataFrame:
    """(keys, status, n, m, cov): weighted least squares; status 1 and no result below n_min observations."""
    keys = PIXEL if keys is None else keys
    return _batched(gram(obs, design(epochs, model), len(model), keys), len(model), _inverse, keys, n_min)


def ridge(obs: DataFrame, epochs: DataFrame, model: Collection, penalty: float, reg: list[int] | None = None, n_min: int = 20, reg_mat: np.ndarray | None = None) -> DataFrame:
    """Penalty on the regularised functions' diagonal, or a whole matrix."""
    p = len(model)
    reg = model.partitions()["reg"] if reg is None else reg
    extra = penalty * (reg_mat if reg_mat is not None else np.diag([1.0 if i in reg else 0.0 for i in range(p)]))
    return _batched(gram(obs, design(epochs, model), p), p, lambda a, b: _inverse(a + extra, b), PIXEL, n_min)


def _lasso_one(a: np.ndarray, b: np.ndarray, lam: np.ndarray, sweeps: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for ½x'Ax - b'x + Σ lam|x|."""
    x, a = np.zeros(len(b)), a + 1e-8 * np.eye(len(b))
    for _ in range(sweeps):
        change = 0.0
        for i in range(len(b)):
            r = b[i] - a[i] @ x + a[i, i] * x[i]
            new = np.sign(r) * max(abs(r) - lam[i], 0.0) / a[i, i]
            change, x[i] = max(change, abs(new - x[i])), new
        if change < tol * max(1.0, np.abs(x).max()):
            break
    return x


REWEIGHT: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "log": lambda x, eps: np.log((np.abs(x).sum() + len(x) * eps) / (np.abs(x) + eps)),
    "inverse": lambda x, eps: 1 / (np.abs(x) + eps),
    "isquare": lambda x, eps: 1 / (x**2 + eps**2),
}


def reweight_columns(m: str, how: str, eps: float = 1e-4) -> Column:
    """The reweighting functions on an array column."""
    total = F.aggregate(F.transform(m, F.abs), F.lit(0.0), lambda s, x: s + x) + F.size(m) * eps
    return F.transform(m, {"log": lambda x: F.ln(total / (F.abs(x) + eps)), "inverse": lambda x: 1 / (F.abs(x) + eps), "isquare": lambda x: 1 / (x * x + eps * eps)}[how])


def best_basis(a: np.ndarray, b: np.ndarray, d2: float, x: np.ndarray, reduction: float = 0.95) -> list[int]:
    """Functions taken by |x| until they explain the share of the sum of squares d2."""
    taken: list[int] = []
    for i in np.argsort(-np.abs(x)):
        taken.append(int(i))
        m = np.linalg.lstsq(a[np.ix_(taken, taken)], b[taken], rcond=None)[0]
        if d2 > 0 and b[taken] @ m / d2 >= reduction:
            break
    return taken


def lasso(obs: DataFrame, epochs: DataFrame, model: Collection, penalty: float, reg: list[int] | None = None, n_min: int = 20, rw_iter: int = 1, rw: str = "log", eps: float = 1e-4) -> DataFrame:
    p = len(model)
    reg = model.partitions()["reg"] if reg is None else reg

    def solve(a: np.ndarray, b: np.ndarray):
        out = []
        for ai, bi in zip(a, b):
            lam = np.array([penalty if i in reg else 0.0 for i in range(p)])
            x = _lasso_one(ai, bi, lam)
            for _ in range(rw_iter - 1):
                lam[reg] = penalty * REWEIGHT[rw](x[reg], eps)
                x = _lasso_one(ai, bi, lam)
            out.append(x)
        return np.array(out), np.linalg.pinv(a), np.ones(len(a), bool)

    return _batched(gram(obs, design(epochs, model), p), p, solve, PIXEL, n_min)


def omp(obs: DataFrame, epochs: DataFrame, model: Collection, n_nonzero: int = 10, n_min: int = 20) -> DataFrame:
    """Orthogonal matching pursuit on the Gram sums; identity covariance."""
    p = len(model)

    def solve(a: np.ndarray, b: np.ndarray):
        out = np.zeros_like(b)
        for k in range(len(b)):
            taken: list[int] = []
            norm = np.sqrt(np.maximum(np.diag(a[k]), 1e-300))
            for _ in range(min(n_nonzero, p)):
                r = (b[k] - a[k] @ out[k]) / norm
                r[taken] = 0
                i = int(np.abs(r).argmax())
                if abs(r[i]) < 1e-12 * max(1.0, np.abs(b[k]).max()):
                    break
                taken.append(i)
                out[k] = 0
                out[k, taken] = np.linalg.lstsq(a[k][np.ix_(taken, taken)], b[k][taken], rcond=None)[0]
        return out, np.broadcast_to(np.eye(p), a.shape), np.ones(len(b), bool)

    return _batched(gram(obs, design(epochs, model), p), p, solve, PIXEL, n_min)


def series(obs: DataFrame, *values: str) -> DataFrame:
    """(row, col, k, values...): a row a pixel, with its epochs in order and their values as arrays."""
    packed = obs.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("k", *values))).alias("s"))
    return packed.select(*PIXEL, *(F.col(f"s.{c}").alias(c) for c in ("k", *values)))


def _draws(rng: np.random.Generator, n: int, size: int, trials: int) -> np.ndarray:
    """(trials, size): what ``rng.choice(n, size, replace=False)`` gives trial by trial."""
    return np.stack([rng.choice(n, size, replace=False) for _ in range(trials)])


def _draws_at_once(rng: np.random.Generator, n: int, size: int, trials: int) -> np.ndarray:
    """_draws from the raw words of PCG64: Floyd's sampling and a shuffle by Lemire's bounded integers,
    as NumPy makes them for n up to 10,000. A rejected word leaves it to _draws."""
    state = rng.bit_generator.state
    if n > 10000 or state["has_uint32"]:
        return _draws(rng, n, size, trials)
    drawn = range(int(n == size), size)  # an integer below 1 takes no word
    bound = np.array([*(n - size + t + 1 for t in drawn), *range(size, 1, -1)], np.uint64)
    words = rng.bit_generator.random_raw((trials * len(bound) + 1) // 2).astype("<u8").view("<u4")[: trials * len(bound)]
    m = words.reshape(trials, -1).astype(np.uint64) * bound
    if ((m & np.uint64(0xFFFFFFFF)) < bound).any():
        rng.bit_generator.state = state
        return _draws(rng, n, size, trials)
    words, out, every = (m >> np.uint64(32)).astype(np.int64).T, np.zeros((trials, size), np.int64), np.arange(trials)
    for v, t in zip(words, drawn):
        out[:, t] = np.where((out[:, :t] == v[:, None]).any(1), n - size + t, v)
    for v, i in zip(words[len(drawn) :], range(size - 1, 0, -1)):
        kept = out[:, i].copy()
        out[:, i] = out[every, v]
        out[every, v] = kept
    return out


def _draw() -> Callable:
    """The quick draws where this NumPy's choice gives the same ones."""
    for n, size in ((10, 10), (37, 10), (84, 10)):
        a, b = (np.random.default_rng([n, size]) for _ in range(2))
        if not np.array_equal(_draws(a, n, size, 50), _draws_at_once(b, n, size, 50)):
            return _draws
    return _draws_at_once


def stacked_lstsq(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(n, p) solutions for x (n, rows, p) and d (n, rows). Near-dependent columns are left to lstsq, one by one."""
    a, b = np.swapaxes(x, 1, 2) @ x, np.einsum("nrp,nr->np", x, d)
    scale = 1 / np.sqrt(np.maximum(np.einsum("npp->np", a), 1e-300))
    a, good = a * scale[:, :, None] * scale[:, None, :], np.zeros(len(a), bool)
    finite = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1)
    good[finite] = np.linalg.eigvalsh(a[finite])[:, 0] > 1e-6
    m = np.empty_like(b)
    m[good] = np.linalg.solve(a[good], (b * scale)[good][:, :, None])[:, :, 0] * scale[good]
    for i in np.flatnonzero(~good):
        m[i] = np.linalg.lstsq(x[i], d[i], rcond=None)[0]
    return m


def ransac(obs: DataFrame, epochs: DataFrame, model: Collection, min_samples: int = 10, trials: int = 100, seed: int = 0, n_min: int = 20) -> DataFrame:
    """Seeded RANSAC per pixel; residual threshold: the median absolute deviation of the values."""
    g, p = design(epochs, model), len(model)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = _draw()
        for pdf in frames:
            out = []
            for row, col, d, g in zip(pdf["row"], pdf["col"], pdf["val"], pdf["g"]):
                if len(d) < max(n_min, min_samples):
                    out.append((1, len(d), None, 0))
                    continue
                x = np.concatenate(g).reshape(-1, p)
                s = draw(np.random.default_rng([seed, int(row), int(col)]), len(d), min_samples, trials)
                inside = np.abs(d - stacked_lstsq(x[s], d[s]) @ x.T) <= np.median(np.abs(d - np.median(d)))
                best = inside[inside.sum(1).argmax()]
                out.append((0, len(d), np.linalg.lstsq(x[best], d[best], rcond=None)[0], int(best.sum())))
            status, n, m, inliers = zip(*out) if out else ((),) * 4
            yield pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "status": np.array(status, np.int32), "n": np.array(n, np.int64), "m": pd.Series(m, dtype=object, index=pdf.index), "inliers": np.array(inliers, np.int32)})

    rows = obs.where("val is not null and not isnan(val)").join(g, "k").select("row", "col", "k", "val", "g")
    return series(rows, "val", "g").mapInPandas(fit, "row int, col int, status int, n bigint, m array<double>, inliers int")


SOLVERS = {"lsqr": lsqr, "ridge": ridge, "lasso": lasso, "omp": omp, "ransac": ransac}


def select_solver(name: str) -> Callable:
    if name not in SOLVERS:
        raise ValueError(f"no solver {name!r}")
    return SOLVERS[name]


def dot(g: str, m: str) -> Column:
    return F.aggregate(F.zip_with(g, m, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def quadratic_form(g: Column, cov: Column, p: int) -> Column:
    """g' C g of a flattened C."""
    i = F.sequence(F.lit(0), F.lit(p * p - 1))
    return F.aggregate(i, F.lit(0.0), lambda s, k: s + F.element_at(g, (F.floor(k / p) + 1).cast("int")) * F.element_at(g, (k % p + 1).cast("int")) * F.element_at(cov, k + 1))


def predict(fits: DataFrame, epochs: DataFrame, model: Collection) -> DataFrame:
    """(row, col, k, secular, seasonal, transient, step, full, sigma). full sums the four parts, so
    functions that none of them takes are fitted but not predicted."""
    parts = model.partitions()
    p, g = len(model), design(epochs, model)
    met = fits.where("status = 0").crossJoin(F.broadcast(g))  # g is a row an epoch of the wanted times

    def part(idx: list[int]) -> Column:
        total = F.lit(0.0)
        for i in idx:
            total = total + F.col("g")[i] * F.col("m")[i]
        return total

    names = ("secular", "seasonal", "transient", "step")
    out = met.select("row", "col", "k", *(part(parts[n]).alias(n) for n in names), F.sqrt(quadratic_form(F.col("g"), F.col("cov"), p)).alias("sigma"))
    return out.withColumn("full", F.col("secular") + F.col("seasonal") + F.col("transient") + F.col("step"))


def residuals(obs: DataFrame, fits: DataFrame, epochs: DataFrame, model: Collection) -> DataFrame:
    g = design(epochs, model)
    met = obs.join(fits.where("status = 0").select("row", "col", "m"), PIXEL).join(g, "k")
    return met.withColumn("res", F.col("val") - dot("g", "m")).drop("g", "m")


def detrend(obs: DataFrame, fits: DataFrame, epochs: DataFrame, model: Collection, remove: tuple[str, ...]) -> DataFrame:
    parts = predict(fits, epochs, model).select("row", "col", "k", *remove)
    total = F.col("val")
    for r in remove:
        total = total - F.col(r)
    return obs.join(parts, [*PIXEL, "k"]).select("row", "col", "k", total.alias("val"))


def iterate(obs: DataFrame, epochs: DataFrame, model: Collection, n_std: float = 3.0, n_iter: int = 3, n_min: int = 20, solver: Callable = lsqr, **more) -> tuple[DataFrame, DataFrame]:
    """(fits, cleaned observations): fit, drop residuals beyond n_std deviations of the pixel, repeat.
    Residuals below 1e-9 of the pixel's largest value are rounding and never drop a value."""
    fits = solver(obs, epochs, model, n_min=n_min, **more)
    for _ in range(n_iter - 1):
        res = residuals(obs, fits, epochs, model)
        sigma = res.groupBy(*PIXEL).agg(F.stddev_pop("res").alias("sd"), (1e-9 * F.max(F.abs("val"))).alias("least"))
        far = F.abs("res") > F.greatest(n_std * F.col("sd"), F.col("least"))
        obs = res.join(sigma, PIXEL).withColumn("val", F.when(~far, F.col("val"))).drop("res", "sd", "least")
        fits = solver(obs, epochs, model, n_min=n_min, **more)
    return fits, obs


def inversion(obs: DataFrame, epochs: DataFrame, out_epochs: DataFrame, model: Collection, mask: DataFrame | None = None, solver: Callable = lsqr, n_std: float = 3.0, n_iter: int = 1, n_min: int = 20, **more) -> dict[str, DataFrame]:
    """Decomposition of a whole stack: parts, sigma, and the cleaned observations. Pixels outside the
    mask (row, col) come out as 0."""
    inside = obs.join(mask.select(*PIXEL), PIXEL, "left_semi") if mask is not None else obs
    fits, clean = iterate(inside, epochs, model, n_std, n_iter, n_min, solver, **more)
    parts = predict(fits, out_epochs, model)
    if mask is not None:
        names = ("secular", "seasonal", "transient", "step", "sigma", "full")
        outside = obs.select(*PIXEL).distinct().join(mask.select(*PIXEL), PIXEL, "left_anti").crossJoin(F.broadcast(out_epochs.select("k")))
        parts = parts.unionByName(outside.select("row", "col", "k", *(F.lit(0.0).alias(n) for n in names)))
    return {"fits": fits, "parts": parts, "clean": clean}


def inversion_points(obs: DataFrame, points: DataFrame, *args, **more) -> dict[str, DataFrame]:
    """The same at listed pixels (row, col)."""
    return inversion(obs.join(points.select(*PIXEL), PIXEL, "left_semi"), *args, **more)


def amp_phase(cos: Column, sin: Column) -> tuple[Column, Column]:
    """Seasonal amplitude, and phase in days from 0 to 365."""
    days = F.atan2(sin, cos) * 182.5 / np.pi
    return F.sqrt(cos * cos + sin * sin), F.when(days < 0, days + 365.0).otherwise(days)


def closed_form_line(obs: DataFrame, epochs: DataFrame, keys: list[str], t0: float, n_min: int = 20) -> DataFrame:
    """(keys, n, m0, m1): weighted line m0 + m1 (t - t0) without leaving the JVM."""
    met = obs.where("val is not null").join(epochs.select("k", (F.col("tdec") - t0).alias("t")), "k")
    w = F.col("wgt") * F.col("wgt")
    s = met.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("s0"), F.sum(w * F.col("t")).alias("s1"), F.sum(w * F.col("t") * F.col("t")).alias("s2"), F.sum(w * F.col("val")).alias("y0"), F.sum(w * F.col("t") * F.col("val")).alias("y1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    ok = F.col("n") >= n_min
    return s.select(*keys, "n", F.when(ok, F.try_divide(F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1"), det)).alias("m0"), F.when(ok, F.try_divide(F.col("s0") * F.col("y1") - F.col("s1") * F.col("y0"), det)).alias("m1"))


def butterworth_coeffs(cutoff: float, dt: float, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a low-pass Butterworth filter by the bilinear transform."""
    warped = 2 / dt * np.tan(np.pi * cutoff * dt)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (2 / dt + poles) / (2 / dt - poles)
    gain = np.real(warped**order / np.prod(2 / dt - poles))
    return np.real(gain * np.poly(-np.ones(order))), np.real(np.poly(z))


def _filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x: (series, epochs), all series at once."""
    def once(v):
        out, n = np.zeros_like(v), len(b)
        for i in range(len(v)):
            out[i] = sum(b[j] * v[i - j] for j in range(min(n, i + 1))) - sum(a[j] * out[i - j] for j in range(1, min(n, i + 1)))
        return out

    x = np.ascontiguousarray(x.T)
    k = min(3 * len(b) * 4, len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[k:0:-1], x, 2 * x[-1] - x[-2 : -k - 2 : -1]])
    return (once(once(ext - ext[0])[::-1])[::-1][k : k + len(x)] + ext[0] * (b.sum() / a.sum()) ** 2).T


def butterworth(obs: DataFrame, cutoff: float, dt: float, order: int = 2) -> DataFrame:
    """(row, col, k, long, short): zero-phase low-pass per pixel over its epochs in order, and what it leaves.
    Pixels of a batch with as many epochs are filtered together."""
    b, a = butterworth_coeffs(cutoff, dt, order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["val"].map(len)
            for n, same in pdf.groupby(size):
                x = np.concatenate(same["val"].to_list()).astype(float).reshape(-1, n)
                y = _filtfilt(b, a, x) if n > 1 else x.copy()
                rows = {c: np.repeat(same[c].to_numpy(), n) for c in PIXEL}
                yield pd.DataFrame(rows | {"k": np.concatenate(same["k"].to_list()), "long": y.ravel(), "short": (x - y).ravel()})

    return series(obs.where("val is not null"), "val").mapInPandas(run, "row int, col int, k int, long double, short double")
