"""Missing cells filled, and robust local fits.

Holes are labelled as connected components of missing cells over the whole grid; each hole's spring
system couples only its own cells and their rim, so holes are solved apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.header import Header
from gridloom.operators.raster import Raster
from gridloom.operators.stencil import pad_sources


def holes(r: Raster, max_rounds: int = 200) -> DataFrame:
    """(row, col, hole): missing cells by the least flat index of their 4-connected hole."""
    nx = r.header.nx
    labels = r.cells.where("val is null").select("row", "col", (F.col("row").cast("bigint") * nx + F.col("col")).alias("hole"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    for _ in range(max_rounds):
        sent = labels.select("hole", "row", "col", F.explode(steps).alias("s")).select("hole", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
        least = sent.groupBy("row", "col").agg(F.min("hole").alias("low"))
        new = labels.join(least, ["row", "col"]).select("row", "col", "low", "hole")
        # jump: a label's own label
        roots = new.select((F.col("row").cast("bigint") * nx + F.col("col")).alias("low"), F.col("low").alias("root"))
        new = new.join(roots, "low").select("row", "col", F.least("low", "root").alias("low"), "hole").checkpoint() if _has_dir(r) else new.join(roots, "low").select("row", "col", F.least("low", "root").alias("low"), "hole").cache()
        changed = new.where("low <> hole").limit(1).count()
        labels = new.select("row", "col", F.col("low").alias("hole"))
        if not changed:
            return labels
    raise RuntimeError("holes did not settle")


def _has_dir(r: Raster) -> bool:
    return not r.cells.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty()


def _springs(cells: dict[tuple[int, int], float | None], h: Header) -> dict[tuple[int, int], float]:
    """Least-squares springs between neighbours of which at least one is missing."""
    unknown = {rc: i for i, (rc, v) in enumerate((x for x in cells.items() if x[1] is None))}
    a, b = np.zeros((len(unknown), len(unknown))), np.zeros(len(unknown))
    pairs = {tuple(sorted((rc, (rc[0] + dy, rc[1] + dx)))) for rc in unknown for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))}
    for p, q in pairs:
        if not all(0 <= x[0] < h.ny and 0 <= x[1] < h.nx for x in (p, q)) or p not in cells or q not in cells:
            continue
        for x, y in ((p, q), (q, p)):
            if x in unknown:
                a[unknown[x], unknown[x]] += 1
                if y in unknown:
                    a[unknown[x], unknown[y]] -= 1
                else:
                    b[unknown[x]] += cells[y]
    m = np.linalg.lstsq(a, b, rcond=None)[0]
    return {rc: float(m[i]) for rc, i in unknown.items()}


def inpaint(r: Raster) -> Raster:
    """Spring metaphor: every missing cell is filled. A hole of one cell is the mean of its rim, taken by
    the JVM; a larger one is a group."""
    h, inside = r.header, holes(r)
    sized = inside.join(inside.groupBy("hole").agg(F.count("*").alias("size")), "hole")
    cells = r.cells.select("row", "col", "val")

    def around(holes: DataFrame, with_own: bool) -> DataFrame:
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))[0 if with_own else 1 :]))
        return holes.select("hole", "row", "col", F.explode(steps).alias("s")).select("hole", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(a), int(b)): (None if pd.isna(v) else float(v)) for a, b, v in zip(pdf["row"], pdf["col"], pdf["val"])}
        out = _springs(cells, h)
        return pd.DataFrame({"row": [k[0] for k in out], "col": [k[1] for k in out], "val": list(out.values())})

    rims = around(sized.where("size = 1"), False)
    mean = rims.join(cells, ["row", "col"], "left").groupBy("hole").agg(F.avg("val").alias("val"))
    alone = mean.select(F.expr(f"cast(hole div {h.nx} as int)").alias("row"), (F.col("hole") % h.nx).cast("int").alias("col"), F.coalesce("val", F.lit(0.0)).alias("val"))
    filled = around(sized.where("size > 1"), True).distinct().join(cells, ["row", "col"]).groupBy("hole").applyInPandas(run, "row int, col int, val double")
    return Raster(cells.where("val is not null").unionByName(alone).unionByName(filled), h)


def robust_fit(x: np.ndarray, d: np.ndarray, method: str, n_iter: int = 9) -> np.ndarray:
    """Polynomial coefficients: "ils" drops residuals beyond 3 deviations, "irls" weighs towards L1, "lsq" is plain."""
    ok, m = np.ones(len(d), bool), np.linalg.lstsq(x, d, rcond=None)[0]
    w = np.ones(len(d))
    for _ in range(n_iter):
        res = d - x @ m
        if method == "ils":
            new = np.abs(res) <= 3 * max(res[ok].std(), 1e-300)
            if (new == ok).all() or new.sum() < x.shape[1]:
                break
            ok = new
            m = np.linalg.lstsq(x[ok], d[ok], rcond=None)[0]
        elif method == "irls":
            w = 1 / np.sqrt(np.maximum(np.abs(res), 1e-6))
            new_m = np.linalg.lstsq(x * w[:, None], d * w, rcond=None)[0]
            done = np.abs(new_m - m).max() < 1e-8
            m = new_m
            if done:
                break
        else:
            break
    return m


def robust_fits(x: np.ndarray, v: np.ndarray, has: np.ndarray, method: str, n_iter: int = 9) -> np.ndarray:
    """robust_fit of many windows: x (cells, p), v and has (windows, cells). Only "ils" and "lsq" are solved
    at once; windows of another method, or whose cells leave the polynomial open, come one by one."""
    p, out = x.shape[1], np.empty((len(v), x.shape[1]))
    pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)

    def solve(use: np.ndarray, at: np.ndarray):
        a = (use @ pairs).reshape(-1, p, p)
        e = np.linalg.eigvalsh(a)
        fine = e[:, 0] > 1e-9 * e[:, -1]
        m = np.zeros((len(a), p))
        m[fine] = np.linalg.solve(a[fine], ((use * v[at]) @ x)[fine][:, :, None])[:, :, 0]
        return m, fine

    single = np.ones(len(v), bool)
    if method in ("ils", "lsq"):
        ok, at = has.copy(), np.arange(len(v))
        m, fine = solve(ok.astype(float), at)
        out, single = m, ~fine
        at = at[fine]
        for _ in range(n_iter if method == "ils" else 0):
            res, n = np.abs(v[at] - out[at] @ x.T), ok[at].sum(1)
            signed = np.where(ok[at], v[at] - out[at] @ x.T, 0.0)
            mean = signed.sum(1) / n
            std = np.sqrt((np.where(ok[at], signed - mean[:, None], 0.0) ** 2).sum(1) / n)
            new = has[at] & (res <= 3 * np.maximum(std, 1e-300)[:, None])
            go = (new != ok[at]).any(1) & (new.sum(1) >= p)
            at, new = at[go], new[go]
            if not len(at):
                break
            ok[at] = new
            m, fine = solve(new.astype(float), at)
            out[at[fine]] = m[fine]
            single[at[~fine]] = True
            at = at[fine]
    for i in np.flatnonzero(single):
        out[i] = robust_fit(x[has[i]], v[i][has[i]], method, n_iter)
    return out


TILE = 32


def robust_gradient(r: Raster, window: int = 5, order: int = 1, method: str = "ils") -> DataFrame:
    """(row, col, fit, dy, dx): a polynomial fitted in the window around each cell, edges repeated.
    Cells are sent to the tiles whose windows hold them; a tile and its margin are one group of fixed size."""
    h, k = r.header, window // 2
    powers = [(a, b) for s in range(order + 1) for a in range(s + 1) for b in [s - a]]
    src = pad_sources(r.cells.where("val is not null"), h, k, k, "edge")

    def over(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - k) / TILE), F.floor((F.col(c) + k) / TILE)))

    sent = src.select("row", "col", "val", over("row").alias("ty")).withColumn("tx", over("col"))
    y, x = (c.ravel() for c in np.meshgrid(*(np.arange(-k, k + 1.0),) * 2, indexing="ij"))
    basis = np.column_stack([y**p * x**q for p, q in powers])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left, side = int(key[0]) * TILE, int(key[1]) * TILE, TILE + 2 * k
        v, has = np.zeros((side, side)), np.zeros((side, side), bool)
        i, j = pdf["row"].to_numpy() - top + k, pdf["col"].to_numpy() - left + k
        v[i, j], has[i, j] = pdf["val"], True
        ny, nx = min(TILE, h.ny - top), min(TILE, h.nx - left)
        if ny <= 0 or nx <= 0 or top < 0 or left < 0:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("row", "int32"), ("col", "int32"), ("fit", float), ("dy", float), ("dx", float))})
        cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, (2 * k + 1, 2 * k + 1))[:ny, :nx].reshape(ny * nx, -1)
        v, has = cut(v), cut(has)
        rows, cols = (c.ravel() for c in np.meshgrid(np.arange(top, top + ny), np.arange(left, left + nx), indexing="ij"))
        met, n = has.any(1), has.sum(1)
        enough, m = n >= len(powers), np.full((len(v), len(powers)), np.nan)
        m[enough] = robust_fits(basis, v[enough], has[enough], method)
        out = pd.DataFrame({"row": rows, "col": cols, "fit": m[:, powers.index((0, 0))], "dy": m[:, powers.index((1, 0))] / h.dy, "dx": m[:, powers.index((0, 1))] / h.dx}).astype({"row": "int32", "col": "int32"})
        return out[met]

    out = sent.groupBy("ty", "tx").applyInPandas(run, "row int, col int, fit double, dy double, dx double")
    return out.select("row", "col", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("fit", "dy", "dx")))
