"""Image offset tracking: chips of a reference image are found again in a second image.

Pixels are sent to the chips that hold them (an explosion of keys), so a chip is a group and no
range join is planned. Offsets, integer or of parts of a pixel, use a NumPy kernel per chip, whose size is fixed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chips(cells: DataFrame, size: int, skip: int, ny: int, nx: int, margin: int = 0) -> DataFrame:
    """(cy, cx, i, j, val): the cells of chips that start every ``skip`` cells and lie inside the margin."""
    def starts(c: str, n: int):
        last = (n - margin - size - margin) // skip
        lo = F.greatest(F.ceil((F.col(c) - margin - size + 1) / skip), F.lit(0)).cast("int")
        hi = F.least(F.floor((F.col(c) - margin) / skip), F.lit(last)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    out = cells.withColumn("cy", F.explode(starts("row", ny))).withColumn("cx", F.explode(starts("col", nx)))
    return out.select("cy", "cx", (F.col("row") - margin - F.col("cy") * skip).alias("i"), (F.col("col") - margin - F.col("cx") * skip).alias("j"), "val")


def ncc(ref: DataFrame, sec: DataFrame, size: int, search: int, skip: int, ny: int, nx: int) -> DataFrame:
    """(cy, cx, dy, dx, corr): correlation of each chip of sec with ref at every shift up to search. A chip
    and its search window of ref are one group, whose size is fixed; shifts with no cell in common are left out."""
    wide = size + 2 * search
    template = chips(sec, size, skip, ny, nx, search).select("cy", "cx", "i", "j", "val", F.lit(True).alias("chip"))
    both = template.unionByName(chips(ref, wide, skip, ny, nx).select("cy", "cx", "i", "j", "val", F.lit(False).alias("chip")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        def dense(rows: pd.DataFrame, n: int) -> tuple[np.ndarray, ...]:
            """Cells that are there, and their values and which of them are not missing."""
            there, has, v = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
            i, j, val = (rows[c].to_numpy(t) for c, t in (("i", int), ("j", int), ("val", float)))
            there[i, j], has[i, j], v[i, j] = 1, ~np.isnan(val), np.where(np.isnan(val), 0.0, val)
            return there, has, v

        def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(a, (size, size)), b)

        (at, ah, a), (bt, bh, b) = dense(pdf[~pdf["chip"]], wide), dense(pdf[pdf["chip"]], size)
        n, ab, aa, bb = met(at, bt), met(a, b), met(a * a, bt), met(at, b * b)
        known = (met(ah, bh) > 0) & (aa * bb > 0)
        corr = np.divide(ab, np.sqrt(aa * bb), out=np.full_like(ab, np.nan), where=known)
        dy, dx = np.nonzero(n)
        corr = pd.Series(corr[dy, dx])
        return pd.DataFrame({"cy": np.int32(key[0]), "cx": np.int32(key[1]), "dy": (dy - search).astype(np.int32), "dx": (dx - search).astype(np.int32), "corr": corr.astype(object).where(corr.notna(), None)})

    return both.groupBy("cy", "cx").applyInPandas(run, "cy int, cx int, dy int, dx int, corr double")


def peaks(surface: DataFrame) -> DataFrame:
    """(cy, cx, dy, dx, snr): the best shift (ties: the first by row, then column) and peak over median."""
    best = F.min(F.struct((-F.col("corr")).alias("c"), "dy", "dx"))
    return surface.groupBy("cy", "cx").agg(best.alias("m"), F.median(F.abs("corr")).alias("med")).select("cy", "cx", F.col("m.dy").alias("dy"), F.col("m.dx").alias("dx"), F.try_divide(F.abs("m.c"), F.col("med")).alias("snr"))


def upsampled_dft(spectrum: np.ndarray, n: int, up: int, row: float, col: float) -> np.ndarray:
    """Cross-correlation near (row, col) on a grid ``up`` times finer, by matrix products."""
    nr, nc = spectrum.shape
    fr, fc = np.fft.ifftshift(np.arange(nr) - nr // 2), np.fft.ifftshift(np.arange(nc) - nc // 2)
    kr = np.exp(-2j * np.pi / (nr * up) * np.outer(np.arange(n) - row, fr))
    kc = np.exp(-2j * np.pi / (nc * up) * np.outer(fc, np.arange(n) - col))
    return kr @ spectrum @ kc


def register(a: np.ndarray, b: np.ndarray, up: int = 32) -> tuple[float, float, float]:
    """(dy, dx, snr) of b against a to 1/up of a cell, positive where b lies further down and right."""
    spec = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    cc = np.abs(np.fft.ifft2(spec))
    y, x = np.unravel_index(cc.argmax(), cc.shape)
    snr = cc.max() / max(np.median(cc), 1e-300)
    dy, dx = (v - n if v > n / 2 else v for v, n in zip((y, x), cc.shape))
    half = int(np.ceil(1.5 * up) // 2)
    fine = np.abs(upsampled_dft(np.conj(spec), 2 * half + 1, up, half - dy * up, half - dx * up))
    fy, fx = np.unravel_index(fine.argmax(), fine.shape)
    return dy + (fy - half) / up, dx + (fx - half) / up, float(snr)


def phase_ramp(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) by a plane through the phase of the Hamming-weighted cross-spectrum, on what the integer shift leaves."""
    dy0, dx0, _ = register(a, b, 1)
    h = np.outer(np.hamming(a.shape[0]), np.hamming(a.shape[1]))
    spec = np.fft.fft2(h * np.roll(b, (-int(dy0), -int(dx0)), (0, 1))) * np.conj(np.fft.fft2(h * a))
    fy, fx = np.meshgrid(np.fft.fftfreq(a.shape[0]), np.fft.fftfreq(a.shape[1]), indexing="ij")
    low = (np.abs(fy) < 0.2) & (np.abs(fx) < 0.2)
    w, p = np.abs(spec[low]), np.angle(spec[low])
    g = np.column_stack([fy[low], fx[low]]) * -2 * np.pi
    m = np.linalg.lstsq(g * w[:, None], p * w, rcond=None)[0]
    return dy0 + float(m[0]), dx0 + float(m[1])


def offset_map(ref: DataFrame, sec: DataFrame, size: int, skip: int, ny: int, nx: int, method: str = "dft", min_amp: float = 0.0, up: int = 32) -> DataFrame:
    """(cy, cx, dy, dx, snr) by a sub-pixel method per chip; dark chips (mean below min_amp) stay missing."""
    both = chips(ref, size, skip, ny, nx).withColumnRenamed("val", "a").join(chips(sec, size, skip, ny, nx).withColumnRenamed("val", "b"), ["cy", "cx", "i", "j"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((size, size)), np.zeros((size, size))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        a[i, j], b[i, j] = pdf["a"].fillna(0), pdf["b"].fillna(0)
        dy = dx = snr = None
        if len(pdf) and np.abs(a).mean() >= min_amp and a.any() and b.any():
            dy, dx, snr = register(a, b, up)
            if method == "phase":
                dy, dx = phase_ramp(a, b)
        return pd.DataFrame({"cy": [key[0]], "cx": [key[1]], "dy": [dy], "dx": [dx], "snr": [snr]}).astype({"dy": float, "dx": float, "snr": float})

    return both.groupBy("cy", "cx").applyInPandas(run, "cy int, cx int, dy double, dx double, snr double")
