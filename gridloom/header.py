"""Raster headers: the affine grid that a cell DataFrame lives on. Driver-side metadata, no rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    """Upper-left cell centre, spacing (dy is negative for north-up grids), size, CRS code, units."""

    xstart: float
    ystart: float
    dx: float
    dy: float
    nx: int
    ny: int
    epsg: int | None = None
    units: str = "m"

    @classmethod
    def from_coords(cls, x: list[float], y: list[float], **more) -> Header:
        """Spacing is the first difference, 1.0 for a single coordinate."""
        step = lambda v: v[1] - v[0] if len(v) > 1 else 1.0
        return cls(x[0], y[0], step(x), step(y), len(x), len(y), **more)

    def __eq__(self, other) -> bool:
        """Same shape and units, affine terms within 1e-8; the CRS code does not count."""
        if not isinstance(other, Header):
            return NotImplemented
        close = all(abs(getattr(self, k) - getattr(other, k)) <= 1e-8 for k in ("xstart", "ystart", "dx", "dy"))
        return close and self.shape == other.shape and self.units == other.units

    def __hash__(self) -> int:
        return hash((self.nx, self.ny, self.units))

    shape = property(lambda s: (s.ny, s.nx))
    spacing = property(lambda s: (s.dy, s.dx))
    xstop = property(lambda s: s.xstart + (s.nx - 1) * s.dx)
    ystop = property(lambda s: s.ystart + (s.ny - 1) * s.dy)
    xlim = property(lambda s: (s.xstart, s.xstop))
    ylim = property(lambda s: (s.ystart, s.ystop))
    xspan = property(lambda s: abs(s.xstop - s.xstart))
    yspan = property(lambda s: abs(s.ystop - s.ystart))
    extent = property(lambda s: (s.xstart, s.xstop, s.ystop, s.ystart))
    proj_win = property(lambda s: (s.xstart, s.ystart, s.xstop, s.ystop))
    geotransform = property(lambda s: (s.xstart, s.dx, 0.0, s.ystart, 0.0, s.dy))

    def x(self, col: Column) -> Column:
        return F.lit(float(self.xstart)) + F.lit(float(self.dx)) * col

    def y(self, row: Column) -> Column:
        return F.lit(float(self.ystart)) + F.lit(float(self.dy)) * row

    def col_of(self, x: Column) -> Column:
        """Nearest column; halves go to the even one."""
        return F.rint((x - F.lit(float(self.xstart))) / F.lit(float(self.dx))).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.rint((y - F.lit(float(self.ystart))) / F.lit(float(self.dy))).cast("int")

    def contains(self, x: Column, y: Column) -> Column:
        return self.col_of(x).between(0, self.nx - 1) & self.row_of(y).between(0, self.ny - 1)

    def window(self, row0: int, row1: int, col0: int, col1: int) -> Header:
        """The header of rows row0..row1-1 and columns col0..col1-1."""
        return replace(self, xstart=self.xstart + col0 * self.dx, ystart=self.ystart + row0 * self.dy, nx=col1 - col0, ny=row1 - row0)

    def subset_bounds(self, ulx: float, uly: float, lrx: float, lry: float) -> tuple[int, int, int, int]:
        """End-exclusive index bounds of a projected window; the full extent if it reaches outside."""
        near = lambda v, a, d: round((v - a) / d)
        c0, c1 = near(ulx, self.xstart, self.dx), near(lrx, self.xstart, self.dx)
        r0, r1 = near(uly, self.ystart, self.dy), near(lry, self.ystart, self.dy)
        if min(c0, r0) < 0 or c1 > self.nx or r1 > self.ny:
            return 0, self.ny, 0, self.nx
        return r0, r1, c0, c1

    def crop_bounds(self, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[int, int, int, int]:
        """End-exclusive index bounds of the cells whose coordinates lie in the bounds, ends included."""
        cols = [i for i in range(self.nx) if xmin <= self.xstart + i * self.dx <= xmax]
        rows = [i for i in range(self.ny) if ymin <= self.ystart + i * self.dy <= ymax]
        if not cols or not rows:
            raise ValueError("the bounds hold no cell")
        return rows[0], rows[-1] + 1, cols[0], cols[-1] + 1

    def coarse(self, fy: int, fx: int) -> Header:
        """Blocks of fy x fx cells, placed at their upper-left cell."""
        return replace(self, dx=self.dx * fx, dy=self.dy * fy, nx=math.ceil(self.nx / fx), ny=math.ceil(self.ny / fy))

    def padded(self, n: int) -> Header:
        return replace(self, xstart=self.xstart - n * self.dx, ystart=self.ystart - n * self.dy, nx=self.nx + 2 * n, ny=self.ny + 2 * n)

    def convert(self, units: str) -> Header:
        """Metres to kilometres or back, units included."""
        if units == self.units:
            return self
        k = {("m", "km"): 1e-3, ("km", "m"): 1e3}[self.units, units]
        return replace(self, xstart=self.xstart * k, ystart=self.ystart * k, dx=self.dx * k, dy=self.dy * k, units=units)
