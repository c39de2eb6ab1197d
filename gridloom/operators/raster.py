"""Rasters as cells (row, col, val): arithmetic, windows, masks, reductions, block reduction.

NULL marks a missing value; NaN becomes NULL once, at ingest. Operands of arithmetic are aligned by
an equi-join on (row, col) after their headers are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.header import Header

CELL = ["row", "col"]


def missing_to_null(v: Column) -> Column:
    return F.when(F.isnan(v), None).otherwise(v)


@dataclass(frozen=True)
class Raster:
    cells: DataFrame
    header: Header

    def _with(self, cells: DataFrame, header: Header | None = None) -> Raster:
        return Raster(cells, header or self.header)

    def map(self, f: Callable[[Column], Column]) -> Raster:
        """Any function of one value, NumPy's unary ufuncs among them."""
        return self._with(self.cells.select(*CELL, f(F.col("val")).alias("val")))

    def combine(self, other: Raster | float, f: Callable[[Column, Column], Column]) -> Raster:
        if not isinstance(other, Raster):
            return self.map(lambda v: f(v, F.lit(float(other))))
        if self.header != other.header:
            raise ValueError("the rasters have different headers")
        met = self.cells.join(other.cells.select(*CELL, F.col("val").alias("val2")), CELL)
        return self._with(met.select(*CELL, f(F.col("val"), F.col("val2")).alias("val")))

    def __add__(self, o):
        return self.combine(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self.combine(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self.combine(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self.combine(o, F.try_divide)

    def __pow__(self, o):
        return self.combine(o, F.pow)

    def __neg__(self):
        return self.map(lambda v: -v)

    def window(self, row0: int, row1: int, col0: int, col1: int) -> Raster:
        """Rows row0..row1-1 and columns col0..col1-1, counted from zero again."""
        inside = self.cells.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1))
        return self._with(inside.select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "val"), self.header.window(row0, row1, col0, col1))

    def subset(self, ulx: float, uly: float, lrx: float, lry: float) -> Raster:
        return self.window(*self.header.subset_bounds(ulx, uly, lrx, lry))

    def crop(self, xmin: float, xmax: float, ymin: float, ymax: float) -> Raster:
        return self.window(*self.header.crop_bounds(xmin, xmax, ymin, ymax))

    def mask(self, marked: DataFrame, value: float | None = None) -> Raster:
        """Cells of ``marked`` (row, col) take the value; the others keep theirs."""
        marks = marked.select(*CELL).distinct().withColumn("hit", F.lit(True))
        v = F.when(F.col("hit"), F.lit(value).cast("double")).otherwise(F.col("val"))
        return self._with(self.cells.join(marks, CELL, "left").select(*CELL, v.alias("val")))

    def keep(self, marked: DataFrame) -> Raster:
        return self._with(self.cells.join(marked.select(*CELL), CELL, "left_semi"))

    def drop(self, marked: DataFrame) -> Raster:
        return self._with(self.cells.join(marked.select(*CELL), CELL, "left_anti"))

    def isfinite(self) -> DataFrame:
        v = F.col("val")
        return self.cells.select(*CELL, (v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"))

    def flat(self) -> DataFrame:
        """(i, val) in row-major order of i."""
        return self.cells.select((F.col("row").cast("bigint") * self.header.nx + F.col("col")).alias("i"), "val")

    def flatnonzero(self) -> DataFrame:
        return self.flat().where("val <> 0 or val is null").select("i")

    def any(self) -> DataFrame:
        return self.cells.agg(F.coalesce(F.bool_or(F.expr("val <> 0 or val is null")), F.lit(False)).alias("any"))

    def reduce(self, what: str, axis: int | None = None) -> DataFrame:
        """sum, mean, std, median (missing where any value is), or nansum, nanmean, nanstd, nanmedian."""
        return reduced(self.cells, [] if axis is None else [CELL[1 - axis]], what)

    def downsample(self, fy: int, fx: int) -> Raster:
        """Block means; blocks at the far edges are filled up with zeros, which count."""
        keys = [F.floor(F.col("row") / fy).cast("int").alias("row"), F.floor(F.col("col") / fx).cast("int").alias("col")]
        v = F.when(F.count("*") == F.count("val"), F.sum("val") / (fy * fx))
        return self._with(self.cells.groupBy(*keys).agg(v.alias("val")), self.header.coarse(fy, fx))

    def downsample_with(self, fy: int, fx: int, f: Callable, boundary_zeros: bool = True) -> Raster:
        """Blocks reduced by a pandas function of a series (the slow path)."""
        import pandas as pd

        nx, ny = self.header.nx, self.header.ny

        def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
            lack = fy * fx - len(pdf) if boundary_zeros else 0
            v = pd.concat([pdf["val"], pd.Series([0.0] * lack)]) if lack else pdf["val"]
            return pd.DataFrame({"row": [key[0]], "col": [key[1]], "val": [float(f(v))]})

        assert nx and ny
        keyed = self.cells.select(F.floor(F.col("row") / fy).cast("int").alias("r"), F.floor(F.col("col") / fx).cast("int").alias("c"), "val")
        return self._with(keyed.groupBy("r", "c").applyInPandas(block, "row int, col int, val double"), self.header.coarse(fy, fx))

    def coords(self) -> DataFrame:
        return self.cells.select(*CELL, self.header.x(F.col("col")).alias("x"), self.header.y(F.col("row")).alias("y"), "val")

    def tiles(self, cy: int = 128, cx: int = 128) -> DataFrame:
        """Cells with their tile (ty, tx)."""
        return self.cells.select(*CELL, "val", F.floor(F.col("row") / cy).cast("int").alias("ty"), F.floor(F.col("col") / cx).cast("int").alias("tx"))

    def scale_rows(self, v: DataFrame) -> Raster:
        """diag(v) M; v: (row, d)."""
        return self._with(self.cells.join(v, "row").select(*CELL, (F.col("d") * F.col("val")).alias("val")))

    def scale_cols(self, v: DataFrame) -> Raster:
        """M diag(v); v: (col, d)."""
        return self._with(self.cells.join(v, "col").select(*CELL, (F.col("val") * F.col("d")).alias("val")))


def reduction(what: str, v: str = "val") -> Column:
    skip = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "std": F.stddev_pop(v), "median": F.median(v)}
    if what.startswith("nan"):
        return skip[what[3:]]
    return F.when(F.count("*") == F.count(v), skip[what])


def reduced(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    return df.groupBy(*keys).agg(reduction(what).alias("val"))


def meshgrid(spark, header: Header) -> DataFrame:
    """(row, col, x, y) of every cell, made in parallel."""
    n = spark.range(header.ny * header.nx)
    cells = n.select(F.expr(f"cast(id div {header.nx} as int)").alias("row"), (F.col("id") % header.nx).cast("int").alias("col"))
    return cells.select("row", "col", header.x(F.col("col")).alias("x"), header.y(F.col("row")).alias("y"))


def pad(r: Raster, n: int, mode: str = "edge", value: float = 0.0) -> Raster:
    """Each output cell takes the cell that its index maps to (see stencil.mapped)."""
    from gridloom.operators.stencil import mapped

    h = r.header
    out = meshgrid(r.cells.sparkSession, h.padded(n)).select("row", "col", mapped(F.col("row") - n, h.ny, mode).alias("r"), mapped(F.col("col") - n, h.nx, mode).alias("c"))
    src = r.cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "val", F.lit(True).alias("there"))
    met = out.join(src, ["r", "c"], "left")
    v = F.when(F.col("there"), F.col("val")).otherwise(F.lit(value)) if mode == "constant" else F.col("val")
    return Raster(met.select("row", "col", v.alias("val")), h.padded(n))
