"""Rasters and stacks on disk.

The native form is Parquet partitioned by tile or epoch with the header beside it as a one-row
table. Flat binary rasters with a text header (ENVI) are read as a Python data source, split by
rows, and written a block of rows a file by the tasks.
"""

from __future__ import annotations

import re
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.header import Header
from gridloom.operators.raster import Raster

ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}


def write_raster(r: Raster, path: str, tile: int = 128, mode: str = "errorifexists") -> None:
    tiles = r.tiles(tile, tile)
    tiles.repartition("ty", "tx").sortWithinPartitions("row", "col").write.mode(mode).partitionBy("ty").parquet(f"{path}/cells")
    spark = r.cells.sparkSession
    spark.createDataFrame([asdict(r.header)], "xstart double, ystart double, dx double, dy double, nx int, ny int, epsg int, units string").coalesce(1).write.mode(mode).parquet(f"{path}/header")


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = 128) -> Raster:
    """The window (row0, row1, col0, col1) prunes tiles and reaches the Parquet scan."""
    header = Header(**spark.read.parquet(f"{path}/header").first().asDict())
    cells = spark.read.parquet(f"{path}/cells")
    if window:
        cells = cells.where(F.col("ty").between(window[0] // tile, (window[1] - 1) // tile))
    r = Raster(cells.select("row", "col", "val"), header)
    return r.window(*window) if window else r


def write_stack(obs: DataFrame, epochs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    obs.repartition("k").write.mode(mode).partitionBy("k").parquet(f"{path}/obs")
    epochs.coalesce(1).write.mode(mode).parquet(f"{path}/epoch")


def read_stack(spark: SparkSession, path: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(observations, epochs); named columns alone are read."""
    obs = spark.read.parquet(f"{path}/obs")
    return (obs.select("row", "col", "k", *columns) if columns else obs), spark.read.parquet(f"{path}/epoch")


def write_profile(p: DataFrame, path: str, t: float = 0.0, mode: str = "errorifexists") -> None:
    p.withColumn("t", F.lit(t)).write.mode(mode).parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.parquet(path)
    return p if "t" in p.columns else p.withColumn("t", F.lit(0.0))


def parse_envi(text: str) -> dict:
    """Keys of an ENVI header; map info gives the header."""
    found = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}
    out = {"nx": int(found["samples"]), "ny": int(found["lines"]), "bands": int(found.get("bands", 1)), "type": ENVI_TYPES[int(found["data type"])], "order": "<" if found.get("byte order", "0") == "0" else ">", "offset": int(found.get("header offset", 0)), "interleave": found.get("interleave", "bsq").lower()}
    info = [x.strip() for x in found.get("map info", "{}").strip("{}").split(",")]
    if len(info) >= 7:
        out["header"] = Header(float(info[3]), float(info[4]), float(info[5]), -float(info[6]), out["nx"], out["ny"])
    else:
        out["header"] = Header(0.0, 0.0, 1.0, -1.0, out["nx"], out["ny"])
    return out


def envi_header(h: Header, kind: int = 5, bands: int = 1) -> str:
    return f"ENVI\nsamples = {h.nx}\nlines = {h.ny}\nbands = {bands}\nheader offset = 0\nfile type = ENVI Standard\ndata type = {kind}\ninterleave = bsq\nbyte order = 0\nmap info = {{Arbitrary, 1, 1, {h.xstart!r}, {h.ystart!r}, {h.dx!r}, {-h.dy!r}}}\n"


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _EnviReader(DataSourceReader):
    def __init__(self, options):
        from pyarrow import fs

        self.path, self.band = options["path"], int(options.get("band", 1))
        self.block = int(options.get("rows", 256))
        files, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with files.open_input_stream(options.get("header", f"{root}.hdr")) as f:
            self.info = parse_envi(f.read().decode())

    def partitions(self):
        return [_Rows(a, min(a + self.block, self.info["ny"])) for a in range(0, self.info["ny"], self.block)]

    def read(self, part):
        import pyarrow as pa
        from pyarrow import fs

        i, nx = self.info, self.info["nx"]
        kind = np.dtype(i["order"] + i["type"])
        files, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with files.open_input_file(root) as f:
            for row in range(part.first, part.last):
                f.seek(i["offset"] + ((self.band - 1) * i["ny"] + row) * nx * kind.itemsize)
                v = np.frombuffer(f.read(nx * kind.itemsize), kind).astype("f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(nx, row, "i4")), pa.array(np.arange(nx, dtype="i4")), pa.array(v, mask=np.isnan(v))], names=["row", "col", "val"])


class EnviSource(DataSource):
    """spark.read.format("envi").load(path): options band, header, rows (a partition)."""

    @classmethod
    def name(cls):
        return "envi"

    def schema(self):
        return "row int, col int, val double"

    def reader(self, schema):
        return _EnviReader(self.options)


def read_envi(spark: SparkSession, path: str, band: int = 1) -> Raster:
    spark.dataSource.register(EnviSource)
    header = _EnviReader({"path": path}).info["header"]
    return Raster(spark.read.format("envi").option("band", band).load(path), header)


def write_envi(r: Raster, path: str, rows: int = 256) -> DataFrame:
    """Blocks of rows as flat float64 files path/block-N with their text headers; (file, rows) of each."""
    h = r.header

    def run(key, pdf):
        import pandas as pd
        from pyarrow import fs

        first = int(key[0]) * rows
        n = min(rows, h.ny - first)
        a = np.full((n, h.nx), np.nan)
        a[pdf["row"].to_numpy() - first, pdf["col"].to_numpy()] = pdf["val"].to_numpy(dtype=float)
        files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        files.create_dir(root, recursive=True)
        name = f"{root}/block-{int(key[0]):05d}"
        for suffix, raw in (("", a.astype("<f8").tobytes()), (".hdr", envi_header(h.window(first, first + n, 0, h.nx)).encode())):
            with files.open_output_stream(f"{name}{suffix}.tmp") as f:
                f.write(raw)
            files.move(f"{name}{suffix}.tmp", f"{name}{suffix}")
        return pd.DataFrame({"file": [name], "rows": [n]})

    keyed = r.cells.withColumn("blk", F.floor(F.col("row") / rows).cast("int"))
    return keyed.groupBy("blk").applyInPandas(run, "file string, rows bigint")
