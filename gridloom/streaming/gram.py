"""Incremental decomposition: the normal-equation sums are additive, so a stream of observations
keeps them per pixel and any state of them can be solved. Beyond the reference, which has no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.timefn import Collection


def gram_stream(obs: DataFrame, model: Collection) -> DataFrame:
    """obs: a stream of (row, col, tdec, val). (row, col, n, a, b) in update or complete mode."""
    p = len(model)
    g = [c.cast("double") for c in model.columns(F.col("tdec"))]
    rows = obs.where("val is not null").select("row", "col", "val", *(c.alias(f"g{i}") for i, c in enumerate(g)))
    sums = rows.groupBy("row", "col").agg(F.count("*").alias("n"), *(F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(F.col(f"g{i}") * F.col("val")).alias(f"b{i}") for i in range(p)))
    return sums.select("row", "col", "n", F.array(*(f"a{i}_{j}" for i in range(p) for j in range(i, p))).alias("a"), F.array(*(f"b{i}" for i in range(p))).alias("b"))


def windowed_means(obs: DataFrame, lateness: str = "1 day", width: str = "7 days") -> DataFrame:
    """obs: a stream of (row, col, ts, val). Means by tumbling event-time window, late rows dropped by watermark."""
    timed = obs.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width), "row", "col").agg(F.avg("val").alias("val"), F.count("val").alias("n")).select(F.col("window.start").alias("start"), "row", "col", "val", "n")
