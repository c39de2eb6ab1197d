"""Raster stacks: observations (row, col, k, val, wgt) and epochs (k, tdec, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.raster import reduction

PIXEL = ["row", "col"]


def over_time(obs: DataFrame, what: str) -> DataFrame:
    """mean, median, std over the epochs of each pixel, missing values skipped."""
    return obs.groupBy(*PIXEL).agg(reduction(f"nan{what}").alias("val"))


def epoch(obs: DataFrame, k: int) -> DataFrame:
    """One epoch's cells; prunes partitions where the stack is partitioned by k."""
    return obs.where(F.col("k") == k).select(*PIXEL, "val")


def chunk(obs: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """All epochs of rows row0..row1-1, columns col0..col1-1."""
    return obs.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1))


def timeseries(obs: DataFrame, row: int, col: int, win: int, ny: int, nx: int) -> DataFrame:
    """(k, val): mean over a window of odd size around a pixel. Outside the grid every value is missing."""
    h = win // 2
    if row - h < 0 or col - h < 0 or row + h >= ny or col + h >= nx:
        return obs.select("k").distinct().withColumn("val", F.lit(None).cast("double"))
    return chunk(obs, row - h, row + h + 1, col - h, col + h + 1).groupBy("k").agg(F.avg("val").alias("val"))


def points_timeseries(obs: DataFrame, points: DataFrame, win: int = 1) -> DataFrame:
    """(id, k, val) for points (id, row, col): windows are exploded into cell keys, then joined by key."""
    h = win // 2
    around = F.sequence(F.lit(-h), F.lit(h))
    keys = points.withColumn("a", F.explode(around)).withColumn("b", F.explode(around)).select("id", (F.col("row") + F.col("a")).alias("row"), (F.col("col") + F.col("b")).alias("col"))
    return obs.join(keys, PIXEL).groupBy("id", "k").agg(F.avg("val").alias("val"))


def nearest_epoch(epochs: DataFrame, tdec: float) -> DataFrame:
    """(k): of the nearest time, the first of equal ones."""
    return epochs.agg(F.min(F.struct(F.abs(F.col("tdec") - tdec).alias("d"), "k")).alias("m")).select(F.col("m.k").alias("k"))


def nearest_epochs(epochs: DataFrame, times: DataFrame) -> DataFrame:
    """(id, k): for each wanted time; epochs are the small side. times: id, t."""
    listed = epochs.agg(F.sort_array(F.collect_list(F.struct("tdec", "k"))).alias("e"))
    best = F.array_min(F.transform("e", lambda e: F.struct(F.abs(e["tdec"] - F.col("t")).alias("d"), e["k"].alias("k"))))
    return times.crossJoin(F.broadcast(listed)).select("id", best["k"].alias("k"))


def mean_interval(epochs: DataFrame) -> DataFrame:
    return epochs.agg(((F.max("tdec") - F.min("tdec")) / (F.count("*") - 1)).alias("dt"))


def median_interval(epochs: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    step = F.col("tdec") - F.lag("tdec").over(Window.partitionBy(F.lit(1)).orderBy("tdec"))
    return epochs.select(step.alias("d")).agg(F.median("d").alias("dt"))


def shape(obs: DataFrame) -> DataFrame:
    return obs.agg(*((F.max(c) + 1).cast("bigint").alias(n) for c, n in (("k", "nt"), ("row", "ny"), ("col", "nx"))))


def combined(stacks: list[DataFrame], how: str) -> DataFrame:
    """(row, col, k, val): magnitude or sum of aligned stacks; a missing operand leaves it missing."""
    out = stacks[0].select(*PIXEL, "k", F.col("val").alias("v0"))
    for i, s in enumerate(stacks[1:], 1):
        out = out.join(s.select(*PIXEL, "k", F.col("val").alias(f"v{i}")), [*PIXEL, "k"])
    parts = [F.col(f"v{i}") for i in range(len(stacks))]

    def total(cs: list[Column]) -> Column:
        t = cs[0]
        for c in cs[1:]:
            t = t + c
        return t

    v = F.sqrt(total([p * p for p in parts])) if how == "mag" else total(parts)
    return out.select(*PIXEL, "k", v.alias("val"))


def combined_timeseries(stacks: list[DataFrame], how: str, row: int, col: int, win: int, ny: int, nx: int) -> DataFrame:
    """(k, val): each stack's mean over the window first, then their magnitude or sum."""
    series = [timeseries(s, row, col, win, ny, nx).select(F.lit(0).alias("row"), F.lit(0).alias("col"), "k", "val") for s in stacks]
    return combined(series, how).select("k", "val")


def snapshot(stacks: list[DataFrame], k: int, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """(row, col, val): the sum of reconstructed stacks at one epoch, in a window."""
    parts = [chunk(s.where(F.col("k") == k), row0, row1, col0, col1) for s in stacks]
    return combined(parts, "sum").select(*PIXEL, "val")


def difference(obs: DataFrame, k: int, reference: int) -> DataFrame:
    """A frame less a reference frame."""
    return epoch(obs, k).join(epoch(obs, reference).withColumnRenamed("val", "ref"), PIXEL).select(*PIXEL, (F.col("val") - F.col("ref")).alias("val"))


def crop_times(obs: DataFrame, epochs: DataFrame, t0: float, t1: float) -> DataFrame:
    """Epochs from the one nearest t0 up to, but without, the one nearest t1, counted from zero again."""
    a, b = nearest_epoch(epochs, t0).withColumnRenamed("k", "k0"), nearest_epoch(epochs, t1).withColumnRenamed("k", "k1")
    met = obs.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).where("k >= k0 and k < k1")
    return met.withColumn("k", (F.col("k") - F.col("k0")).cast("int")).drop("k0", "k1")


def set_slice(obs: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """obs with epoch k replaced by new (row, col, val)."""
    rest = obs.where(F.col("k") != k).select(*PIXEL, "k", "val")
    return rest.unionByName(new.select(*PIXEL, F.lit(k).cast("int").alias("k"), "val"))


def set_chunk(obs: DataFrame, new: DataFrame) -> DataFrame:
    """obs with the (row, col, k) of new replaced."""
    keys = [*PIXEL, "k"]
    return obs.join(new.select(*keys), keys, "left_anti").select(*keys, "val").unionByName(new.select(*keys, "val"))
