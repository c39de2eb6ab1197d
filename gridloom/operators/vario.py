"""Empirical variograms over a bounded sample of points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detrended(points: DataFrame) -> DataFrame:
    """z less a surface in 1, x, y, xy, x², y²; the 21 + 6 sums are one aggregation."""
    terms = ["1.0D", "x", "y", "x*y", "x*x", "y*y"]
    sums = [F.expr(f"sum(({a})*({b}))") for i, a in enumerate(terms) for b in terms[i:]] + [F.expr(f"sum(({a})*z)") for a in terms]
    row = points.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    a = np.zeros((6, 6))
    a[np.triu_indices(6)] = row[:21]
    a = a + np.triu(a, 1).T
    m = np.linalg.lstsq(a, np.array(row[21:27], float), rcond=None)[0]
    surface = " + ".join(f"{float(c)!r}D*({t})" for c, t in zip(m, terms))
    return points.withColumn("z", F.expr(f"z - ({surface})"))


def variogram(points: DataFrame, dmax: float, bin_width: float, max_samples: int = 1000, measure: str = "semi", detrend: bool = False, key: str = "id") -> DataFrame:
    """(bin, dist, n, gamma, gstd) of pairs of at most max_samples points (id, x, y, z), those of least hash.

    Pairs are made of the sample alone, whose size is fixed. The label of a bin is the centre of the
    next one, and the last two bins are left out, as in the reference."""
    good = points.where("x is not null and y is not null and z is not null and not isnan(z) and abs(z) < double('inf')")
    sample = good.orderBy(F.md5(F.col(key).cast("string")), key).limit(max_samples)
    if detrend:
        sample = detrended(sample)
    a = sample.select(F.col(key).alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"))
    b = sample.select(F.col(key).alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("z").alias("zj"))
    pairs = a.join(F.broadcast(b), F.col("i") > F.col("j"))
    d = F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))
    v = F.pow(F.col("zi") - F.col("zj"), 2) if measure == "semi" else F.abs(F.col("zi") * F.col("zj"))
    edges = int(np.ceil(dmax / bin_width))
    binned = pairs.select((F.floor(d / bin_width) + 1).cast("int").alias("bin"), v.alias("v"))
    return binned.where(F.col("bin") <= edges - 2).groupBy("bin").agg(F.count("*").alias("n"), (0.5 * F.avg("v")).alias("gamma"), (0.5 * F.stddev_pop("v")).alias("gstd")).select("bin", ((F.col("bin") + 0.5) * bin_width).alias("dist"), "n", "gamma", "gstd")
