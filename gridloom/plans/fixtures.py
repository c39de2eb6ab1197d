"""Rasters, stacks and series made of the test tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dates import to_decimal_year
from gridloom.header import Header
from gridloom.operators.raster import Raster


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ny(spark: SparkSession, d: str) -> int:
    return _t(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def grid(spark: SparkSession, d: str) -> Raster:
    cells = _t(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "e")).select("row", "col", (F.col("e").cast("double") * 0.1 + F.lit(1.0) / 3).alias("val"))
    return Raster(cells, Header(0.0, 0.0, 100.0, -100.0, 64, ny(spark, d)))


def holed(spark: SparkSession, d: str) -> Raster:
    g = grid(spark, d)
    return Raster(g.cells.withColumn("val", F.when((F.col("row") * 64 + F.col("col")) % 13 != 0, F.col("val"))), g.header)


def partly_holed(spark: SparkSession, d: str) -> Raster:
    """Holes in even columns alone: the odd ones are whole."""
    g = grid(spark, d)
    return Raster(g.cells.withColumn("val", F.when(((F.col("row") * 64 + F.col("col")) % 13 != 0) | (F.col("col") % 2 == 1), F.col("val"))), g.header)


def velocity(spark: SparkSession, d: str) -> DataFrame:
    c = grid(spark, d).cells
    vx = c.where("col < 32").select("row", "col", F.col("val").alias("vx"))
    return vx.join(c.where("col >= 32").select("row", (F.col("col") - 32).alias("col"), F.col("val").alias("vy")), ["row", "col"])


def pixstack(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.expr("cast(user_id div 10 as int)").alias("row"), (F.col("user_id") % 10).cast("int").alias("col"), (F.dayofyear("ts") - 1).cast("int").alias("k"), "value")
    return e.groupBy("row", "col", "k").agg(F.avg("value").alias("val"), F.count("*").cast("double").alias("wgt"))


def pix_epochs(spark: SparkSession, d: str) -> DataFrame:
    return pixstack(spark, d).select("k").distinct().select("k", (2024.0 + F.col("k") / 366.0).alias("tdec"))


def moncube(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("row"), (F.col("l_linenumber") - 1).cast("int").alias("col"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("k"), "l_extendedprice")
    return e.groupBy("row", "col", "k").agg(F.avg("l_extendedprice").alias("val"), F.count("*").cast("double").alias("wgt"))


def mon_epochs(spark: SparkSession, d: str) -> DataFrame:
    return moncube(spark, d).select("k").distinct().select("k", (1995.0 + F.col("k") / 12.0).alias("tdec"))


def tdec(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", to_decimal_year(F.col("ts")).alias("tdec"))


def scatter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 97).cast("double") * 100).alias("x"), (F.col("p_size").cast("double") * 100).alias("y"), F.col("p_retailprice").alias("z"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """A flowline a customer nation: thickness from account balances in order of keys."""
    c = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("i"), "s_acctbal")
    x = F.col("i") * 1000.0 + (F.col("i") % 3) * 50.0
    return c.select("i", x.alias("x"), (800.0 + F.col("s_acctbal") * 0.01).alias("h"), (200.0 - F.col("i") * 3.0).alias("b"), (100.0 + F.col("i") * 2.0 + F.col("s_acctbal") * 0.001).alias("u"))


def line(spark: SparkSession, d: str) -> DataFrame:
    """A polyline along supplier keys."""
    return profile(spark, d).select(F.col("i").alias("seq"), "x", (F.col("h") * 10).alias("y"))


SQL = {
    "grid": "grid AS (SELECT CAST(vec_id AS INT) AS row, CAST(unnest(range(len(embedding))) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) * 0.1::DOUBLE + 1.0::DOUBLE / 3 AS val FROM embeddings)",
    "hdr": "hdr AS (SELECT CAST(max(vec_id) + 1 AS INT) AS ny, 64 AS nx FROM embeddings)",
    "holed": "holed AS (SELECT row, col, CASE WHEN (row * 64 + col) % 13 <> 0 THEN val END AS val FROM grid)",
    "partly": "partly AS (SELECT row, col, CASE WHEN (row * 64 + col) % 13 <> 0 OR col % 2 = 1 THEN val END AS val FROM grid)",
    "vel": "vel AS (SELECT a.row, a.col, a.val AS vx, b.val AS vy FROM grid a JOIN grid b ON a.row = b.row AND b.col = a.col + 32 WHERE a.col < 32)",
    "pix": "pix AS (SELECT CAST(user_id // 10 AS INT) AS row, CAST(user_id % 10 AS INT) AS col, CAST(dayofyear(ts) - 1 AS INT) AS k, avg(value) AS val, CAST(count(*) AS DOUBLE) AS wgt FROM events GROUP BY 1, 2, 3)",
    "pixe": "pixe AS (SELECT DISTINCT k, 2024.0::DOUBLE + k / 366.0::DOUBLE AS tdec FROM pix)",
    "mon": "mon AS (SELECT CAST(l_suppkey AS INT) AS row, CAST(l_linenumber - 1 AS INT) AS col, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS k, avg(l_extendedprice) AS val, CAST(count(*) AS DOUBLE) AS wgt FROM lineitem GROUP BY 1, 2, 3)",
    "mone": "mone AS (SELECT DISTINCT k, 1995.0::DOUBLE + k / 12.0::DOUBLE AS tdec FROM mon)",
    "sup": "sup AS (SELECT CAST(count(*) + 1 AS INT) AS ny FROM supplier)",
    "tdec": "tdec AS (SELECT event_id, CAST(year(ts) AS DOUBLE) + CAST(epoch_us(date_trunc('second', ts)) // 1000000 - epoch_us(CAST(date_trunc('year', ts) AS TIMESTAMP)) // 1000000 AS DOUBLE) / ((CASE WHEN year(ts) % 4 = 0 THEN 366.0 ELSE 365.0 END)::DOUBLE * 86400.0::DOUBLE) AS tdec FROM events)",
    "scat": "scat AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) * 100 AS x, CAST(p_size AS DOUBLE) * 100 AS y, p_retailprice AS z FROM part)",
    "prof": "prof AS (SELECT CAST(s_suppkey AS INT) AS i, s_suppkey * 1000.0::DOUBLE + (s_suppkey % 3) * 50.0::DOUBLE AS x, 800.0::DOUBLE + s_acctbal * 0.01::DOUBLE AS h, 200.0::DOUBLE - s_suppkey * 3.0::DOUBLE AS b, 100.0::DOUBLE + s_suppkey * 2.0::DOUBLE + s_acctbal * 0.001::DOUBLE AS u FROM supplier)",
    "line": "line AS (SELECT i AS seq, x, h * 10 AS y FROM prof)",
}
_NEEDS = {"holed": ["grid"], "partly": ["grid"], "vel": ["grid"], "pixe": ["pix"], "mone": ["mon"], "line": ["prof"]}


def with_(*names: str) -> str:
    order: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, []), n):
            if m not in order:
                order.append(m)
    return "WITH " + ",\n".join(SQL[n] for n in order)
