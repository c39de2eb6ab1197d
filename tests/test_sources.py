"""Readers, writers, streams and the command line."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import timefn
from gridloom.header import Header
from gridloom.operators.raster import Raster
from gridloom.sources import files, text
from gridloom.streaming import gram


def small(spark):
    rows = [(i, j, None if (i, j) == (3, 4) else float(i * 10 + j)) for i in range(20) for j in range(10)]
    return Raster(spark.createDataFrame(rows, "row int, col int, val double"), Header(5.0, 6.0, 2.0, -2.0, 10, 20, 3413))


def test_raster_round_trip_and_pruning(spark, tmp_path):
    files.write_raster(small(spark), str(tmp_path / "r"), tile=4)
    r = files.read_raster(spark, str(tmp_path / "r"), (4, 8, 2, 5), tile=4)
    assert r.header == Header(9.0, -2.0, 2.0, -2.0, 3, 4) and r.cells.count() == 12
    assert {x["val"] for x in r.cells.where("row = 0").collect()} == {42.0, 43.0, 44.0}
    assert "PartitionFilters: [isnotnull(ty" in r.cells._jdf.queryExecution().executedPlan().toString()


def test_envi_round_trip(spark, tmp_path):
    found = files.write_envi(small(spark), str(tmp_path / "e"), rows=8).collect()
    assert sum(f["rows"] for f in found) == 20
    r = files.read_envi(spark, str(tmp_path / "e" / "block-00000"))
    assert r.header.nx == 10 and r.header.ny == 8 and r.cells.where("val is null").count() == 1
    assert r.cells.where("row = 7 and col = 9").first()["val"] == 79.0


def test_stack_and_profile(spark, tmp_path):
    obs = spark.range(30).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), (F.col("id") % 3).cast("int").alias("k"), F.lit(1.0).alias("val"))
    files.write_stack(obs, spark.range(3).select(F.col("id").cast("int").alias("k"), F.col("id").cast("double").alias("tdec")), str(tmp_path / "s"))
    back, epochs = files.read_stack(spark, str(tmp_path / "s"), "val")
    assert back.count() == 30 and epochs.count() == 3
    files.write_profile(spark.range(3).select(F.col("id").alias("i")), str(tmp_path / "p"), 2.0)
    assert files.read_profile(spark, str(tmp_path / "p")).first()["t"] == 2.0


def test_text(spark):
    lines = spark.createDataFrame([("a key (m) = 3 ; c",), ("; only",), ("b = x = y",)], "value string")
    assert sorted(map(tuple, text.annotations(lines).collect())) == [("a key", "m", "3"), ("b", "", "x = y")]
    assert "<north>1</north>" in text.overlay_kml("n", "i.png", 1, 0, 2, 3)


def test_stream_sums_equal_batch(spark, tmp_path):
    model = timefn.Collection([timefn.Constant(), timefn.Linear(tref=2000.0)])
    for part in range(2):
        spark.range(part * 50, part * 50 + 50).select(F.lit(0).alias("row"), F.lit(0).alias("col"), (2000 + F.col("id") / 10.0).alias("tdec"), (3.0 + F.col("id") / 5.0).alias("val")).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    src = spark.readStream.schema("row int, col int, tdec double, val double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gram.gram_stream(src, model).writeStream.outputMode("complete").format("memory").queryName("gram").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from gram").first()
    a = np.array([[r["a"][0], r["a"][1]], [r["a"][1], r["a"][2]]])
    assert r["n"] == 100 and np.allclose(np.linalg.solve(a, r["b"]), [3.0, 2.0])
