"""Helpers that the training-data operators share: tables, the shared folder, sorted runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch sent to a Python worker: texts of some kilobytes make batches of a few megabytes.
BATCH_ROWS = "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default of 10,000 rows a batch, a smaller one is set: with long texts
    the default's buffers, held in the JVM and in the worker at once, take hundreds of megabytes a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where the session
    names none and runs in one JVM (tests) a temporary folder stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        jvm_dir = context._jsc.sc().getCheckpointDir()
    return jvm_dir.get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, the size is
    known to the planner, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by one pass: the planner's estimates of derived tables may be far off."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("bigint"))).first()[0] or 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bits of the map that tells which rows may meet a key: 512 rows of 4 kB, whatever the data.
MAP_BITS = 1 << 24


def may_meet(rows: DataFrame, wanted: DataFrame, key: str, out: str) -> DataFrame:
    """rows with a boolean column out: false where no row of wanted has their key, so they need not be
    shuffled to find out. A bit map of hashed keys is broadcast; its size is fixed. Once most bits are
    set it spares little, but never loses a row."""
    place = (F.pmod(F.xxhash64(F.col(key)), F.lit(MAP_BITS)) + 1).cast("bigint")
    bucket, at = unused(rows, "map_bucket", "map_at")
    bits, held = unused(rows, "map_bits", "map_held")
    maps = wanted.select(F.bitmap_bucket_number(place).alias(bucket), F.bitmap_bit_position(place).alias(at)).groupBy(bucket).agg(F.bitmap_construct_agg(at).alias(bits))
    shown = rows.columns
    met = rows.withColumns({bucket: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(F.broadcast(maps), bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col(at) % 8).cast("int") + 1)) != 0
    return met.select(*(f"`{c}`" for c in shown), F.coalesce(one, F.lit(False)).alias(out))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
