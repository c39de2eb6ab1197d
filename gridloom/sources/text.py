"""Text formats: annotation files, KML coordinates, multi-segment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def annotations(lines: DataFrame, comment: str = ";") -> DataFrame:
    """(key, unit, value) of lines "key (unit) = value ; comment"; lines without " = " are skipped."""
    body = F.trim(F.substring_index("value", comment, 1))
    kept = lines.select(body.alias("line")).where(F.col("line").contains(" = "))
    left, right = F.trim(F.substring_index("line", " = ", 1)), F.trim(F.expr("substr(line, instr(line, ' = ') + 3)"))
    unit = F.regexp_extract(left, r"\(([^()]*)\)\s*$", 1)
    return kept.select(F.trim(F.regexp_replace(left, r"\([^()]*\)\s*$", "")).alias("key"), unit.alias("unit"), right.alias("value"))


def annotation_map(lines: DataFrame, comment: str = ";") -> DataFrame:
    return annotations(lines, comment).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("ann"))


def kml(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(seq, x, y) of the last coordinates element of each text (with its other columns)."""
    rest = [c for c in texts.columns if c != text_col]
    found = F.regexp_extract_all(text_col, F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), F.lit(1))
    last = texts.select(*rest, F.split(F.trim(F.element_at(found, -1)), r"\s+").alias("p")).where("p is not null")
    v = last.select(*rest, F.posexplode("p").alias("seq", "p")).withColumn("p", F.split("p", ","))
    return v.select(*rest, "seq", F.col("p")[0].cast("double").alias("x"), F.col("p")[1].cast("double").alias("y"))


def segments(lines: DataFrame, name: str) -> DataFrame:
    """(file, seq, x, y) of each file's first segment whose header holds the name. lines: file, n, value."""
    w = Window.partitionBy("file").orderBy("n")
    numbered = lines.withColumn("head", F.col("value").startswith(">")).withColumn("seg", F.sum(F.col("head").cast("int")).over(w))
    hit = numbered.where(F.col("head") & F.col("value").contains(name)).groupBy("file").agg(F.min("seg").alias("seg"))
    body = numbered.where(~F.col("head")).join(hit, ["file", "seg"]).withColumn("p", F.split(F.trim("value"), r"\s+"))
    return body.select("file", (F.row_number().over(w) - 1).alias("seq"), F.col("p")[0].cast("double").alias("x"), F.col("p")[1].cast("double").alias("y"))


def overlay_kml(name: str, image: str, north: float, south: float, east: float, west: float) -> str:
    """A ground overlay's KML text."""
    box = "".join(f"<{k}>{v:.12g}</{k}>" for k, v in (("north", north), ("south", south), ("east", east), ("west", west)))
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><GroundOverlay><name>{name}</name><Icon><href>{image}</href></Icon><LatLonBox>{box}</LatLonBox></GroundOverlay></kml>'
