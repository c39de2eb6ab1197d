"""Dates as Column expressions: decimal years, modified Julian days, UTM zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_days(year: Column) -> Column:
    """366 for every fourth year, centuries too."""
    return F.when(year % 4 == 0, 366.0).otherwise(365.0)


def seconds(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("bigint")


def to_decimal_year(ts: Column) -> Column:
    """Whole seconds since 1 January over the year's length."""
    start = F.date_trunc("YEAR", ts)
    return F.year(ts).cast("double") + (seconds(ts) - seconds(start)) / (year_days(F.year(ts)) * 86400.0)


def from_decimal_year(t: Column) -> Column:
    """The timestamp, cut to whole seconds."""
    year = F.floor(t).cast("int")
    s = F.floor((t - year) * year_days(year) * 86400.0).cast("bigint")
    return F.timestamp_seconds(seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) + s)


def mjd_to_date(mjd: Column) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(mjd).cast("int"))


def date_to_mjd(d: Column) -> Column:
    return F.datediff(d, F.lit("1858-11-17").cast("date"))


def mjd_to_year_day(mjd: Column) -> Column:
    d = mjd_to_date(mjd)
    return F.struct(F.year(d).alias("year"), F.dayofyear(d).alias("doy"))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hours_of_day(ts: Column) -> Column:
    return seconds_of_day(ts) / 3600.0


def daily(start: Column, end: Column) -> Column:
    """Dates from start to end."""
    return F.explode(F.sequence(start, end, F.expr("interval 1 day")))


def every(start: Column, end: Column, days: int) -> Column:
    """Dates from start in steps of days until end is reached or passed."""
    n = F.ceil(F.datediff(end, start) / days).cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.date_add(start, (i * days).cast("int"))))


def utm_zone(lon: Column) -> Column:
    """ceil((lon + 180) / 6): -180 gives zone 0."""
    return F.ceil((lon + 180) / 6).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_zone_floor(lon: Column) -> Column:
    """The variant by floor, which differs on zone edges."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg_floor(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone_floor(lon)
