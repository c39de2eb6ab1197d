"""Strain rates and stresses of a velocity field: two window passes and one wide projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.stencil import gradient

YEAR = 365.25 * 86400.0


def glen_rate(temp_c: Column | float, kpa: bool = False) -> Column | float:
    """Rate factor A(T) per year and Pa^3 (or kPa^3), a sum of two exponentials of the absolute temperature;
    a number for a number."""
    exp, t = (math.exp if isinstance(temp_c, (int, float)) else F.exp), temp_c + 273.15
    a = 5.3e-15 * YEAR * (1.2478766e-39 * exp(0.32769 * t) + 1.9463011e-10 * exp(0.07205 * t))
    return a if kpa else a * 1.0e-9


def velocity_gradients(v: DataFrame, dx: float, dy: float, edge_order: int = 2) -> DataFrame:
    """v: row, col, vx, vy. Adds ux, uy, vxx (dvy/dx), vyy (dvy/dy)."""
    for value, out_x, out_y in (("vx", "dudx", "dudy"), ("vy", "dvdx", "dvdy")):
        v = gradient(v, "col", ["row"], dx, edge_order, value, out_x)
    for value, out_y in (("vx", "dudy"), ("vy", "dvdy")):
        v = gradient(v, "row", ["col"], dy, edge_order, value, out_y)
    return v


def strain(v: DataFrame, dx: float = 100.0, dy: float = -100.0, rotate: bool = False, eps_min: float = 1e-5, edge_order: int = 2) -> DataFrame:
    """e_xx, e_yy, e_xy, dilatation, effective, shear_magnitude, e_max, e_min, principal_angle. effective and
    dilatation use the gradients as they are, also when the tensor is turned along the flow."""
    g = velocity_gradients(v, dx, dy, edge_order)
    g = g.withColumn("e_xx", F.col("dudx")).withColumn("e_yy", F.col("dvdy")).withColumn("e_xy", 0.5 * (F.col("dudy") + F.col("dvdx")))
    g = g.withColumn("dilatation", F.col("dudx") + F.col("dvdy"))
    exy = 0.5 * (F.col("dudy") + F.col("dvdx"))
    g = g.withColumn("effective", F.sqrt(F.col("dudx") ** 2 + F.col("dvdy") ** 2 + exy * exy + F.col("dudx") * F.col("dvdy") + eps_min**2))
    if rotate:
        c, s = F.cos(F.atan2("vy", "vx")), F.sin(F.atan2("vy", "vx"))
        xx, yy, xy = F.col("e_xx"), F.col("e_yy"), F.col("e_xy")
        g = g.withColumns({"e_xx": c * c * xx + 2 * c * s * xy + s * s * yy, "e_yy": s * s * xx - 2 * c * s * xy + c * c * yy, "e_xy": c * s * (yy - xx) + (c * c - s * s) * xy})
    trace = F.col("e_xx") + F.col("e_yy")
    g = g.withColumn("shear_magnitude", F.sqrt(0.25 * trace**2 - (F.col("e_xx") * F.col("e_yy") - F.col("e_xy") ** 2)))
    return g.withColumns({"e_max": 0.5 * trace + 0.5 * F.col("shear_magnitude"), "e_min": 0.5 * trace - 0.5 * F.col("shear_magnitude"), "principal_angle": F.degrees(0.5 * F.atan2(2 * F.col("e_xy"), F.col("e_xx") - F.col("e_yy")))})


def stress(s: DataFrame, a_glen: float | None = None, n: float = 3.0) -> DataFrame:
    """eta, t_xx, t_yy, t_xy from strain()."""
    a = F.lit(float(a_glen if a_glen is not None else glen_rate(-10.0)))
    b = F.pow(a, F.lit(-1.0 / n))
    s = s.withColumn("eta", 0.5 * b * F.pow("effective", F.lit((1 - n) / n)))
    return s.withColumns({"t_xx": 2 * F.col("eta") * F.col("e_xx"), "t_yy": 2 * F.col("eta") * F.col("e_yy"), "t_xy": 2 * F.col("eta") * F.col("e_xy")})


def membrane(s: DataFrame, dx: float, dy: float, rho_ice: float = 917.0, g: float = 9.80665, edge_order: int = 2, rotate: bool = False) -> DataFrame:
    """Membrane terms tmxx, tmxy, tmyy, tmyx and driving stress tdx, tdy; needs stress() and h
    (thickness); without b (bed) the thickness stands for the surface."""
    h = F.col("h")
    bed = F.col("b") if "b" in s.columns else F.lit(0.0)
    s = s.withColumns({"q_xx": h * (2 * F.col("t_xx") + F.col("t_yy")), "q_yy": h * (2 * F.col("t_yy") + F.col("t_xx")), "q_xy": h * F.col("t_xy"), "surface": bed + h})
    for value, out in (("q_xx", "tmxx"), ("q_xy", "tmyx"), ("surface", "sx")):
        s = gradient(s, "col", ["row"], dx, edge_order, value, out)
    for value, out in (("q_xy", "tmxy"), ("q_yy", "tmyy"), ("surface", "sy")):
        s = gradient(s, "row", ["col"], dy, edge_order, value, out)
    s = s.withColumns({"tdx": -rho_ice * g * h * F.col("sx"), "tdy": -rho_ice * g * h * F.col("sy")}).drop("q_xx", "q_yy", "q_xy", "surface", "sx", "sy")
    if rotate:
        speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
        c, t = F.try_divide("vx", speed), F.try_divide("vy", speed)
        s = s.withColumns({"tdx": c * F.col("tdx") + t * F.col("tdy"), "tdy": -t * F.col("tdx") + c * F.col("tdy")})
    return s
