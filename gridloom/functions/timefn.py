"""Functions of time: each gives a Column from a column of decimal years.

Time is counted in units of ``unit`` years from ``tref``. A value counts while tmin <= t <= tmax;
side "left" ends activity at tref, "right" begins it there. ``parse`` reads collections written as
"[name(key=value,...);...]".
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

_MIN, _MAX = 1.0, 3001.0


@dataclass(frozen=True)
class Basis:
    tmin: float = _MIN
    tmax: float = _MAX

    def raw(self, t: Column) -> Column:
        raise NotImplementedError

    def limits(self) -> tuple[float, float]:
        return self.tmin, self.tmax

    def column(self, t: Column) -> Column:
        lo, hi = self.limits()
        return F.when(t.between(lo, hi), self.raw(t)).otherwise(0.0)

    def kind(self) -> str | None:
        """secular, seasonal, transient, or None for functions that no partition takes."""
        return None

    regularised = False

    def __str__(self) -> str:
        args = ",".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self) if getattr(self, f.name) != f.default)
        return f"{NAMES[type(self)]}({args})"


@dataclass(frozen=True)
class Centered(Basis):
    tref: float = 2000.0
    unit: float = 1.0
    side: str = "both"

    def limits(self):
        return (self.tref if self.side == "right" else self.tmin), (self.tref if self.side == "left" else self.tmax)

    def norm(self, t: Column) -> Column:
        return (t - F.lit(float(self.tref))) / F.lit(float(self.unit))


@dataclass(frozen=True)
class Constant(Basis):
    def raw(self, t):
        return F.lit(1.0)

    def kind(self):
        return "secular"


@dataclass(frozen=True)
class Power(Centered):
    tau: float = 1.0
    exp: float = 1.0

    def raw(self, t):
        return F.pow(self.norm(t) / F.lit(float(self.tau)), F.lit(float(self.exp)))

    def kind(self):
        return "secular"


@dataclass(frozen=True)
class Linear(Power):
    exp: float = 1.0


@dataclass(frozen=True)
class Quadratic(Power):
    exp: float = 2.0


@dataclass(frozen=True)
class Cubic(Power):
    exp: float = 3.0


@dataclass(frozen=True)
class Quartic(Power):
    exp: float = 4.0


@dataclass(frozen=True)
class Exp(Centered):
    tau: float = 1.0
    scale = 1.0

    def raw(self, t):
        return F.exp(-self.scale * self.norm(t) / F.lit(float(self.tau)))


class Exp10(Exp):
    scale = math.log(10)


class Exp2(Exp):
    scale = math.log(2)


@dataclass(frozen=True)
class Log(Centered):
    tau: float = 1.0
    scale = 1.0

    def raw(self, t):
        """Missing at the reference time itself."""
        return F.ln(F.abs(self.norm(t) / F.lit(float(self.tau)))) / self.scale

    def kind(self):
        return "transient"


class Log10(Log):
    scale = math.log(10)

    def kind(self):
        return None


class Log2(Log):
    scale = math.log(2)


@dataclass(frozen=True)
class GeoLog(Centered):
    tau: float = 1.0
    side: str = "right"

    def raw(self, t):
        return F.ln(1 + F.abs(self.norm(t) / F.lit(float(self.tau))))

    def kind(self):
        return "transient"


@dataclass(frozen=True)
class Cos(Centered):
    period: float = 1.0

    def raw(self, t):
        return F.cos(2 * math.pi * self.norm(t) / F.lit(float(self.period)))

    def kind(self):
        return "seasonal"


@dataclass(frozen=True)
class Sin(Cos):
    def raw(self, t):
        return F.sin(2 * math.pi * self.norm(t) / F.lit(float(self.period)))


@dataclass(frozen=True)
class Arctan(Centered):
    period: float = 1.0

    def raw(self, t):
        return F.atan(self.norm(t) / F.lit(float(self.period)))


def _spline(x: Column, order: int, power: int) -> Column:
    total = F.lit(0.0)
    for k in range(order + 2):
        total = total + (-1.0) ** k * math.comb(order + 1, k) * F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(float(power)))
    return total


@dataclass(frozen=True)
class BSpline(Centered):
    order: int = 2
    scale: float = 1.0
    regularised = True

    def __post_init__(self):
        if self.order < 0 or self.scale <= 0:
            raise ValueError("a spline needs an order of 0 or more and a positive scale")

    def raw(self, t):
        return _spline(self.norm(t) / self.scale + (self.order + 1) / 2, self.order, self.order) / math.factorial(self.order)

    def kind(self):
        return "seasonal"


@dataclass(frozen=True)
class ISpline(BSpline):
    def raw(self, t):
        x = self.norm(t) / self.scale + (self.order + 1) / 2
        return _spline(x, self.order, self.order + 1) * self.scale / ((self.order + 1) * math.factorial(self.order))

    def kind(self):
        return "transient"


@dataclass(frozen=True)
class PBSpline(BSpline):
    period: float = 1.0
    offset: float = 0.0
    regularised = False

    def norm(self, t):
        d = Centered.norm(self, t) - self.offset
        return d - self.period * F.rint(d / self.period)

    def kind(self):
        return None


def poly(tref: float, order: int, minorder: int = 0, **more) -> list[Basis]:
    named = {1: Linear, 2: Quadratic, 3: Cubic, 4: Quartic}
    return [Constant() if k == 0 else named[k](tref=tref, **more) if k in named else Power(tref=tref, exp=float(k), **more) for k in range(minorder, order + 1)]


def periodic(tref: float, period: float, **more) -> list[Basis]:
    return [Cos(tref=tref, period=period, **more), Sin(tref=tref, period=period, **more)]


def _knots(tmin: float, tmax: float, num: int) -> tuple[list[float], float]:
    step = (tmax - tmin) / (num - 1)
    return [tmin + k * step for k in range(num)], step


def bspline_set(tmin: float, tmax: float, num: int, order: int = 2) -> list[Basis]:
    at, step = _knots(tmin, tmax, num)
    return [BSpline(tref=x, scale=step, order=order) for x in at]


def ispline_set(tmin: float, tmax: float, num: int, order: int = 2) -> list[Basis]:
    at, step = _knots(tmin, tmax, num)
    return [ISpline(tref=x, scale=step, order=order) for x in at]


def pbspline_set(tref: float, num: int, period: float = 1.0, order: int = 2) -> list[Basis]:
    return [PBSpline(tref=tref, scale=period / num, order=order, period=period, offset=k * period / num) for k in range(num)]


REGISTRY: dict[str, type | object] = {
    "constant": Constant, "power": Power, "linear": Linear, "quadratic": Quadratic, "cubic": Cubic, "quartic": Quartic, "exp": Exp, "exp10": Exp10, "exp2": Exp2, "log": Log, "log10": Log10, "log2": Log2, "geolog": GeoLog,
    "cos": Cos, "sin": Sin, "arctan": Arctan, "bspline": BSpline, "ispline": ISpline, "pbspline": PBSpline, "poly": poly, "periodic": periodic, "bsplineset": bspline_set, "isplineset": ispline_set, "pbsplineset": pbspline_set,
}
NAMES = {f: n for n, f in REGISTRY.items() if isinstance(f, type)}


def register(name: str, f) -> None:
    REGISTRY[name] = f


@dataclass
class Collection:
    """Distinct functions in order; equal ones (by their text) are refused."""

    functions: list[Basis] = field(default_factory=list)

    def append(self, f: Basis) -> Collection:
        if str(f) in map(str, self.functions):
            raise ValueError(f"{f} is there already")
        self.functions.append(f)
        return self

    def __add__(self, other: Collection | list[Basis]) -> Collection:
        out = Collection(list(self.functions))
        for f in getattr(other, "functions", other):
            out.append(f)
        return out

    def __len__(self):
        return len(self.functions)

    def __getitem__(self, i):
        return self.functions[i]

    def columns(self, t: Column) -> list[Column]:
        return [f.column(t) for f in self.functions]

    def partitions(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {k: [] for k in ("secular", "seasonal", "transient", "step")}
        for i, f in enumerate(self.functions):
            if f.kind():
                out[f.kind()].append(i)
        return out | {"reg": [i for i, f in enumerate(self.functions) if f.regularised]}

    def timescales(self) -> list[float | None]:
        return [getattr(f, "period", None) or getattr(f, "scale", None) if isinstance(f, (Cos, BSpline, Arctan)) else getattr(f, "tau", None) for f in self.functions]

    def __str__(self) -> str:
        return "[" + ";".join(map(str, self.functions)) + "]"


def parse(text: str) -> Collection:
    """A collection from its text."""
    m = re.fullmatch(r"\s*\[(.*)\]\s*", text, re.S)
    out = Collection()
    for part in filter(None, (p.strip() for p in (m[1] if m else text).split(";"))):
        call = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", part, re.S)
        if not call or call[1].lower() not in REGISTRY:
            raise ValueError(f"no time function in {part!r}")
        args = {}
        for item in filter(None, (a.strip() for a in (call[2] or "").split(","))):
            k, v = (x.strip() for x in item.split("=", 1))
            args[k] = v.strip("'\"") if re.fullmatch(r"['\"]?[A-Za-z]\w*['\"]?", v) else (int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v))
        made = REGISTRY[call[1].lower()](**args)
        for f in made if isinstance(made, list) else [made]:
            out.append(f)
    return out
