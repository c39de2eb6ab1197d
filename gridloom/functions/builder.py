"""Collections built from the usual pieces."""

from __future__ import annotations

from collections.abc import Sequence

from gridloom.functions.timefn import BSpline, Collection, Constant, bspline_set, ispline_set, periodic, poly


def temporal_model(t0: float, t1: float, degree: int = 1, min_degree: int = 0, periods: Sequence[float] = (0.5, 1.0), steps: Sequence[float] = (), isplines: Sequence[int] = (32, 16, 8, 4), bsplines: Sequence[int] = (), seasonal_spacing: float | None = None) -> Collection:
    """Polynomial, periodic terms, steps, B-splines, seasonal B-splines in steps of whole days, integrated
    B-splines, over the decimal years t0 to t1. Periodic terms are zero outside; splines are cubic."""
    out = poly(t0, degree, min(min_degree, degree))
    for period in periods:
        out += periodic(t0, period, tmin=t0, tmax=t1)
    out += [Constant(tmin=s) for s in steps]
    for n in bsplines:
        out += bspline_set(t0, t1, n, 3)
    if seasonal_spacing is not None:
        step = int(seasonal_spacing * 365) / 365.25
        out += [BSpline(tref=t0 + k * step, scale=seasonal_spacing, order=3) for k in range(int((t1 - t0) / step + 1e-9) + 1)]
    for n in isplines:
        out += ispline_set(t0, t1, n, 3)
    return Collection(out)


def user_model(path: str, t0: float, t1: float) -> Collection:
    """The collection that a Python file's ``build(t0, t1)`` returns; the file runs on the driver."""
    scope: dict = {}
    with open(path) as f:
        exec(compile(f.read(), path, "exec"), scope)
    return scope["build"](t0, t1)
