"""Every registered raster and time-series query that SQL can express, against DuckDB."""

import pytest

from gridloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(agree, name):
    assert agree(QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("how", ("sum", "mean", "std", "median"))
def test_propagated_reductions_have_values_and_nulls(spark, how):
    got = {r["col"]: r["val"] for r in QUERIES[f"raster_{how}_propagate"](spark, "/root/testdata/sf0.001").collect()}
    assert all((got[c] is not None) == (c % 2 == 1) for c in range(64))


def test_flow_ensemble_solves_the_whole_profile(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert n > 40 and QUERIES["flow_ensemble"](spark, "/root/testdata/sf0.01").count() == 4 * n


def test_lateral_shear_velocities_against_numpy(spark):
    import numpy as np

    from gridloom.operators import sim
    from gridloom.operators.strain import glen_rate
    from gridloom.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    p = fx.profile(spark, sf).toPandas().sort_values("x")
    x, h, s = p["x"].to_numpy(), p["h"].to_numpy(), (p["b"] + p["h"]).to_numpy()
    grad = lambda v: np.gradient(v, x, edge_order=2)
    alpha = -grad(s)
    k = 2 * glen_rate(-10.0) / 4 * 2000.0**4 * (sim.RHO_ICE * sim.G) ** 3
    c, d = k * alpha**3, k * h * 3 * alpha**2
    vk = c - grad(d)
    got = QUERIES["lateral_shear_velocities"](spark, sf).toPandas().set_index("i").loc[p["i"]]
    for name, want in dict(u_s=c, c=c, d=d, vk=vk, pe=vk / d * (s.max() - s)).items():
        np.testing.assert_allclose(got[name], want, rtol=1e-7, atol=1e-9 * np.abs(want).max(), err_msg=name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
