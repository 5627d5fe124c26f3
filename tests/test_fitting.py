from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import by

from flowbalance.operators.fitting import demand_moments, fit_demand, merge_moments

SCHEMA = "site int, part int, volume double, price double, base_price double, demand double"


def line(site, volumes, base=2.0, demand=100.0, e=0.3, true=None):
    return [(site, k % 7, float(v), base * ((true or demand) / v) ** e, base, demand) for k, v in enumerate(volumes)]


def test_recovers_what_made_the_prices(spark):
    rows = line(1, [10, 50, 200, 900]) + line(2, [5, 6, 7], e=0.8, true=40.0)
    got = by(fit_demand(demand_moments(spark.createDataFrame(rows, SCHEMA), ["site"])), "site")
    assert got[1].elasticity == pytest.approx(0.3) and got[1].demand == pytest.approx(100) and got[1].r2 == pytest.approx(1)
    assert got[2].elasticity == pytest.approx(0.8) and got[2].demand == pytest.approx(40) and got[2].outcome == "fitted"


def test_defined_results(spark):
    nan, inf = math.nan, math.inf
    rows = line(1, [10]) + line(2, [10, 10, 10]) + line(3, [10, 20], e=0.0)
    rows += [(4, 0, 0.0, 2.0, 2.0, 100.0), (4, 0, None, 2.0, 2.0, 100.0), (4, 0, 5.0, nan, 2.0, 100.0), (4, 0, inf, 1.0, 2.0, 100.0), (4, 0, -1.0, 1.0, 2.0, 100.0)]
    got = by(fit_demand(demand_moments(spark.createDataFrame(rows, SCHEMA), ["site"])), "site")
    assert [(got[k].outcome, got[k].n, got[k].left_out) for k in (1, 2, 3, 4)] == [
        ("point", 1, 0), ("constant", 3, 0), ("inelastic", 2, 0), ("none", 0, 5)]
    assert all(got[k].elasticity is None and got[k].demand is None for k in (1, 2, 4))
    assert got[3].elasticity == pytest.approx(0) and got[3].demand is None and got[3].r2 is None
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_demand(demand_moments(empty, ["site"])).count() == 0


def test_merged_moments_equal_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(p), float(v), float(v ** -0.4 * n), 1.0, 1.0) for s in (1, 2) for p, v, n in zip(
        rng.integers(0, 9, 400), rng.uniform(1, 1e6, 400), rng.lognormal(0, 0.2, 400))]
    rows += [(2, 10, 0.0, 1.0, 1.0, 1.0)]  # a part without a usable quote
    df = spark.createDataFrame(rows, SCHEMA)
    whole = by(fit_demand(demand_moments(df, ["site"])), "site")
    parts = by(fit_demand(merge_moments(demand_moments(df, ["site", "part"]), ["site"])), "site")
    for site, w in whole.items():
        x, y = np.log([r[2] for r in rows if r[0] == site and r[2] > 0]), np.log([r[3] for r in rows if r[0] == site and r[2] > 0])
        assert w.elasticity == pytest.approx(-np.polyfit(x, y, 1)[0]) and w.r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
        assert (parts[site].n, parts[site].left_out) == (w.n, w.left_out)
        assert [parts[site].elasticity, parts[site].demand, parts[site].r2] == pytest.approx([w.elasticity, w.demand, w.r2])
