from __future__ import annotations

import numpy as np
import pytest

from flowbalance.operators.frontier import frontier
from flowbalance.sources.sinks import with_checkpoints


@pytest.fixture(autouse=True)
def folder(spark):
    with_checkpoints(spark)


def brute(rows):
    """Ids of rows (id, key, a larger, b smaller) that no other row of the key beats."""
    good = [r for r in rows if r[2] is not None and r[3] is not None and r[2] == r[2] and r[3] == r[3]]
    return {r[0] for r in good if not any(
        o[1] == r[1] and o[2] >= r[2] and o[3] <= r[3] and (o[2] > r[2] or o[3] < r[3]) for o in good)}


@pytest.mark.parametrize("block", [4, 20_000])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = [(k, None if k % 5 == 4 else k % 5, float(a), float(b)) for k, (a, b) in enumerate(rng.integers(0, 12, (300, 2)))]
    rows += [(300 + k, 1, 50.0 + k, 50.0 + k) for k in range(40)]  # none beats another
    rows += [(400, 0, None, 1.0), (401, 0, float("nan"), -5.0), (402, 0, float("inf"), 99.0), (403, 9, 0.0, 0.0), (404, 9, -0.0, -0.0)]
    df = spark.createDataFrame(rows, "id long, _cell long, a double, b double")
    got = frontier(df, ["_cell"], ["a"], ["b"], block=block)
    assert got.columns == df.columns
    found = [r.id for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_without_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (1, 1.0)], "a int, b double")
    assert sorted(map(tuple, frontier(df, [], ["a", "b"]).collect())) == [(1, 2.0), (1, 2.0), (2, 1.0)]
    assert frontier(df.where("false"), [], ["a", "b"]).count() == 0


def test_plan_has_no_cross_join(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS a", "-id AS b")
    plan = frontier(df, ["k"], ["a"], ["b"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
