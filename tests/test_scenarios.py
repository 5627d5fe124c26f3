from __future__ import annotations

import math
from itertools import product as combinations

import pytest
from pyspark.sql import functions as F
from conftest import TINY, by

from flowbalance.constants import DEFAULT_CONFIG, STRESS_SCENARIOS
from flowbalance.operators.accounting import PLANT_INPUTS, usable
from flowbalance.operators.scenarios import (
    best_scenario,
    compare_scenarios,
    evaluate_scenarios,
    flow_invariants,
    invariants,
    scenario_grid,
    with_scenarios,
    with_usable_scenarios,
)
from flowbalance.sources import defaults, read_lots

KEYS = ["scenario_id"]


def evaluate(spark, recipes, market, scenarios):
    return evaluate_scenarios(with_scenarios(defaults(spark), scenarios), recipes, market, KEYS)


def test_stress_scenarios_are_sound(spark, recipes, market):
    results = evaluate(spark, recipes, market, STRESS_SCENARIOS)
    rows = by(invariants(results, KEYS), "scenario_id")
    assert len(rows) == 11
    assert all(r.sound and r.n_nan == 0 and r.n_negative == 0 and r.n_rows == 9
               for r in rows.values())
    for r in results.collect():
        assert abs(r.residual_fat) < 0.1 and abs(r.residual_snf) < 0.1
        assert abs(r.residual_water) < 1 and not math.isnan(r.revenue)


def test_scenarios_override_whole_groups_only(spark):
    rows = by(with_scenarios(defaults(spark), STRESS_SCENARIOS), "scenario_id")
    assert {k: rows[0][k] for k in DEFAULT_CONFIG} == DEFAULT_CONFIG
    assert (rows[2].volume, rows[2].fat_pct, rows[2].snf_pct) == (5000.0, 5.0, 9.5)
    assert (rows[10].butter_a_fat_pct, rows[10].powder_a, rows[10].cheese_a) == (78.0, "wmp", "cheddar")
    assert (rows[9].cheese_a, rows[9].cheese_b) == ("parmesan", "parmesan")


def test_cheese_type_changes_yield_and_whey(spark, recipes, market):
    pair = [(t, {"cheese_plant_a": {"cheese_a": t}, "cheese_plant_b": {"cheese_b": t}})
            for t in ("cheddar", "mozzarella")]
    rows = by(evaluate(spark, recipes, market, pair), "scenario_id", "product")
    assert rows[1, "mozzarella"].volume > rows[0, "cheddar"].volume
    assert rows[0, "swiss"].volume == 0
    assert abs(rows[0, "whey"].volume - rows[1, "whey"].volume) > 0.5


def test_richer_milk_gives_more_butter(spark, recipes, market):
    richer = [("base", {}), ("rich", {"producer": {"fat_pct": 5.0}})]
    rows = by(evaluate(spark, recipes, market, richer), "scenario_id", "product")
    assert rows[1, "butter"].volume > rows[0, "butter"].volume


def test_deltas_and_best(spark):
    results = spark.createDataFrame(
        [(1, 0, "butter", 10.0), (1, 0, "whey", 1.0), (1, 1, "butter", 12.0), (1, 1, "whey", 0.0),
         (1, 2, "butter", 12.0), (1, 2, "whey", 0.0), (2, 0, "butter", 5.0)],
        "site int, scenario_id int, product string, revenue double")
    rows = by(compare_scenarios(results, 0, ["site", "product"], ["revenue"]),
              "site", "scenario_id", "product")
    assert rows[1, 1, "butter"].delta_revenue == 2.0 and rows[1, 2, "whey"].delta_revenue == -1.0
    assert rows[1, 0, "whey"].delta_revenue == 0.0
    best = by(best_scenario(results, ["site"]), "site")
    assert (best[1].scenario_id, best[1].revenue) == (1, 12.0)
    assert best[2].scenario_id == 0


def test_invariants_count_what_is_broken(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, math.nan), (1, -2.0), (2, 0.0)], "k int, volume double")
    got = by(invariants(rows, ["k"]), "k")
    assert tuple(got[1]) == (1, 3, 1, 1, -2.0, 1.0, False)
    assert tuple(got[2]) == (2, 1, 0, 0, 0.0, 0.0, True)


def test_one_negative_flow_among_many_is_found(spark):
    rows = spark.range(1000).selectExpr("id % 2 AS k", "1D AS a", "IF(id = 501, -1D, 2D) AS `b c`")
    got = by(flow_invariants(rows, ["k"], ["a", "b c"]), "k")
    assert tuple(got[0]) == (0, 1000, 0, 0, 1.0, 2.0, True)
    assert tuple(got[1]) == (1, 1000, 0, 1, -1.0, 2.0, False)
    broken = rows.where("k = 0").withColumn("a", F.lit(math.nan))
    assert tuple(by(flow_invariants(broken, ["k"], ["a", "b c"]), "k")[0]) == (0, 1000, 500, 0, 2.0, 2.0, False)


def test_a_grid_of_millions_streams(spark):
    ranges = {c: [float(i) for i in range(60)] for c in "abcd"}
    grid = scenario_grid(spark.range(1), ranges)
    assert grid.limit(5).collect()[0].asDict() == {"id": 0, "grid_id": 0, "d": 0.0, "c": 0.0, "b": 0.0, "a": 0.0}
    assert "SEQUENCE" not in grid._jdf.queryExecution().executedPlan().toString().upper()


@pytest.mark.parametrize("partitions", [None, 3])
def test_grid_is_the_full_product(spark, partitions):
    ranges = {"a": [1.0, 2.0, 3.0], "b": ["x", "y"], "c": [True, False]}
    grid = scenario_grid(spark.range(2), ranges, ["id"], partitions)
    got = sorted((r.id, r.a, r.b, r.c) for r in grid.collect())
    assert got == sorted((i, *c) for i in range(2) for c in combinations(*ranges.values()))
    text = grid._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    if partitions:
        assert grid.rdd.getNumPartitions() == partitions


def test_settings_judged_once_give_the_lots_usable_under_each_scenario(spark):
    lots = read_lots(spark, TINY).limit(12)
    odd = [("volume", v) for v in ("-1D", "DOUBLE('NaN')", "DOUBLE('Infinity')", "1.7e308D")]
    odd += [(c, v) for c in PLANT_INPUTS for v in ("CAST(NULL AS DOUBLE)", "-0.5D", "100D", "100.5D", "DOUBLE('NaN')")]
    for column, value in odd:
        lots = lots.unionByName(read_lots(spark, TINY).limit(1).selectExpr("* EXCEPT (" + column + ")", f"{value} AS {column}"))
    scenarios = [("none", {}), ("herd", {"producer": {"fat_pct": 3.0, "snf_pct": 7.5, "volume": 100.0}}), ("solid", {"producer": {"fat_pct": 60.0, "snf_pct": 50.0}}),
                 ("cream", {"separator": {"cream_fat_pct": 30.0}}), ("beyond", {"skim_split": {"skim_split_pct": 101.0}}),
                 ("two", {"cream_split": {"cream_split_pct": 5.0}, "butter_plant_a": {"butter_a_fat_pct": 78.0, "powder_a": "wmp"}})]
    lots = lots.cache()
    want = usable(with_scenarios(lots, scenarios), PLANT_INPUTS)
    got = with_usable_scenarios(lots, scenarios)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert want.groupBy("scenario_id").count().count() == 4
