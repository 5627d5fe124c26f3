from __future__ import annotations

import pytest
from conftest import TINY, by
from pyspark.sql import functions as F

from flowbalance.operators.accounting import closure_check, component_masses
from flowbalance.operators.fanout import (
    allocate,
    checked_allocations,
    churn_split,
    split_to_target,
    unallocated,
    yield_split,
)
from flowbalance.operators.lookup import unknown_recipe
from flowbalance.sources import allocations, read_lots

FLOW = "id int, volume double, fat double, snf double, water double"
MASSES = ("volume", "fat", "snf", "water")


@pytest.fixture
def milk(spark):
    return spark.createDataFrame([(1, 1000.0, 40.0, 90.0, 870.0)], FLOW)


def masses(row):
    return [row[m] for m in MASSES]


def test_split_meets_target_and_conserves(milk):
    rows = by(split_to_target(milk, 40.0), "kind")
    cream, skim = rows["cream"], rows["skim"]
    assert cream.fat / cream.volume == pytest.approx(0.40)
    assert skim.fat / skim.volume == pytest.approx(0.001)
    assert masses(cream) == pytest.approx([97.744361, 39.097744, 8.796992, 49.849624], abs=1e-6)
    for i, total in enumerate((1000, 40, 90, 870)):
        assert masses(cream)[i] + masses(skim)[i] == pytest.approx(total, abs=1e-6)
    assert all(r.closed for r in closure_check(split_to_target(milk, 40.0)).collect())


def test_higher_target_gives_less_cream(milk):
    low, high = (by(split_to_target(milk, t), "kind")["cream"].volume for t in (35.0, 42.0))
    assert high < low


def test_split_of_nothing_and_of_an_impossible_target(spark):
    flows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], FLOW)
    assert all(masses(r) == [0, 0, 0, 0] for r in split_to_target(flows, 40.0).collect())
    one = spark.createDataFrame([(1, 100.0, 4.0, 9.0, 87.0)], FLOW)
    for target in (0.1, "CAST(NULL AS DOUBLE)"):
        rows = by(split_to_target(one, target), "kind")
        assert masses(rows["cream"]) == [0, 0, 0, 0]
        assert masses(rows["skim"]) == [100.0, 4.0, 9.0, 87.0]


def test_yield_of_whole_milk_by_recipe(spark, milk, recipes):
    want = {"cheddar": (87.680672, 911.495798, 0.823529),
            "mozzarella": (82.671301, 905.370804, 11.957895),
            "swiss": (79.490323, 913.809677, 6.7), "parmesan": (56.451429, 925.748571, 17.8)}
    types = spark.createDataFrame([(t,) for t in want], "cheese_type string")
    rows = by(yield_split(milk.crossJoin(types), recipes), "cheese_type", "kind")
    for cheese, volumes in want.items():
        got = [rows[cheese, k].volume for k in ("cheese", "whey", "excess_cream")]
        assert got == pytest.approx(volumes, abs=1e-6)
        assert sum(got) == pytest.approx(1000, abs=1e-2)
        assert sum(rows[cheese, k].fat for k in ("cheese", "whey", "excess_cream")) == pytest.approx(40)
        assert sum(rows[cheese, k].snf for k in ("cheese", "whey", "excess_cream")) == pytest.approx(90)
    moisture = {c: rows[c, "cheese"].water / rows[c, "cheese"].volume for c in want}
    assert moisture["cheddar"] == pytest.approx(0.37) and moisture["parmesan"] < moisture["mozzarella"]


def test_yield_of_skim_closes_for_all_types(spark, recipes):
    skim = spark.createDataFrame(
        [(i, 900.0, 0.9, 83.7, 815.4, t) for i, t in enumerate(
            ("cheddar", "mozzarella", "swiss", "parmesan"))], FLOW + ", cheese_type string")
    assert all(r.closed for r in closure_check(yield_split(skim, recipes)).collect())


def test_surplus_up_to_the_threshold_is_dropped(spark, recipes):
    # casein 29.6, swiss target fat 37; 0.0005 lb above it
    flows = spark.createDataFrame(
        [(1, 1000.0, 37.0005, 100.0, 862.9995, "swiss")], FLOW + ", cheese_type string")
    rows = by(yield_split(flows, recipes), "kind")
    assert masses(rows["excess_cream"]) == [0, 0, 0, 0]
    assert sum(r.fat for r in rows.values()) == pytest.approx(37.0, abs=1e-9)


def test_unknown_recipes_are_listed(spark, recipes):
    flows = spark.createDataFrame([(1, "cheddar"), (2, "brie"), (3, None)],
                                  "id int, cheese_type string")
    assert {r.id for r in unknown_recipe(flows, recipes).collect()} == {2, 3}


def test_churn_by_powder_type(spark):
    cream = spark.createDataFrame(
        [(i, 100.0, 40.0, 5.0, 55.0, 82.0, p) for i, p in enumerate(("nfdm", "bmp", "wmp"))],
        FLOW + ", butter_fat_pct double, powder_type string")
    rows = by(churn_split(cream), "powder_type", "kind")
    for powder in ("nfdm", "bmp"):
        butter, rest = rows[powder, "butter"], rows[powder, "powder"]
        assert (butter.volume, rest.volume) == pytest.approx((48.292683, 51.707317), abs=1e-6)
        assert butter.fat / butter.volume == pytest.approx(0.82)
        assert rest.fat / rest.volume < 0.02 and rest.product == powder
    butter, rest = rows["wmp", "butter"], rows["wmp", "powder"]
    assert (butter.volume, butter.fat) == pytest.approx((30.665788, 21.973105), abs=1e-6)
    assert rest.fat / rest.volume == pytest.approx(0.26)
    for powder in ("nfdm", "bmp", "wmp"):
        for i, total in enumerate((100, 40, 5, 55)):
            assert sum(masses(rows[powder, k])[i] for k in ("butter", "powder")) == pytest.approx(total)
    assert all(r.closed for r in closure_check(churn_split(cream)).collect())


def test_allocation_shares_and_remainder(spark, milk):
    routes = allocations(spark, [("x", "a", 0, 0.1), ("x", "b", 1, 0.2), ("x", "c", 2, 0.7)])
    rows = by(allocate(milk.selectExpr("*", "'x' AS node"), routes), "to_node")
    assert [rows[n].volume for n in "abc"] == pytest.approx([100, 200, 700])
    assert sum(rows[n].water for n in "abc") == pytest.approx(870)


def test_bad_allocations_are_rejected_with_their_flows(spark, milk):
    routes = allocations(spark, [
        ("over", "a", 0, 1.2), ("over", "b", 1, -0.2), ("short", "a", 0, 0.5),
        ("short", "b", 1, 0.4), ("fine", "a", 0, 0.6), ("fine", "b", 1, 0.4)])
    valid = {r.from_node: r.valid for r in checked_allocations(routes).collect()}
    assert valid == {"over": False, "short": False, "fine": True}
    nodes = spark.createDataFrame([("over",), ("short",), ("fine",), ("none",)], "node string")
    flows = milk.crossJoin(nodes)
    assert {r.node for r in allocate(flows, routes).collect()} == {"fine"}
    assert {r.node for r in unallocated(flows, routes).collect()} == {"over", "short", "none"}


def test_a_missing_fraction_spoils_the_node(spark, milk):
    routes = allocations(spark, [("n", "a", 0, 0.5), ("n", "b", 1, None), ("n", "c", 2, 0.5)])
    flows = milk.withColumn("node", F.lit("n"))
    assert allocate(flows, routes).isEmpty() and unallocated(flows, routes).count() == flows.count()


def test_every_lot_closes_after_the_split(spark):
    legs = split_to_target(component_masses(read_lots(spark, TINY)), "cream_fat_pct")
    assert closure_check(legs).where("NOT closed").isEmpty()
