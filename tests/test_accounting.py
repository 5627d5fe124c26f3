from __future__ import annotations

import math

import pytest
from conftest import TINY, by
from pyspark.sql import functions as F

from flowbalance.functions.exact import exact_sum
from flowbalance.operators.accounting import (
    PLANT_INPUTS,
    closure_check,
    closure_summary,
    component_masses,
    composition_pct,
    densify,
    domain_check,
    domain_summary,
    pool,
    producing,
    rejected,
    to_long,
    to_wide,
    union_flows,
    unknown_product,
    usable,
)
from flowbalance.sources import defaults, read_lots, spread

LOT = "id int, volume double, fat_pct double, snf_pct double"
FLOW = "site int, volume double, fat double, snf double, water double"


def test_masses_of_reference_milks(spark):
    lots = spark.createDataFrame([(1, 1000.0, 4.0, 9.0), (2, 500.0, 5.0, 9.5)], LOT)
    rows = by(closure_check(component_masses(lots)), "id")
    assert (rows[1].fat, rows[1].snf, rows[1].water) == pytest.approx((40, 90, 870))
    assert (rows[2].fat, rows[2].snf, rows[2].water) == pytest.approx((25, 47.5, 427.5))
    assert rows[1].closed and rows[2].closed


def test_closure_detects_a_broken_flow_and_is_strict(spark):
    flows = spark.createDataFrame(
        [(1, 100.0, 4.0, 9.0, 87.0), (1, 100.0, 50.0, 50.0, 50.0), (2, 0.0, 0.0, 0.0, 0.001)], FLOW)
    assert sorted(r.closed for r in closure_check(flows).collect()) == [False, False, True]
    summary = by(closure_summary(flows, ["site"]), "site")
    assert (summary[1].n_flows, summary[1].n_open, summary[1].max_gap) == (2, 1, 50.0)
    assert summary[2].n_open == 1


def test_composition_guards_an_empty_flow(spark):
    flows = spark.createDataFrame([(1, 200.0, 8.0, 18.0, 174.0), (2, 0.0, 0.0, 0.0, 0.0)], FLOW)
    rows = by(composition_pct(flows), "site")
    assert (rows[1].fat_pct, rows[1].snf_pct, rows[1].water_pct) == pytest.approx((4, 9, 87))
    assert (rows[2].fat_pct, rows[2].snf_pct, rows[2].water_pct) == (0, 0, 0)


def test_domain_check_lists_each_violation_once(spark):
    schema = "id int, fat_pct double, powder_a string"
    rows = spark.createDataFrame([
        (1, 4.0, "nfdm"), (2, 3.0, "wmp"), (3, 5.1, "bmp"), (4, math.nan, "whey"),
        (5, None, None)], schema)
    found = domain_check(rows, {"fat_pct": (3.0, 5.0)}, {"powder_a": ("nfdm", "bmp", "wmp")})
    assert {(r.id, r.parameter, r.rule) for r in found.collect()} == {
        (3, "fat_pct", "range"), (4, "fat_pct", "range"), (4, "powder_a", "member"),
        (5, "fat_pct", "missing"), (5, "powder_a", "missing")}
    counts = by(domain_summary(found, []), "parameter", "rule")
    assert counts["fat_pct", "range"].n_violations == 2


def test_mapped_lots_never_leave_the_full_domain(spark):
    assert domain_check(read_lots(spark, TINY)).isEmpty()


def test_usable_and_rejected_are_complementary(spark):
    lots = spark.createDataFrame([
        (1, 100.0, 4.0, 9.0), (2, math.nan, 4.0, 9.0), (3, 100.0, None, 9.0),
        (4, math.inf, 4.0, 9.0), (5, -1.0, 4.0, 9.0), (6, 0.0, 4.0, 9.0),
        (7, math.inf, -math.inf, 9.0), (8, 1.7e308, 1.7e308, 9.0)], LOT)
    assert {r.id for r in usable(lots).collect()} == {1, 6}
    reasons = {r.id: r.reject_reason for r in rejected(lots).collect()}
    assert reasons == {2: "volume is not a number", 3: "fat_pct is not a number",
                       4: "volume is not a number", 5: "negative volume",
                       7: "volume is not a number", 8: "beyond the range of DOUBLE"}


def test_the_plant_rejects_on_its_settings_too(spark):
    lots = defaults(spark)
    broken = lots.withColumn("cream_fat_pct", F.lit(None).cast("double"))
    assert usable(lots, PLANT_INPUTS).count() == 1 and usable(broken, PLANT_INPUTS).isEmpty()
    assert rejected(broken, PLANT_INPUTS).first().reject_reason == "cream_fat_pct is not a number"


def test_producing_excludes_zero_and_nan(spark):
    supply = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, math.nan), (4, -1.0)],
                                   "id int, volume double")
    assert [r.id for r in producing(supply).collect()] == [1]


def test_pool_adds_components_and_fills_the_spine(spark):
    flows = spark.createDataFrame(
        [(1, 100.0, 4.0, 9.0, 87.0), (1, 50.0, 20.0, 3.0, 27.0)], FLOW)
    spine = spark.createDataFrame([(1,), (2,)], "site int")
    rows = by(pool(union_flows(flows, flows), ["site"], spine), "site")
    assert tuple(rows[1])[1:] == (300.0, 48.0, 24.0, 228.0)
    assert tuple(rows[2])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_densify_fills_products_and_round_trips(spark):
    supply = spark.createDataFrame(
        [(1, "butter", 2.0), (1, "butter", 3.0), (1, "whey", 7.0), (2, "nfdm", 1.0)],
        "site int, product string, volume double")
    wide = to_wide(supply, ["site"])
    dense = by(densify(supply, ["site"]), "site", "product")
    assert len(dense) == 18
    assert dense[1, "butter"].volume == 5.0 and dense[1, "nfdm"].volume == 0.0
    assert dense[2, "whey"].product_ord == 8
    again = to_wide(to_long(wide, ["site"]), ["site"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def test_exact_sum_does_not_depend_on_order_or_partitioning(spark):
    values = spark.range(20_000).selectExpr("id", "(id * 7919 % 10007) / 3D - 1000D AS x")
    results = {
        values.repartition(n, "id").orderBy(F.desc("id") if n % 2 else "x")
        .agg(exact_sum("x").alias("s")).first().s for n in (1, 3, 8)}
    want = sum(round(((i * 7919 % 10007) / 3.0 - 1000.0) * 1e6) for i in range(20_000)) / 1e6
    assert results == {want}


def test_exact_sum_handles_negatives_nothing_and_large_totals(spark):
    df = spark.createDataFrame([(-1.5,), (-2.25,), (None,)], "x double")
    assert df.agg(exact_sum("x").alias("s")).first().s == -3.75
    assert df.where("x > 0").agg(exact_sum("x").alias("s")).first().s == 0.0
    big = spark.range(4000).selectExpr("4.0e12D AS x")
    assert big.agg(exact_sum("x").alias("s")).first().s == pytest.approx(1.6e16, rel=1e-15)


def test_exact_sum_refuses_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "x double")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        df.agg(exact_sum("x").alias("s")).collect()


def test_unused_columns_never_reach_the_scan(spark):
    plan = pool(component_masses(usable(read_lots(spark, TINY))), ["site"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "l_orderkey" not in schema and "l_extendedprice" not in schema
    assert "l_quantity" in schema


def test_time_filters_reach_the_scan(spark):
    lots = read_lots(spark, TINY).where("ts >= TIMESTAMP_NTZ'2000-01-01'")
    text = lots._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in text


def test_spread_deals_lots_to_the_tasks_asked_for(spark):
    assert spread(read_lots(spark, TINY), 7).rdd.getNumPartitions() == 7


@pytest.mark.parametrize("column, value, reason", [
    ("fat_pct", -4.0, "fat_pct is too low"), ("skim_split_pct", 150.0, "skim_split_pct is too high"),
    ("butter_a_fat_pct", 0.0, "butter_a_fat_pct is too low"), ("snf_pct", 97.0, "more solids than milk"),
    ("volume", 1e13, "volume is too high"), ("cream_split_pct", None, "cream_split_pct is not a number")])
def test_impossible_lots_are_rejected(spark, column, value, reason):
    lots = defaults(spark).withColumn(column, F.lit(value).cast("double"))
    assert usable(lots, PLANT_INPUTS).isEmpty()
    assert rejected(lots, PLANT_INPUTS).first().reject_reason == reason


def test_names_of_any_characters(spark):
    names = ["skim-milk", "chef's", "a`b"]
    supply = spark.createDataFrame([(1, n, 2.0) for n in names] + [(1, "kefir", 7.0), (1, None, 1.0)],
                                   "site int, product string, volume double")
    assert to_wide(supply, ["site"], names).first().asDict() == {"site": 1, **dict.fromkeys(names, 2.0)}
    assert {r["product"]: r.volume for r in densify(supply, ["site"], names).collect()} == dict.fromkeys(names, 2.0)
    assert {r["product"] for r in unknown_product(supply, names).collect()} == {"kefir", None}


def test_units_of_a_sum(spark):
    rows = spark.range(1_000_000).selectExpr("4e-7 AS x")
    assert rows.agg(exact_sum("x", digits=12).alias("x")).first().x == pytest.approx(0.4)
