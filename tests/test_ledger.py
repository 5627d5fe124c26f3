from __future__ import annotations

import re

import pytest
from conftest import TINY, by
from pyspark.sql import functions as F

from flowbalance.constants import PRODUCTS
from flowbalance.operators.accounting import PLANT_INPUTS, pool, rejected
from flowbalance.operators.market import quotes, revenue
from flowbalance.operators.reconcile import OUTFLOW_KINDS, mass_balance, node_balance, reconcile
from flowbalance.plans.ledger import (
    lot_ledger,
    plant,
    plant_balance,
    plant_totals,
    production_by_product,
    unknown_lots,
)
from flowbalance.sources import defaults, read_lots

# volume, fat, snf, water of the default configuration
GOLDEN = {
    ("producer", "separator", "milk"): (1000, 40, 90, 870),
    ("separator", "pool", "cream"): (97.744361, 39.097744, 8.796992, 49.849624),
    ("cheese_a", "market", "cheese"): (14.951665, 0.406015, 9.013534, 5.532116),
    ("cheese_a", "market", "whey"): (436.176155, 0.045113, 31.587970, 404.543072),
    ("cheese_b", "market", "cheese"): (17.730174, 0.383459, 9.013534, 8.333182),
    ("cheese_b", "market", "whey"): (433.397645, 0.067669, 31.587970, 401.742006),
    ("butter_a", "market", "butter"): (23.601687, 19.353383, 0.354025, 3.894278),
    ("butter_a", "market", "powder"): (25.270493, 0.195489, 4.044471, 21.030534),
    ("butter_b", "market", "butter"): (24.191729, 19.353383, 0.362876, 4.475470),
    ("butter_b", "market", "powder"): (24.680451, 0.195489, 4.035620, 20.449342),
}


@pytest.fixture
def default_row(spark):
    return defaults(spark).selectExpr("1 AS site", "*")


def test_golden_vector(default_row, recipes):
    rows = by(lot_ledger(default_row, recipes, ["site"]), "from_node", "to_node", "kind")
    assert len(rows) == 16
    for edge, want in GOLDEN.items():
        got = [rows[edge][m] for m in ("volume", "fat", "snf", "water")]
        assert got == pytest.approx(want, abs=1e-6), edge


def test_default_prices_and_revenue(default_row, recipes, market):
    sold = production_by_product(lot_ledger(default_row, recipes, ["site"]), ["site"])
    rows = quotes(sold, market, ["site"])
    prices = {r["product"]: r.price for r in rows.collect()}
    want = {"butter": 3.119820, "nfdm": 1.695603, "bmp": 1.484426, "wmp": 1.8,
            "cheddar": 3.362173, "mozzarella": 3.192565, "swiss": 2.2, "parmesan": 3.5,
            "whey": 0.298129}
    assert prices == pytest.approx(want, abs=1e-6)
    assert revenue(rows, ["site"]).first().revenue == pytest.approx(594.712149, abs=1e-5)


def test_residuals_of_the_default_are_near_zero(default_row, recipes):
    for r in plant_balance(plant(default_row, recipes), ["site"]).collect():
        assert abs(r.residual) < 0.01 and r.ok


def test_skim_and_pool_identities(spark, recipes):
    keys = ["order_key", "line_number", "part_key", "site"]
    wide = plant(read_lots(spark, TINY), recipes).select(
        *keys,
        (F.abs(F.expr("skim_volume - skim_a_volume - skim_b_volume")) < 1e-6).alias("skim"),
        (F.abs(F.expr("pool_fat - cream_fat - excess_a_fat - excess_b_fat")) < 1e-9).alias("pool"),
        (F.abs(F.expr("skim_a_volume - curd_a_volume - whey_a_volume - excess_a_volume")) < 0.01)
        .alias("plant"))
    assert wide.where("NOT (skim AND pool AND plant)").isEmpty()


def test_wide_and_long_forms_agree(spark, recipes):
    lots = read_lots(spark, TINY)
    moves = lot_ledger(lots, recipes, ["site"])
    wide = plant(lots, recipes)
    long_balance = sorted(map(tuple, mass_balance(moves, ["site"]).collect()))
    assert sorted(map(tuple, plant_balance(wide, ["site"]).collect())) == long_balance
    totals = {(r.site, p): r[p] for r in plant_totals(wide, ["site"]).collect() for p in PRODUCTS}
    sold = lot_ledger(lots, recipes, ["site"], OUTFLOW_KINDS)
    for r in production_by_product(sold, ["site"]).collect():
        assert totals[r.site, r["product"]] == r.volume
    assert (production_by_product(moves, ["site"]).exceptAll(
        production_by_product(sold, ["site"]))).isEmpty()


def test_nodes_balance_on_all_lots(spark, recipes):
    moves = lot_ledger(read_lots(spark, TINY), recipes, ["site"])
    assert node_balance(moves, ["site"]).where("NOT ok").isEmpty()


def test_the_ledger_is_narrow(spark, recipes):
    plan = lot_ledger(read_lots(spark, TINY), recipes, ["site"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert "SortMergeJoin" not in text and "PythonUDF" not in text


def test_unknown_types_go_to_the_rejects(spark, default_row, recipes):
    rows = default_row.withColumn("id", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumns({
        "cheese_a": F.when(F.col("id") == 1, "brie").otherwise(F.col("cheese_a")),
        "cheese_b": F.when(F.col("id").isin(2, 3), "feta").otherwise(F.col("cheese_b"))})
    assert {r.id for r in plant(rows, recipes).collect()} == {0}
    assert sorted(r.id for r in unknown_lots(rows, recipes).collect()) == [1, 2, 3]


@pytest.mark.parametrize("powder", ["casein", None])
def test_unknown_powders_go_to_the_rejects(spark, default_row, recipes, powder):
    """No volume is lost: a lot is in the plant's wide and long form, or in the rejects."""
    rows = default_row.unionByName(default_row.withColumns({"site": F.lit(2), "powder_a": F.lit(powder)}))
    assert [r.site for r in plant(rows, recipes).collect()] == [1]
    assert [r.site for r in unknown_lots(rows, recipes).collect()] == [2]
    sold = lot_ledger(rows, recipes, ["site"], OUTFLOW_KINDS)
    long = {r["product"]: r.volume for r in production_by_product(sold, ["site"]).collect()}
    wide = plant_totals(plant(rows, recipes), ["site"]).first()
    assert {p: wide[p] for p in long} == long and sum(long.values()) == pytest.approx(1000, abs=0.1)


def test_unusable_settings_go_to_the_rejects(spark, default_row, recipes):
    rows = default_row.withColumn("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns({
        "skim_split_pct": F.when(F.col("id") != 1, F.col("skim_split_pct")),
        "fat_pct": F.when(F.col("id") == 2, float("nan")).otherwise(F.col("fat_pct"))})
    assert [r.id for r in plant(rows, recipes).collect()] == [0]
    assert sorted(r.id for r in rejected(rows, PLANT_INPUTS).collect()) == [1, 2]


def test_reconcile_keeps_keys_of_one_side(spark):
    inflow = spark.createDataFrame([(1, 100.0), (1, 50.0), (2, 10.0)], "k int, mass double")
    outflow = spark.createDataFrame([(1, 149.9), (3, 5.0)], "k int, mass double")
    rows = by(reconcile(inflow, outflow, ["k"], ["mass"]), "k")
    assert rows[1].residual == pytest.approx(0.1) and rows[1].ok
    assert rows[1].err_pct == pytest.approx(0.1 / 150 * 100)
    assert (rows[2].total_out, rows[2].err_pct, rows[2].ok) == (0.0, 100.0, False)
    assert (rows[3].total_in, rows[3].residual, rows[3].err_pct, rows[3].ok) == (0.0, -5.0, 0.0, True)


def test_audit_flag_is_strict(spark):
    inflow = spark.createDataFrame([(1, 1000.0)], "k int, mass double")
    outflow = spark.createDataFrame([(1, 999.0)], "k int, mass double")
    assert not reconcile(inflow, outflow, ["k"], ["mass"]).first().ok


def test_compiled_methods_stay_small_enough_for_the_jvm(spark, recipes):
    """The JVM interprets methods above 8,000 bytecodes, which made the ledger four times slower."""
    lots = read_lots(spark, TINY)
    plans = [plant_totals(plant(lots, recipes), ["site"]),
             pool(lot_ledger(lots, recipes, ["site"]), ["from_node", "to_node", "kind"])]
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in plans:
            text = debug.__getattr__("MODULE$").codegenString(
                plan._jdf.queryExecution().executedPlan())
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
