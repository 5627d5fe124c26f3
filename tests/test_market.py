from __future__ import annotations

import random

import pytest
from conftest import TINY, by
from pyspark.sql import functions as F

from flowbalance.constants import PRODUCTS
from flowbalance.operators.market import (
    bar_ratio,
    elastic_price,
    market_supply,
    price_direction,
    price_sensitivity,
    price_trend,
    quotes,
    rank_revenue,
    revenue,
    revenue_breakdown,
    sort_revenue,
    with_market,
)
from flowbalance.operators.pairing import shares_of
from flowbalance.operators.params import override_market
from flowbalance.sources import read_supply_events

SUPPLY = "site int, product string, volume double"


def supply_of(spark, **volumes):
    return spark.createDataFrame([(1, p, float(v)) for p, v in volumes.items()], SUPPLY)


def prices(spark, market, **volumes):
    return {r["product"]: r.price
            for r in quotes(supply_of(spark, **volumes), market, ["site"]).collect()}


def test_price_against_demand(spark, market):
    assert prices(spark, market, butter=50)["butter"] > 2.5
    assert prices(spark, market, butter=10000)["butter"] < 2.5
    assert prices(spark, market, butter=100)["butter"] == 2.5


def test_nothing_supplied_quotes_the_base_price(spark, market):
    got = prices(spark, market, butter=0)
    assert len(got) == 9
    assert got == {"butter": 2.5, "nfdm": 1.2, "bmp": 1.4, "wmp": 1.8, "cheddar": 1.8,
                   "mozzarella": 1.9, "swiss": 2.2, "parmesan": 3.5, "whey": 0.4}


def test_override_of_demand_gives_base_prices(spark, market):
    supply = supply_of(spark, butter=100, nfdm=50, cheddar=80, whey=200)
    overrides = supply.withColumnRenamed("volume", "demand")
    rows = override_market(with_market(supply, market), overrides, ["site", "product"])
    got = {r["product"]: (r.demand, r.base_price, r.elasticity) for r in rows.collect()}
    assert got["cheddar"] == (80.0, 1.8, 0.3) and got["whey"] == (200.0, 0.4, 0.2)


def test_revenue(spark):
    rows = spark.createDataFrame([(1, "butter", 100.0, 2.5), (1, "whey", 0.0, 0.4)],
                                 "site int, product string, volume double, price double")
    assert revenue(rows, ["site"]).first().revenue == 250.0


def test_breakdown_has_details_subtotals_and_total(spark):
    rows = spark.createDataFrame(
        [(1, "butter", 10.0, 2.0), (1, "whey", 5.0, 1.0), (2, "butter", 1.0, 2.0),
         (2, "whey", 0.0, 1.0)], "site int, product string, volume double, price double")
    got = {(r.level, r.site, r["product"]): r.revenue for r in revenue_breakdown(rows).collect()}
    assert got == {(0, 1, "butter"): 20.0, (0, 1, "whey"): 5.0, (0, 2, "butter"): 2.0,
                   (1, 1, None): 25.0, (1, 2, None): 2.0, (3, None, None): 27.0}


def test_sensitivity_moves_price_away_from_base(spark, market):
    rows = by(price_sensitivity(supply_of(spark, butter=50), market, [0.0, 0.3, 1.0]), "elasticity")
    assert rows[0.0].price == 2.5 and rows[1.0].price == 5.0
    assert rows[0.0].price < rows[0.3].price < rows[1.0].price


def test_rank_breaks_ties_by_product_order(spark):
    rows = spark.createDataFrame(
        [(1, 8, "whey", 5.0, 9.0), (1, 2, "bmp", 5.0, 9.0), (1, 0, "butter", 1.0, 3.0),
         (1, 4, "cheddar", 0.0, 99.0)],
        "site int, product_ord int, product string, volume double, revenue double")
    got = {r["product"]: r["rank"] for r in rank_revenue(rows, ["site"]).collect()}
    assert got == {"bmp": 1, "whey": 2, "butter": 3}
    assert [r["product"] for r in rank_revenue(rows, ["site"], k=1).collect()] == ["bmp"]
    assert [r["product"] for r in sort_revenue(rows, 2).collect()] == ["bmp", "whey"]
    twins = rows.unionByName(rows.withColumn("site", F.lit(0)))
    assert [(r["product"], r.site) for r in sort_revenue(twins, 3, ["site"]).collect()] == [("bmp", 0), ("bmp", 1), ("whey", 0)]


def test_bar_ratio_uses_one_as_the_least_maximum(spark):
    rows = spark.createDataFrame([(1, 4.0), (1, 2.0), (1, 0.0), (2, 0.5)], "site int, volume double")
    got = sorted((r.site, r.bar_pct) for r in bar_ratio(rows, ["site"]).collect())
    assert got == [(1, 50.0), (1, 100.0), (2, 50.0)]


def test_direction_dead_band_and_first_quote(spark):
    rows = spark.createDataFrame(
        [(1, 1, 2.0), (1, 2, 2.0005), (1, 3, 2.1), (1, 7, 2.0), (2, 1, 1.0)],
        "site int, tick int, price double")
    got = by(price_direction(rows, ["site"]), "site", "tick")
    assert [got[1, t].direction for t in (1, 2, 3, 7)] == ["flat", "flat", "up", "down"]
    assert got[2, 1].delta == 0.0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_segments_do_not_change_the_windows(spark, n):
    """Gaps longer than several segments, segments shorter than the look-back, against plain Python."""
    rng = random.Random(n)
    data = []
    for site in range(3):
        tick = 0
        for _ in range(60):
            tick += rng.choice([1, 1, 1, 2, 9, 40])
            data.append((site, tick, round(rng.uniform(1, 5), 4)))
    rows = spark.createDataFrame(data, "site int, tick int, price double")
    cut = F.expr("tick DIV 4")
    trend = by(price_trend(rows, ["site"], n, segment=cut), "site", "tick")
    moves = by(price_direction(rows, ["site"], segment=cut), "site", "tick")
    assert len(trend) == len(data)
    for site in range(3):
        own = [d for d in data if d[0] == site]
        for i, (_, tick, price) in enumerate(own):
            last = [p for _, _, p in own[max(0, i - n + 1):i + 1]]
            got = trend[site, tick]
            assert (got.min_price, got.max_price) == (min(last), max(last))
            assert got.mean_price == pytest.approx(sum(last) / len(last), abs=1e-9)
            assert moves[site, tick].prev_price == (own[i - 1][2] if i else price)


def test_rollup_and_rank_share_one_shuffle(spark, market):
    daily = quotes(read_supply_events(spark, TINY).withColumnRenamed("day", "tick"), market,
                   ["site", "tick"])
    plan = rank_revenue(daily, ["site", "tick"], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text and "SortMergeJoin" not in text


def test_dense_supply_has_all_products_everywhere(spark, market):
    rows = elastic_price(
        quotes(read_supply_events(spark, TINY), market, ["site", "day"]).drop("price", "revenue"),
        market)
    assert rows.groupBy("site", "day").count().where(f"count <> {len(PRODUCTS)}").isEmpty()
    assert rows.where("price IS NULL OR isnan(price) OR price <= 0").isEmpty()


def tenth_product(market):
    return market.unionByName(market.where("product = 'whey'").selectExpr(
        "9 AS product_ord", "'kefir' AS product", "0.9D AS base_price", "demand", "elasticity"))


@pytest.mark.parametrize("most", [64, 3])
def test_the_market_drives(spark, market, most):
    """A product of the market that nobody supplies has its base price, one it does not know has none."""
    supply = supply_of(spark, butter=50, whey=10, tofu=5).unionByName(
        spark.createDataFrame([(None, "butter", 7.0)], SUPPLY))
    dense = market_supply(supply, tenth_product(market), ["site"], most=most)
    got = by(elastic_price(dense, tenth_product(market)), "site", "product")
    assert len(got) == 20 and not any(p == "tofu" for _, p in got)
    assert (got[1, "kefir"].price, got[1, "kefir"].volume, got[1, "kefir"].product_ord) == (0.9, 0.0, 9)
    assert got[1, "butter"].price > 2.5 and got[None, "butter"].volume == 7.0
    assert got[None, "whey"].price == 0.4
    assert [r.product_ord for r in quotes(supply, tenth_product(market), ["site"]).where(
        "site = 1").orderBy("product_ord").collect()] == list(range(10))


def test_shares_grow_with_the_pairs():
    assert shares_of(10, 25) == 1 and shares_of(4_000_000, 10) == 20
    assert shares_of(3, 10**9) == 3 and shares_of(0, 5) == 1
