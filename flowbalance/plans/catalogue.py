"""The query catalogue: every operator over whole tables, by name.

Each query takes ``(spark, path)``. Results that went through ``pow`` are rounded, prices to six
decimals and revenues to four, as the last bit of ``pow`` depends on the maths library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import DEFAULT_CONFIG, MASSES, PARAM_PATHS, STRESS_SCENARIOS
from ..functions.clock import hour_tick, minute_tick
from ..functions.exact import exact_sum, rounded
from ..operators.accounting import (
    BOUNDS,
    PLANT_INPUTS,
    closure_check,
    closure_summary,
    component_masses,
    composition_pct,
    densify,
    domain_check,
    domain_summary,
    pool,
    rejected,
    to_long,
    to_wide,
    union_flows,
    usable,
)
from ..operators.announce import announced_moves
from ..operators.fanout import (
    allocate,
    churn_split,
    split_to_target,
    unallocated,
    yield_split,
)
from ..operators.fitting import demand_moments, fit_demand, merge_moments
from ..operators.frontier import frontier
from ..operators.lookup import unknown_powder, unknown_recipe
from ..operators.maintain import apply_changes, read_sums, signed_changes, signed_sums
from ..operators.market import (
    bar_ratio,
    market_supply,
    priced,
    price_direction,
    price_sensitivity,
    price_trend,
    quotes,
    rank_revenue,
    revenue,
    revenue_breakdown,
    sort_revenue,
    unmarketed,
    with_market,
)
from ..operators.network import propagate
from ..operators.params import asof_params, override_market
from ..operators.ranges import range_trend
from ..operators.reconcile import OUTFLOW_KINDS, mass_balance, node_balance, reconcile
from ..operators.scenarios import (
    best_scenario,
    compare_scenarios,
    evaluate_scenarios,
    flow_invariants,
    invariants,
    price_totals,
    scenario_grid,
    with_scenario_table,
    with_scenarios,
    with_usable_scenarios,
)
from ..operators.watch import invariant_limits, watched
from ..sources.dims import allocations, market_params, recipes
from ..sources.sinks import shared_folder, with_checkpoints, write_quotes
from ..sources.tables import (
    LINEITEM_SCHEMA,
    late_slices,
    read_arrivals,
    read_fact_stream,
    read_facts,
    read_lots,
    read_orders,
    read_param_changes,
    read_supply_events,
    read_supply_stream,
    spread,
)
from ..streaming.amend import latest, write_amended
from ..streaming.feed import (
    DIRECTION_SCHEMA,
    ROCKSDB_PROVIDER,
    params_in_effect_stream,
    price_direction_stream,
    price_feed,
)
from ..streaming.keyed import params_in_effect_keyed
from .ledger import (
    cream_pool,
    lot_ledger,
    plant,
    plant_balance,
    plant_measures,
    production_by_product,
    sold_flows,
    unknown_lots,
)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({
        c: F.expr(rounded(c, 4 if c.endswith("revenue") else 6)) for c in columns})


def _milk(spark: SparkSession, path: str) -> DataFrame:
    return component_masses(usable(read_lots(spark, path)))


def _plant_lots(spark: SparkSession, path: str) -> DataFrame:
    """Lots for scenarios, where each is computed many times over: dealt over all cores."""
    return spread(read_lots(spark, path), spark.sparkContext.defaultParallelism)


# ---- accounting

def lot_masses_by_site(spark: SparkSession, path: str) -> DataFrame:
    return pool(_milk(spark, path), ["site"])


def closure_by_site(spark: SparkSession, path: str) -> DataFrame:
    """Lots whose water is metered at a flat share of the volume, so that some do not close."""
    metered = _milk(spark, path).withColumn("water", F.col("volume") * 0.87)
    return _rounded(closure_summary(metered, ["site"]), "max_gap")


def composition_by_site(spark: SparkSession, path: str) -> DataFrame:
    return composition_pct(lot_masses_by_site(spark, path)).select(
        "site", *[F.expr(rounded(f"{c}_pct")).alias(f"{c}_pct") for c in ("fat", "snf", "water")])


def domain_violations(spark: SparkSession, path: str) -> DataFrame:
    """Against domains tighter than the allowed ones, which no lot leaves."""
    ranges = {"fat_pct": (3.2, 4.8), "snf_pct": (7.8, 9.2), "volume": (200.0, 4500.0),
              "cream_fat_pct": (32.0, 43.0), "butter_a_fat_pct": (79.0, 83.0)}
    members = {"cheese_a": ("cheddar", "mozzarella", "swiss"), "powder_b": ("nfdm", "bmp")}
    return domain_summary(domain_check(read_lots(spark, path), ranges, members), ["site"])


def cream_and_skim_by_site(spark: SparkSession, path: str) -> DataFrame:
    """Flagship: split every lot to its cream target; totals and closure failures per site."""
    legs = closure_check(split_to_target(_milk(spark, path), "cream_fat_pct"))
    return legs.groupBy("site", "kind").agg(
        *[exact_sum(m).alias(m) for m in ("volume", "fat", "snf", "water")],
        F.count_if(~F.col("closed")).alias("n_open"))


def yield_split_by_recipe(spark: SparkSession, path: str) -> DataFrame:
    """Cheese from whole milk, where surplus cream does occur."""
    return pool(yield_split(_milk(spark, path), recipes(spark)), ["cheese_type", "kind"])


def churn_split_by_powder(spark: SparkSession, path: str) -> DataFrame:
    cream = split_to_target(_milk(spark, path), "cream_fat_pct").where("kind = 'cream'")
    return pool(churn_split(cream), ["powder_type", "product"])


def allocate_flows(spark: SparkSession, path: str) -> DataFrame:
    routes = allocations(spark, [
        ("skim", "cheese_a", 0, 0.5), ("skim", "cheese_b", 1, 0.3), ("skim", "cheese_c", 2, 0.2),
        ("cream", "butter_a", 0, 0.6), ("cream", "butter_b", 1, 0.4)])
    legs = split_to_target(_milk(spark, path), "cream_fat_pct")
    return pool(allocate(legs, routes, node="kind"), ["site", "to_node"])


def recipe_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lots of a type that a reduced recipe table does not know."""
    known = recipes(spark).where("cheese_type <> 'parmesan'")
    return unknown_recipe(read_lots(spark, path), known).groupBy("site", "cheese_type").agg(
        F.count(F.lit(1)).alias("n_lots"), exact_sum("volume").alias("volume"))


def pooled_cream(spark: SparkSession, path: str) -> DataFrame:
    """Separated cream and surplus cream of whole-milk cheese, pooled per site."""
    return cream_pool(_milk(spark, path), recipes(spark), ["site"])


def milk_union(spark: SparkSession, path: str) -> DataFrame:
    """Separated cream and the surplus cream of either cheese plant, each making its cheese of whole
    milk, and an empty flow of every supplier, so that idle sites show as zeros."""
    milk = _milk(spark, path)
    cream = split_to_target(milk, "cream_fat_pct").where("kind = 'cream'")
    surplus = [
        yield_split(milk.withColumn("cheese_type", F.col(plant)), recipes(spark)).where(
            "kind = 'excess_cream'") for plant in ("cheese_a", "cheese_b")]
    idle = spark.read.parquet(f"{path}/supplier.parquet").select(F.col("s_suppkey").alias("site"))
    flows = [f.select("site", *MASSES) for f in (cream, *surplus)]
    return pool(union_flows(*flows), ["site"], idle)


def lot_volume_decimal(spark: SparkSession, path: str) -> DataFrame:
    """Site totals summed in units of 1e-9, against a sum of decimals at full width."""
    return _milk(spark, path).groupBy("site").agg(*[
        exact_sum(c, digits=9).alias(c) for c in ("volume", "fat", "snf")]).select(
            "site", *[F.expr(rounded(c, 2)).alias(c) for c in ("volume", "fat", "snf")])


def lot_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lots outside bounds that are tight enough for some to leave them, by the first reason."""
    bounds = BOUNDS | {"fat_pct": (3.2, 4.8), "snf_pct": (7.8, 9.2), "volume": (200.0, 4500.0),
                       "skim_split_pct": (5.0, 95.0)}
    return rejected(read_lots(spark, path), PLANT_INPUTS, bounds).groupBy(
        "site", "reject_reason").agg(F.count(F.lit(1)).alias("n_lots"))


def powder_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lots of a powder that a plant without whole milk powder does not make."""
    return unknown_powder(read_lots(spark, path), "powder_type", ("nfdm", "bmp")).groupBy(
        "site", "powder_type").agg(
            F.count(F.lit(1)).alias("n_lots"), exact_sum("volume").alias("volume"))


def plant_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lots that a plant without parmesan and whole milk powder cannot process, each once."""
    known = recipes(spark).where("cheese_type <> 'parmesan'")
    return unknown_lots(read_lots(spark, path), known, ("nfdm", "bmp")).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_lots"), exact_sum("volume").alias("volume"))


def unallocated_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a node whose fractions do not add up."""
    routes = allocations(spark, [
        ("skim", "cheese_a", 0, 0.5), ("skim", "cheese_b", 1, 0.5),
        ("cream", "butter_a", 0, 0.6), ("cream", "butter_b", 1, 0.3)])
    legs = split_to_target(_milk(spark, path), "cream_fat_pct")
    return pool(unallocated(legs, routes, node="kind"), ["site", "kind"])


def masses_by_region(spark: SparkSession, path: str) -> DataFrame:
    """Pool per site first, so that the dimension joins see one row per site, then per region.

    Sites that no supplier stands for have no region and stay as one row without a name.
    """
    def dim(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    sites = (dim("supplier").select(F.col("s_suppkey").alias("site"), "s_nationkey")
             .join(dim("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
             .join(dim("region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("site", F.col("r_name").alias("region")))
    return pool(lot_masses_by_site(spark, path).join(sites, "site", "left"), ["region"])


# ---- ledger and reconciliation

def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return lot_ledger(read_lots(spark, path), recipes(spark), ["site"])


def lot_ledger_rollup(spark: SparkSession, path: str) -> DataFrame:
    sold = lot_ledger(read_lots(spark, path), recipes(spark), ["site"], OUTFLOW_KINDS)
    return production_by_product(sold, ["site"])


def ledger_edges(spark: SparkSession, path: str) -> DataFrame:
    return pool(_ledger(spark, path), ["from_node", "to_node", "kind"])


def plant_mass_balance(spark: SparkSession, path: str) -> DataFrame:
    wide = plant(read_lots(spark, path), recipes(spark))
    return _rounded(plant_balance(wide, ["site"]), "residual", "err_pct")


def movement_balance(spark: SparkSession, path: str) -> DataFrame:
    """The plant's balance from long movements."""
    return _rounded(mass_balance(_ledger(spark, path), ["site"]), "residual", "err_pct")


def node_reconciliation(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(node_balance(_ledger(spark, path), ["site"]), "residual", "err_pct")


def order_line_reconciliation(spark: SparkSession, path: str) -> DataFrame:
    orders, lines = read_orders(spark, path)
    return _rounded(reconcile(orders, lines, ["order_key"], ["amount"]), "residual", "err_pct")


# ---- market

def _daily(spark: SparkSession, path: str) -> DataFrame:
    return read_supply_events(spark, path).withColumnRenamed("day", "tick")


def _daily_quotes(spark: SparkSession, path: str) -> DataFrame:
    return quotes(_daily(spark, path), market_params(spark), ["site", "tick"])


def supply_wide(spark: SparkSession, path: str) -> DataFrame:
    return to_wide(_daily(spark, path), ["site", "tick"])


def supply_long(spark: SparkSession, path: str) -> DataFrame:
    return densify(_daily(spark, path), ["site", "tick"])


def elastic_prices(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(_daily_quotes(spark, path), "price", "revenue")


def price_sensitivity_by_site(spark: SparkSession, path: str) -> DataFrame:
    supply = market_supply(_daily(spark, path), market_params(spark), ["site"])
    rows = price_sensitivity(supply, market_params(spark), [0.1, 0.2, 0.3, 0.5, 1.0])
    return _rounded(rows, "price", "revenue")


def revenue_by_day(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(revenue(_daily_quotes(spark, path), ["site", "tick"]), "revenue")


def revenue_rollup(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(revenue_breakdown(_daily_quotes(spark, path)), "revenue")


def revenue_top3(spark: SparkSession, path: str) -> DataFrame:
    top = rank_revenue(_daily_quotes(spark, path), ["site", "tick"], k=3)
    return _rounded(top, "price", "revenue")


def revenue_sorted(spark: SparkSession, path: str) -> DataFrame:
    ordered = sort_revenue(_daily_quotes(spark, path), keys=["site", "tick"])
    return _rounded(ordered.select("site", "tick", "product", "revenue"), "revenue")


def revenue_top100(spark: SparkSession, path: str) -> DataFrame:
    best = sort_revenue(_daily_quotes(spark, path), 100, ["site", "tick"])
    return _rounded(best.select("site", "tick", "product", "revenue"), "revenue")


def product_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Supply of a product that a market without whey does not know."""
    known = market_params(spark).where("product <> 'whey'")
    return unmarketed(_daily(spark, path), known).groupBy("site", "product").agg(
        F.count(F.lit(1)).alias("n_events"), exact_sum("volume").alias("volume"))


def _moves(rows: DataFrame) -> DataFrame:
    return _rounded(rows, "price", "delta").select(
        "site", "product", "tick", "price", "delta", "direction")


def price_direction_by_day(spark: SparkSession, path: str) -> DataFrame:
    return _moves(price_direction(_daily_quotes(spark, path), ["site", "product"]))


def price_direction_segmented(spark: SparkSession, path: str) -> DataFrame:
    """The same with windows of a week each and the closing price carried over."""
    week = F.expr("tick DIV 7")
    return _moves(price_direction(_daily_quotes(spark, path), ["site", "product"], segment=week))


def price_trend_by_day(spark: SparkSession, path: str) -> DataFrame:
    rows = price_trend(_daily_quotes(spark, path), ["site", "product"], 5)
    return _rounded(rows, "mean_price", "min_price", "max_price").select(
        "site", "product", "tick", "mean_price", "min_price", "max_price")


def price_trend_segmented(spark: SparkSession, path: str) -> DataFrame:
    week = F.expr("tick DIV 7")
    rows = price_trend(_daily_quotes(spark, path), ["site", "product"], 5, segment=week)
    return _rounded(rows, "mean_price", "min_price", "max_price").select(
        "site", "product", "tick", "mean_price", "min_price", "max_price")


def bar_ratio_by_day(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(bar_ratio(supply_long(spark, path), ["site", "tick"]), "bar_pct")


def market_override(spark: SparkSession, path: str) -> DataFrame:
    """Demand of each site and product set to its mean daily supply over its days."""
    supply = market_supply(_daily(spark, path), market_params(spark), ["site", "tick"])
    overrides = supply.groupBy("site", "product").agg(
        (exact_sum("volume") / F.count(F.lit(1))).alias("demand"))
    rows = override_market(with_market(supply, market_params(spark)), overrides,
                           ["site", "product"])
    return _rounded(priced(rows), "price", "revenue", "demand").select(
        "site", "tick", "product", "volume", "demand", "price", "revenue")


# ---- parameters

_LOG_PATHS = ("separator.targetCreamFatPercent", "skimSplitPercent")


def _asof(facts: DataFrame, changes: DataFrame, **options: object) -> DataFrame:
    return asof_params(facts, changes, ["site"], {p: PARAM_PATHS[p] for p in _LOG_PATHS},
                       DEFAULT_CONFIG, **options)


def asof_params_by_fact(spark: SparkSession, path: str) -> DataFrame:
    return _asof(read_facts(spark, path), read_param_changes(spark, path))


def asof_params_small_log(spark: SparkSession, path: str) -> DataFrame:
    """The same by hours, for a log with few changes: fewer buckets have to be opened."""
    return _asof(read_facts(spark, path), read_param_changes(spark, path), bucket=hour_tick,
                 era=24, salts=2)


# ---- scenarios

def _scenario_lots(spark: SparkSession, path: str) -> DataFrame:
    """Lots are checked once, before every scenario multiplies them."""
    return with_scenarios(usable(_plant_lots(spark, path), PLANT_INPUTS), STRESS_SCENARIOS)


def _sweep(spark: SparkSession, path: str) -> DataFrame:
    return evaluate_scenarios(_scenario_lots(spark, path), recipes(spark), market_params(spark),
                              ["site", "scenario_id"], check=False)


def scenario_override(spark: SparkSession, path: str) -> DataFrame:
    """The configurations in effect, summed per scenario, cheese and powder."""
    groups = ["scenario_id", "scenario", "cheese_a", "powder_a"]
    return _scenario_lots(spark, path).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_lots"),
        *[exact_sum(c).alias(c) for c in (
            "volume", "fat_pct", "snf_pct", "cream_fat_pct", "skim_split_pct", "cream_split_pct",
            "butter_a_fat_pct")])


def scenario_sweep(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(_sweep(spark, path), "price", "revenue", "residual_fat", "residual_snf",
                    "residual_water")


def scenario_delta(spark: SparkSession, path: str) -> DataFrame:
    deltas = compare_scenarios(_sweep(spark, path), 0, ["site", "product"])
    names = ["delta_volume", "delta_price", "delta_revenue"]
    return _rounded(deltas, *names).select("site", "scenario_id", "product", *names)


def best_scenario_by_site(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(best_scenario(_sweep(spark, path), ["site"]), "revenue")


def scenario_invariants(spark: SparkSession, path: str) -> DataFrame:
    """Every sold flow of every lot under each scenario, checked before anything is summed."""
    wide = plant(_scenario_lots(spark, path), recipes(spark), check=False)
    return _rounded(flow_invariants(wide, ["scenario_id"], sold_flows()), "min_value", "max_value")


def result_invariants(spark: SparkSession, path: str) -> DataFrame:
    """Volumes of the scenarios' results, checked for NaN and negative values."""
    return invariants(_sweep(spark, path), ["scenario_id"])


GRID = {
    "cream_fat_pct": [30.0, 35.0, 40.0, 45.0],
    "skim_split_pct": [0.0, 30.0, 60.0, 100.0],
    "cheese_a": ["cheddar", "mozzarella", "swiss", "parmesan"],
    "cheese_b": ["mozzarella", "swiss"],
}


def _pooled_configs(spark: SparkSession, path: str) -> DataFrame:
    """The pooled milk of each site with the default settings."""
    return composition_pct(lot_masses_by_site(spark, path)).select(
        "site", *[F.expr(rounded(c)).alias(c) for c in ("volume", "fat_pct", "snf_pct")],
        *[F.lit(v).alias(k) for k, v in DEFAULT_CONFIG.items()
          if k not in ("volume", "fat_pct", "snf_pct")])


def scenario_table(spark: SparkSession, path: str) -> DataFrame:
    """The pooled milk of each site with the cream target and the split of every nation."""
    rules = spark.read.parquet(f"{path}/nation.parquet").selectExpr(
        "n_nationkey AS scenario_id", "STRUCT(30D + n_nationkey % 16 AS cream_fat_pct) AS separator",
        "IF(n_nationkey % 2 = 0, STRUCT(n_nationkey * 4D AS skim_split_pct), NULL) AS skim_split")
    tried = with_scenario_table(_pooled_configs(spark, path), rules, ["site"])
    keys = ["site", "scenario_id"]
    rows = evaluate_scenarios(tried, recipes(spark), market_params(spark), keys)
    return _rounded(revenue(rows, keys), "revenue")


def grid_sweep(spark: SparkSession, path: str) -> DataFrame:
    """The pooled milk of each site under all combinations of a parameter grid."""
    tasks = spark.sparkContext.defaultParallelism
    grid = scenario_grid(_pooled_configs(spark, path), GRID, ["site"], tasks)
    rows = evaluate_scenarios(grid, recipes(spark), market_params(spark), ["site", "grid_id"])
    return _rounded(revenue(rows, ["site", "grid_id"]), "revenue")


# ---- maintained results, networks, announcements

def _changed_lots(spark: SparkSession, path: str) -> list[DataFrame]:
    """All lots but the new ones as a first delta; then new, lost and halved lots as signed rows."""
    lots = read_lots(spark, path)
    def part(digit: int) -> DataFrame:
        return lots.where(f"order_key % 10 = {digit}")

    halved = part(2).withColumn("volume", F.col("volume") * 0.5)
    return [signed_changes(lots.where("order_key % 10 <> 0")), signed_changes(part(0), part(1)),
            signed_changes(changed=(part(2), halved))]


def _maintained(
    spark: SparkSession, deltas: list[DataFrame], keys: list[str], check: bool = True
) -> DataFrame:
    """The plant's totals after all deltas, each merged into the version before it."""
    path = shared_folder(spark, "maintained")
    for number, delta in enumerate(deltas):
        wide = plant(delta, recipes(spark), check)
        sums = apply_changes(spark, path, number, signed_sums(wide, keys, plant_measures()), keys)
    return read_sums(sums, keys, list(plant_measures()))


def maintained_production(spark: SparkSession, path: str) -> DataFrame:
    """Production by site and product, kept up to date with inserted, deleted and changed lots."""
    return to_long(_maintained(spark, _changed_lots(spark, path), ["site"]), ["site"])


def maintained_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenario sweep, kept up to date with inserted, deleted and changed lots."""
    keys = ["site", "scenario_id"]
    tasks = spark.sparkContext.defaultParallelism
    deltas = [with_usable_scenarios(spread(d, tasks), STRESS_SCENARIOS) for d in _changed_lots(spark, path)]
    rows = price_totals(_maintained(spark, deltas, keys, check=False), market_params(spark), keys)
    return _rounded(rows, "price", "revenue", "residual_fat", "residual_snf", "residual_water")


def _trade_routes(spark: SparkSession, path: str) -> DataFrame:
    """Sites deliver to their nation and region, nations also to a later nation, regions to the market."""
    def dim(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    nations = dim("nation").select("n_nationkey", "n_regionkey")
    later = dim("nation").select(F.col("n_nationkey").alias("later"))
    sites = dim("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    onward = nations.join(later, F.col("n_nationkey") + 9 == F.col("later"), "left")
    return (
        sites.selectExpr("INLINE(ARRAY("
                         "STRUCT('site-' || s_suppkey AS from_node, 'nation-' || n_nationkey AS to_node, 0 AS ord, 0.7D AS fraction),"
                         "STRUCT('site-' || s_suppkey AS from_node, 'region-' || n_regionkey AS to_node, 1 AS ord, 0.3D AS fraction)))")
        .unionByName(onward.where("later IS NOT NULL").selectExpr(
            "'nation-' || n_nationkey AS from_node", "'nation-' || later AS to_node", "0 AS ord", "0.25D AS fraction"))
        .unionByName(onward.selectExpr(
            "'nation-' || n_nationkey AS from_node", "'region-' || n_regionkey AS to_node", "1 AS ord",
            "IF(later IS NULL, 1D, 0.75D) AS fraction"))
        .unionByName(dim("region").selectExpr("INLINE(ARRAY("
                     "STRUCT('region-' || r_regionkey AS from_node, 'market' AS to_node, 0 AS ord, 0.9D AS fraction),"
                     "STRUCT('region-' || r_regionkey AS from_node, 'reserve' AS to_node, 1 AS ord, 0.1D AS fraction)))")))


def network_throughput(spark: SparkSession, path: str) -> DataFrame:
    """Each site's milk, by cheese type, through a network of nations and regions."""
    with_checkpoints(spark)
    milk = pool(_milk(spark, path), ["cheese_type", "site"])
    sources = milk.selectExpr("cheese_type", "'site-' || site AS node", *MASSES)
    return propagate(sources, _trade_routes(spark, path), ["cheese_type"])


def price_announced(spark: SparkSession, path: str) -> DataFrame:
    """Hourly prices, announced when they leave a band of 5 cents around the last announced one."""
    with_checkpoints(spark)
    hourly = read_supply_events(spark, path).withColumnRenamed("hour", "tick")
    rows = _rounded(quotes(hourly, market_params(spark), ["site", "tick"]), "price")
    moves = announced_moves(rows.select("site", "product", "tick", "price"), ["site", "product"], 0.05, F.expr("tick DIV 168"), fan=2)
    return _rounded(moves, "delta")


# ---- streaming

#: Files that a micro-batch takes, so that a backlog is worked off in steps.
FILES_PER_BATCH = 1000


def _fitted(moments: DataFrame) -> DataFrame:
    return _rounded(fit_demand(moments), "elasticity", "demand", "r2")


def fitted_market(spark: SparkSession, path: str) -> DataFrame:
    """The market's parameters of each site and product, read back from its daily quotes."""
    market = market_params(spark)
    supply = market_supply(_daily(spark, path), market, ["site", "tick"])
    return _fitted(demand_moments(priced(with_market(supply, market)), ["site", "product"]))


def fitted_order_prices(spark: SparkSession, path: str) -> DataFrame:
    """How the unit prices of a supplier's order lines react to quantity, merged from the moments of line numbers."""
    lines = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{path}/lineitem.parquet").selectExpr(
        "l_suppkey AS site", "l_linenumber AS line_number", "l_quantity AS volume",
        "l_extendedprice / NULLIF(l_quantity, 0D) AS price", "1D AS base_price", "1D AS demand")
    parts = demand_moments(lines, ["site", "line_number"])
    return _fitted(merge_moments(parts, ["site"])).drop("demand")


def price_range_trend(spark: SparkSession, path: str) -> DataFrame:
    """Prices of the last week, however many hours of it have a quote; panes of half a day."""
    hourly = read_supply_events(spark, path).withColumnRenamed("hour", "tick")
    rows = _rounded(quotes(hourly, market_params(spark), ["site", "tick"]), "price").select("site", "product", "tick", "price")
    return _rounded(range_trend(rows, ["site", "product"], 168, 12), "mean_price")


def supply_range_trend(spark: SparkSession, path: str) -> DataFrame:
    """Volumes that a site received in the five days up to each event, by the minute, from panes of three hours."""
    events = read_supply_events(spark, path).selectExpr("event_id", "site", f"{minute_tick('ts')} AS tick", "volume")
    return _rounded(range_trend(events, ["site"], 7200, 180, value="volume"), "mean_volume")


def watched_supply(spark: SparkSession, path: str) -> DataFrame:
    """Supply of every site, product and day as written, and beside it what its limits say, from the same pass."""
    supply, watch = watched(_daily(spark, path).groupBy("site", "product", "tick").agg(
        exact_sum("volume").alias("volume")), invariant_limits("volume", high=400.0))
    out = shared_folder(spark, "watched")
    supply.write.parquet(out)
    rows = spark.read.schema(supply.schema).parquet(out)
    return rows.unionByName(watch.report(spark), allowMissingColumns=True)


def scenario_frontier(spark: SparkSession, path: str) -> DataFrame:
    """The settings of each site's grid that no other beats in revenue, volume made and mass left over."""
    with_checkpoints(spark)
    tasks = spark.sparkContext.defaultParallelism
    grid = scenario_grid(_pooled_configs(spark, path), GRID, ["site"], tasks)
    results = evaluate_scenarios(grid, recipes(spark), market_params(spark), ["site", "grid_id"])
    totals = results.groupBy("site", "grid_id").agg(
        exact_sum("revenue").alias("revenue"), exact_sum("volume").alias("made"),
        F.max(F.expr("ABS(residual_fat) + ABS(residual_snf) + ABS(residual_water)")).alias("left_over"))
    return frontier(_rounded(totals, "revenue", "made", "left_over"), ["site"], ["revenue"], ["made", "left_over"])


def price_feed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Hourly feed of everything that closes, through the parquet sink."""
    out, state = shared_folder(spark, "feed"), shared_folder(spark, "feed-state")
    feed = price_feed(read_supply_stream(spark, path, FILES_PER_BATCH), market_params(spark))
    write_quotes(feed, out, state).awaitTermination()
    return _rounded(spark.read.schema(feed.schema).parquet(out), "price", "revenue")


def price_direction_feed(spark: SparkSession, path: str) -> DataFrame:
    out, state = shared_folder(spark, "moves"), shared_folder(spark, "moves-state")
    own = spark.newSession()  # the state store is a setting of a session; the caller's stays
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    feed = price_feed(read_supply_stream(own, path, FILES_PER_BATCH), market_params(own))
    write_quotes(price_direction_stream(feed), out, state).awaitTermination()
    return _moves(spark.read.schema(DIRECTION_SCHEMA).parquet(out))


def params_stream(spark: SparkSession, path: str) -> DataFrame:
    """Arriving facts with the parameters in effect, resolved per micro-batch."""
    out, state = shared_folder(spark, "params"), shared_folder(spark, "params-state")
    facts = read_fact_stream(spark, path, FILES_PER_BATCH)
    params_in_effect_stream(
        facts, lambda: read_param_changes(spark, path), _asof, out, state).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def _keyed_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that keyed state needs; the caller's stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _arriving(spark: SparkSession, path: str, run: Callable[[str], StreamingQuery]) -> None:
    """Events come late and out of order, a slice at a time; after each, the stream goes on where it was."""
    folder = shared_folder(spark, "arrivals")
    for k, part in enumerate(late_slices(spark, path, 3)):
        part.write.parquet(f"{folder}/events-{k}.parquet")
        run(folder).awaitTermination()


def price_feed_amended(spark: SparkSession, path: str) -> DataFrame:
    """Last versions of the hourly feed, whose windows late events amend."""
    out, state = shared_folder(spark, "versions"), shared_folder(spark, "versions-state")

    def run(folder: str) -> StreamingQuery:
        feed = price_feed(read_supply_stream(spark, folder), market_params(spark))
        return write_amended(feed, out, state)

    _arriving(spark, path, run)
    return _rounded(latest(spark, out).drop("version"), "price", "revenue")


def params_keyed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Facts with the parameters in effect from keyed state, where changes come after facts as well."""
    out, state = shared_folder(spark, "keyed"), shared_folder(spark, "keyed-state")
    own = _keyed_session(spark)
    paths = {p: PARAM_PATHS[p] for p in _LOG_PATHS}
    schema = []

    def run(folder: str) -> StreamingQuery:
        found = params_in_effect_keyed(read_arrivals(own, folder), ["site"], paths, DEFAULT_CONFIG, salts=2)
        schema[:] = [found.schema]
        return write_quotes(found, out, state)

    _arriving(spark, path, run)
    return spark.read.schema(schema[0]).parquet(out)


CATALOGUE: dict[str, Query] = {
    "cream_and_skim_by_site": cream_and_skim_by_site,
    "lot_masses_by_site": lot_masses_by_site,
    "closure_by_site": closure_by_site,
    "composition_by_site": composition_by_site,
    "domain_violations": domain_violations,
    "yield_split_by_recipe": yield_split_by_recipe,
    "churn_split_by_powder": churn_split_by_powder,
    "allocate_flows": allocate_flows,
    "recipe_rejects": recipe_rejects,
    "pooled_cream": pooled_cream,
    "milk_union": milk_union,
    "lot_volume_decimal": lot_volume_decimal,
    "lot_rejects": lot_rejects,
    "powder_rejects": powder_rejects,
    "plant_rejects": plant_rejects,
    "unallocated_flows": unallocated_flows,
    "masses_by_region": masses_by_region,
    "lot_ledger_rollup": lot_ledger_rollup,
    "ledger_edges": ledger_edges,
    "plant_mass_balance": plant_mass_balance,
    "movement_balance": movement_balance,
    "node_reconciliation": node_reconciliation,
    "order_line_reconciliation": order_line_reconciliation,
    "supply_wide": supply_wide,
    "supply_long": supply_long,
    "elastic_prices": elastic_prices,
    "price_sensitivity": price_sensitivity_by_site,
    "revenue_by_day": revenue_by_day,
    "revenue_rollup": revenue_rollup,
    "revenue_top3": revenue_top3,
    "revenue_sorted": revenue_sorted,
    "revenue_top100": revenue_top100,
    "product_rejects": product_rejects,
    "price_direction": price_direction_by_day,
    "price_direction_segmented": price_direction_segmented,
    "price_trend": price_trend_by_day,
    "price_trend_segmented": price_trend_segmented,
    "bar_ratio": bar_ratio_by_day,
    "market_override": market_override,
    "asof_params": asof_params_by_fact,
    "asof_params_small_log": asof_params_small_log,
    "scenario_override": scenario_override,
    "scenario_sweep": scenario_sweep,
    "scenario_delta": scenario_delta,
    "best_scenario": best_scenario_by_site,
    "scenario_invariants": scenario_invariants,
    "result_invariants": result_invariants,
    "scenario_table": scenario_table,
    "grid_sweep": grid_sweep,
    "maintained_production": maintained_production,
    "maintained_scenarios": maintained_scenarios,
    "network_throughput": network_throughput,
    "price_announced": price_announced,
    "fitted_market": fitted_market,
    "fitted_order_prices": fitted_order_prices,
    "scenario_frontier": scenario_frontier,
    "price_range_trend": price_range_trend,
    "supply_range_trend": supply_range_trend,
    "watched_supply": watched_supply,
    "price_feed_stream": price_feed_stream,
    "price_direction_stream": price_direction_feed,
    "params_stream": params_stream,
    "price_feed_amended": price_feed_amended,
    "params_keyed_stream": params_keyed_stream,
}
