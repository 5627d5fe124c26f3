"""Tables of what-if scenarios: build, evaluate, compare, check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, isfinite, prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COMPONENTS, CONFIG_GROUPS, DEFAULT_CONFIG, PRODUCTS
from ..functions.composition import fan, quoted
from ..functions.exact import exact_sum
from ..plans.ledger import plant, plant_totals
from ..sources.dims import sql_literal
from .accounting import BOUNDS, PLANT_INPUTS, to_long, within
from .market import elastic_price, market_products, market_supply
from .pairing import paired
from .params import apply_overrides


def _group_struct(group: str, settings: Mapping[str, object] | None) -> str:
    """A typed struct of a group's settings, NULL when the scenario leaves the group alone."""
    fields = CONFIG_GROUPS[group]
    if settings is None:
        kinds = {f: "string" if isinstance(DEFAULT_CONFIG[f], str) else "double" for f in fields}
        schema = ", ".join(f"{f}: {kinds[f]}" for f in fields)
        return f"CAST(NULL AS STRUCT<{schema}>) AS {group}"
    whole = {f: settings.get(f, DEFAULT_CONFIG[f]) for f in fields}
    return f"STRUCT({', '.join(f'{sql_literal(v)} AS {f}' for f, v in whole.items())}) AS {group}"


def with_scenarios(
    configs: DataFrame, scenarios: Sequence[tuple[str, Mapping[str, Mapping[str, object]]]]
) -> DataFrame:
    """Every configuration under every scenario of a short list, overrides applied.

    The list is a literal in the plan, so each row is multiplied in place: no join. An override
    that names only some settings of a group takes the rest of that group from the defaults.
    """
    used = [g for g in CONFIG_GROUPS if any(g in changes for _, changes in scenarios)]
    options = []
    for i, (name, changes) in enumerate(scenarios):
        groups = [_group_struct(g, changes.get(g)) for g in used]
        head = [f"{i} AS scenario_id", f"{sql_literal(name)} AS scenario"]
        options.append(f"STRUCT({', '.join(head + groups)})")
    return apply_overrides(configs.selectExpr("*", fan(options)))


def _fit(values: Mapping[str, object], bounds: Mapping[str, tuple[float, float]]) -> bool:
    """What ``within`` says of settings that are literals."""
    for name, value in values.items():
        low, high = bounds.get(name, (0.0 if name == "volume" else -inf, inf))
        if value is None or not isfinite(value) or not low <= value <= high:
            return False
    return not {"fat_pct", "snf_pct"} <= set(values) or values["fat_pct"] + values["snf_pct"] <= 100


def with_usable_scenarios(
    configs: DataFrame, scenarios: Sequence[tuple[str, Mapping[str, Mapping[str, object]]]],
    inputs: Sequence[str] = PLANT_INPUTS, bounds: Mapping[str, tuple[float, float]] = BOUNDS,
) -> DataFrame:
    """``usable(with_scenarios(configs, scenarios), inputs)`` whose settings are compared once, not per scenario.

    A configuration carries a bit for each group of its own settings that isn't usable; a scenario
    forgives the bits of the groups it replaces. Its own settings are judged here.
    """
    groups = {g: [f for f in fields if f in inputs] for g, fields in CONFIG_GROUPS.items()}
    groups[""] = [f for f in inputs if not any(f in fields for fields in CONFIG_GROUPS.values())]
    bit = {g: 1 << k for k, g in enumerate(g for g, fields in groups.items() if fields)}
    own = " + ".join(f"IF(COALESCE({within(groups[g], bounds)}, FALSE), 0, {b})" for g, b in bit.items())
    verdicts = []
    for i, (_, changes) in enumerate(scenarios):
        fit = all(_fit({f: changes[g].get(f, DEFAULT_CONFIG[f]) for f in groups[g]}, bounds) for g in changes)
        counts = sum(b for g, b in bit.items() if g not in changes)
        verdicts.append(f"WHEN {i} THEN {f'_unfit & {counts} = 0' if fit else 'FALSE'}")
    tried = with_scenarios(configs.withColumn("_unfit", F.expr(own)), scenarios)
    return tried.where(f"CASE scenario_id {' '.join(verdicts)} END").drop("_unfit")


def with_scenario_table(
    configs: DataFrame, scenarios: DataFrame, keys: Sequence[str], shares: int | None = None
) -> DataFrame:
    """Every configuration under every scenario of a table, overrides applied.

    ``scenarios`` has ``scenario_id`` and, per group of settings it touches, a nullable struct named
    after the group. See ``paired`` for how configurations and scenarios meet.
    """
    return apply_overrides(paired(configs, scenarios, keys, shares))


def scenario_grid(
    base: DataFrame, ranges: Mapping[str, Sequence[object]], keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """All combinations of the value lists for every row of ``base``, told apart by ``grid_id``.

    Each list multiplies the rows in place, one after the other, so combinations stream through
    the task row by row and the grid is never held, whatever its size. ``grid_id`` is a number
    whose digits, in mixed radix, index the lists, the first list being the lowest digit.
    ``partitions`` spreads the grid before heavy work, as a small ``base`` may sit in a single
    partition; it does so by ``keys`` and ``grid_id``, which a later aggregate by the same columns
    needs no second shuffle for.
    """
    others = [quoted(c) for c in base.columns if c not in ranges]
    grid = base.selectExpr(*others, "0L AS grid_id")
    stride = prod(len(values) for values in ranges.values())
    done: list[str] = []
    for name, values in reversed(ranges.items()):
        stride //= len(values)
        listed = ", ".join(
            f"STRUCT({i * stride}L AS _step, {sql_literal(v)} AS _value)"
            for i, v in enumerate(values))
        grid = grid.selectExpr("*", f"INLINE(ARRAY({listed}))").selectExpr(
            *others, *done, "grid_id + _step AS grid_id", f"_value AS {quoted(name)}")
        done.append(quoted(name))
    if partitions is not None:
        grid = grid.repartition(partitions, *keys, "grid_id")
    return grid


def evaluate_scenarios(
    configs: DataFrame, recipes: DataFrame, market: DataFrame, keys: Sequence[str],
    check: bool = True,
) -> DataFrame:
    """Production, price and revenue per key and product, with the residuals of the key.

    Everything up to the one aggregate is narrow. Unusable configurations are left out as in
    ``plant``; where the rows were filtered before they were multiplied, ``check=False`` saves it.
    """
    return price_totals(plant_totals(plant(configs, recipes, check), keys), market, keys)


def price_totals(totals: DataFrame, market: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price and revenue per key and product from ``plant_totals``, computed or maintained."""
    residuals = [f"residual_{c}" for c in COMPONENTS]
    totals = totals.selectExpr("*", *[f"in_{c} - out_{c} AS residual_{c}" for c in COMPONENTS])
    listed = market_products(market)
    if listed is None:
        made = to_long(totals, [*keys, *residuals], PRODUCTS)
        return elastic_price(market_supply(made, market, [*keys, *residuals]), market)
    unmade = {p: F.lit(0.0) for p in listed if p not in PRODUCTS}
    return elastic_price(to_long(totals.withColumns(unmade), [*keys, *residuals], listed), market)


def compare_scenarios(
    results: DataFrame, baseline: int, keys: Sequence[str],
    metrics: Sequence[str] = ("volume", "price", "revenue"), scenario: str = "scenario_id",
) -> DataFrame:
    """Difference of each metric to the baseline scenario of the same key.

    The window holds one row per scenario. It reads ``results`` once, where a self join would
    evaluate all scenarios a second time.
    """
    peers = Window.partitionBy(*keys)
    is_base = F.col(scenario) == baseline
    return results.withColumns({
        f"delta_{m}": F.col(m) - F.max(F.when(is_base, F.col(m))).over(peers) for m in metrics})


def best_scenario(
    results: DataFrame, keys: Sequence[str], scenario: str = "scenario_id"
) -> DataFrame:
    """The scenario with the highest total revenue per key; the lower id wins a tie."""
    total = results.groupBy(*keys, scenario).agg(exact_sum("revenue").alias("revenue"))
    best = F.max(F.struct(F.col("revenue"), (-F.col(scenario)).alias("rank")))
    return total.groupBy(*keys).agg(best.alias("best")).select(
        *keys, (-F.col("best.rank")).alias(scenario), F.col("best.revenue").alias("revenue"))


def flow_invariants(
    wide: DataFrame, keys: Sequence[str], flows: Sequence[str], tol: float = 1e-6
) -> DataFrame:
    """``invariants`` over the columns ``flows`` of every row, before anything is summed.

    A value counts as negative from half of ``tol`` below zero on, which rounding can't reach.
    """
    each = [quoted(c) for c in flows]
    low = f"LEAST({', '.join(f'IF(ISNAN({c}), NULL, {c})' for c in each)})"
    high = f"GREATEST({', '.join(f'IF(ISNAN({c}), NULL, {c})' for c in each)})"
    n_nan = " + ".join(f"IF(ISNAN({c}), 1, 0)" for c in each)
    n_negative = " + ".join(f"IF({c} < -{tol / 2!r}D, 1, 0)" for c in each)
    return (wide.selectExpr(*keys, f"{low} AS _low", f"{high} AS _high", f"{n_nan} AS _nan",
                            f"{n_negative} AS _negative")
            .groupBy(*keys).agg(
                (F.count(F.lit(1)) * len(each)).alias("n_rows"),
                F.sum("_nan").alias("n_nan"), F.sum("_negative").alias("n_negative"),
                F.min("_low").alias("min_value"), F.max("_high").alias("max_value"),
                ((F.sum("_nan") == 0) & (F.sum("_negative") == 0)).alias("sound")))


def invariants(results: DataFrame, keys: Sequence[str], value: str = "volume") -> DataFrame:
    """Counts of NaN and negative values, extremes, and whether every row is sound."""
    v = F.col(value)
    number = F.when(~F.isnan(v), v)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(number < 0).alias("n_negative"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.coalesce(F.bool_and(~F.isnan(v) & (v >= 0)), F.lit(True)).alias("sound"),
    )
