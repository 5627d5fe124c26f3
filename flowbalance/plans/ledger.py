"""The plant ledger: every lot through separation, cheese, cream pool and butter.

A lot stays one wide row until the end, so the whole ledger is narrow: no shuffle and no regroup
for the cream pool. Long rows exist only in the output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AUDIT_TOLERANCE_PCT,
    CHEESE_TYPES,
    COMPONENTS,
    MASSES,
    POWDER_TYPES,
    PRODUCTS,
)
from ..functions.composition import fan, flow_struct
from ..functions.exact import exact_sum
from ..operators.accounting import PLANT_INPUTS, usable
from ..operators.fanout import (
    run_steps,
    step_churn_split,
    step_masses,
    step_share,
    step_split_to_target,
    step_yield_split,
)
from ..operators.lookup import with_recipe
from ..operators.reconcile import audit
from ..sources.dims import sql_literal

# from_node, to_node, kind, prefix of the flow, product (itself or the column that names it)
EDGES = (
    ("producer", "separator", "milk", "milk", None),
    ("separator", "pool", "cream", "cream", None),
    ("separator", "cheese_a", "skim", "skim_a", None),
    ("separator", "cheese_b", "skim", "skim_b", None),
    ("cheese_a", "market", "cheese", "curd_a", "cheese_a"),
    ("cheese_b", "market", "cheese", "curd_b", "cheese_b"),
    ("cheese_a", "market", "whey", "whey_a", "whey"),
    ("cheese_b", "market", "whey", "whey_b", "whey"),
    ("cheese_a", "pool", "excess_cream", "excess_a", None),
    ("cheese_b", "pool", "excess_cream", "excess_b", None),
    ("pool", "butter_a", "cream", "cream_a", None),
    ("pool", "butter_b", "cream", "cream_b", None),
    ("butter_a", "market", "butter", "butter_a", "butter"),
    ("butter_b", "market", "butter", "butter_b", "butter"),
    ("butter_a", "market", "powder", "dried_a", "powder_a"),
    ("butter_b", "market", "powder", "dried_b", "powder_b"),
)

_NAMED_BY = {"cheese_a": CHEESE_TYPES, "cheese_b": CHEESE_TYPES,
             "powder_a": POWDER_TYPES, "powder_b": POWDER_TYPES}


def plant(
    lots: DataFrame, recipes: DataFrame, check: bool = True,
    powders: Sequence[str] = POWDER_TYPES,
) -> DataFrame:
    """One wide row per lot with all flows of the plant.

    Lots with unusable settings are in ``rejected(lots, PLANT_INPUTS)``, lots whose cheese types
    have no recipe, or whose powders nobody makes, in ``unknown_lots``. ``check=False`` is for lots
    whose numbers were checked before.
    """
    known = usable(lots, PLANT_INPUTS, apart=True) if check else lots
    listed = ", ".join(sql_literal(p) for p in powders)
    known = known.where(f"powder_a IN ({listed}) AND powder_b IN ({listed})")
    df = with_recipe(known, recipes, "cheese_a", "recipe_a")
    df = with_recipe(df, recipes, "cheese_b", "recipe_b")
    pool = {f"pool_{m}": f"cream_{m} + excess_a_{m} + excess_b_{m}" for m in MASSES}
    return run_steps(
        df,
        step_masses("milk"),
        step_split_to_target("milk", "cream", "skim", "cream_fat_pct"),
        step_share("skim", "skim_a", "skim_b", "skim_split_pct"),
        step_yield_split("skim_a", "curd_a", "whey_a", "excess_a", "recipe_a"),
        step_yield_split("skim_b", "curd_b", "whey_b", "excess_b", "recipe_b"),
        pool,
        step_share("pool", "cream_a", "cream_b", "cream_split_pct"),
        *[step_churn_split(f"cream_{side}", f"butter_{side}", f"dried_{side}",
                           f"butter_{side}_fat_pct", f"powder_{side}")
          for side in ("a", "b")],
    )


def unknown_lots(
    lots: DataFrame, recipes: DataFrame, powders: Sequence[str] = POWDER_TYPES
) -> DataFrame:
    """Lots that ``plant`` cannot process, each once. One pass: lookups that find nothing are NULL."""
    df = lots
    for key in ("cheese_a", "cheese_b"):
        known = recipes.select(F.col("cheese_type").alias(key), F.lit(True).alias(f"_{key}"))
        df = df.join(known, key, "left")
    listed = ", ".join(sql_literal(p) for p in powders)
    makes = " AND ".join(f"COALESCE({p} IN ({listed}), FALSE)" for p in ("powder_a", "powder_b"))
    return df.where(f"_cheese_a IS NULL OR _cheese_b IS NULL OR NOT ({makes})").select(*lots.columns)


def cream_pool(
    milk: DataFrame, recipes: DataFrame, keys: Sequence[str], target_pct: str = "cream_fat_pct"
) -> DataFrame:
    """Separated cream and surplus cream of whole-milk cheese per key, from one wide row per lot."""
    wide = run_steps(
        with_recipe(milk.withColumnsRenamed({m: f"src_{m}" for m in MASSES}), recipes),
        step_split_to_target("src", "cream", "skim", target_pct),
        step_yield_split("src", "curd", "whey", "excess"))
    return wide.groupBy(*keys).agg(*[
        exact_sum(f"cream_{m}", f"excess_{m}").alias(m) for m in MASSES])


def sold_flows(masses: Sequence[str] = ("volume",)) -> list[str]:
    """Columns of ``plant`` that leave for the market."""
    return [f"{prefix}_{m}" for _, target, _, prefix, _ in EDGES if target == "market"
            for m in masses]


def _product(name: str | None) -> str:
    if name is None:
        return "CAST(NULL AS STRING)"
    return f"'{name}'" if name in PRODUCTS else name


def lot_ledger(
    lots: DataFrame, recipes: DataFrame, keys: Sequence[str],
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Movements of every lot: ``keys, from_node, to_node, kind, product`` and the masses.

    ``kinds`` restricts them where the long rows are made, so that the others, and the columns
    only they need, are never computed.
    """
    return plant(lots, recipes).selectExpr(*keys, fan([
        flow_struct(prefix, from_node=f"'{source}'", to_node=f"'{target}'", kind=f"'{kind}'",
                    product=_product(product))
        for source, target, kind, prefix, product in EDGES if kinds is None or kind in kinds]))


def production_by_product(movements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Volume sold per product, from long movements. The two plants of a lot add up."""
    return (movements.where("product IS NOT NULL")
            .groupBy(*keys, "product").agg(exact_sum("volume").alias("volume")))


def plant_measures() -> dict[str, list[str]]:
    """What is summed over lots: production of every product and both sides of the audit, each as
    the columns of ``plant`` that add up to it."""
    sold = [(prefix, product) for _, target, _, prefix, product in EDGES if target == "market"]
    measures = {name: [
        f"{prefix}_volume" if product == name
        else f"IF({product} = '{name}', {prefix}_volume, 0D)"
        for prefix, product in sold if product == name or name in _NAMED_BY.get(product, ())]
        for name in PRODUCTS}
    measures |= {f"in_{c}": [f"milk_{c}"] for c in COMPONENTS}
    return measures | {f"out_{c}": [f"{prefix}_{c}" for prefix, _ in sold] for c in COMPONENTS}


def plant_totals(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Production of every product and both sides of the audit per key, in one aggregate.

    It works on wide rows: per lot one row enters the hash aggregate instead of sixteen.
    """
    return wide.groupBy(*keys).agg(*[
        exact_sum(*parts).alias(name) for name, parts in plant_measures().items()])


def plant_balance(
    wide: DataFrame, keys: Sequence[str], tol_pct: float = AUDIT_TOLERANCE_PCT
) -> DataFrame:
    """Raw milk against finished products per key and component."""
    return audit(plant_totals(wide, keys), keys, COMPONENTS, tol_pct)
