"""Splits of a flow into several flows.

Each split exists once, as a step on wide rows: it reads the flow under one prefix and defines
the flows it makes under others. A step is an ordered mapping of column names to expressions, in
which later ones use earlier ones by name (lateral column aliases), so that a chain of steps is one
``select``. The public operators run one step and fan the result out into long rows; the plant
ledger chains the steps on one row per lot. All of it is narrow.

Catalyst turns the chain into projections and keeps two of them apart where merging them would
repeat an expression, so expression trees stay small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    BUTTER_SNF_FRACTION,
    CASEIN_SHARE_OF_SNF,
    CHURN_FAT_RECOVERY,
    EXCESS_FAT_THRESHOLD,
    LEAN_FAT_FRACTION,
    MASSES,
    WHOLE_MILK_POWDER_FAT_FRACTION,
)
from ..functions.composition import fan, flow_struct, mass_names, number, quotient
from .lookup import with_recipe

Step = dict[str, str]


def run_steps(df: DataFrame, *steps: Step) -> DataFrame:
    """Add the columns of all steps, each of which may use the columns of those before it."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for step in steps for name, sql in step.items()])


def step_masses(into: str) -> Step:
    """Percentages of the volume to masses; water is what remains."""
    return {
        f"{into}_volume": "volume",
        f"{into}_fat": f"volume * {quotient('fat_pct', '100D')}",
        f"{into}_snf": f"volume * {quotient('snf_pct', '100D')}",
        f"{into}_water": f"volume - {into}_fat - {into}_snf",
    }


def step_split_to_target(
    src: str, rich: str, lean: str, target_pct: str, lean_fraction: float = LEAN_FAT_FRACTION,
) -> Step:
    """Split so that ``rich`` has the target fat content and ``lean`` the given fat fraction.

    A flow without volume gives two empty flows. A target that is missing or equal to the lean
    fraction cannot be met; ``rich`` is then empty and everything stays in ``lean``.
    """
    goal, floor = f"{rich}_goal", number(lean_fraction)
    surplus = f"{src}_volume * ({quotient(f'{src}_fat', f'{src}_volume')} - {floor})"
    return {
        goal: f"COALESCE({target_pct} / 100D, {floor})",
        f"{rich}_volume": quotient(surplus, f"{goal} - {floor}"),
        f"{rich}_fat": f"{rich}_volume * {goal}",
        f"{rich}_snf": f"{src}_snf * {quotient(f'{rich}_volume', f'{src}_volume')}",
        f"{rich}_water": f"{rich}_volume - {rich}_fat - {rich}_snf",
        f"{lean}_volume": f"{src}_volume - {rich}_volume",
        f"{lean}_fat": f"{src}_fat - {rich}_fat",
        f"{lean}_snf": f"{src}_snf - {rich}_snf",
        f"{lean}_water": f"{lean}_volume - {lean}_fat - {lean}_snf",
    }


def step_yield_split(src: str, cheese: str, whey: str, excess: str, recipe: str = "") -> Step:
    """Curd, whey and surplus fat by the recipe columns on the row.

    ``recipe`` prefixes the recipe columns. Surplus fat up to the threshold is dropped, which the
    mass balance shows as a residual.
    """
    dot = f"{recipe}_" if recipe else ""
    casein = f"({src}_snf * {number(CASEIN_SHARE_OF_SNF)})"
    kept, solids = f"{src}_fat_kept", f"{cheese}_solids"
    surplus = f"{src}_fat - {kept}"
    return {
        kept: f"LEAST({quotient(casein, f'{dot}casein_fat_ratio')}, {src}_fat)",
        f"{excess}_volume": f"IF({surplus} > {number(EXCESS_FAT_THRESHOLD)}, {surplus}, 0D)",
        f"{excess}_fat": f"{excess}_volume",
        f"{excess}_snf": "0D",
        f"{excess}_water": "0D",
        f"{cheese}_fat": f"{kept} * {dot}fat_recovery",
        f"{cheese}_snf": f"{casein} * {dot}casein_recovery",
        solids: f"{cheese}_fat + {cheese}_snf",
        f"{cheese}_volume": quotient(solids, f"1D - {dot}moisture"),
        f"{cheese}_water": f"{cheese}_volume - {solids}",
        f"{whey}_fat": f"{kept} - {cheese}_fat",
        f"{whey}_snf": f"{src}_snf - {cheese}_snf",
        f"{whey}_water": f"{src}_water - {cheese}_water",
        f"{whey}_volume": f"{whey}_fat + {whey}_snf + {whey}_water",
    }


def step_churn_split(
    src: str, butter: str, powder: str, target_pct: str, powder_type: str
) -> Step:
    """Butter at the target fat content, the rest is dried to powder with its water.

    Whole milk powder takes pure fat back from the butter until it has its own fat fraction.
    """
    fat = f"({src}_fat * {number(CHURN_FAT_RECOVERY)})"
    churned, moved = f"{src}_churned", f"{src}_moved"
    left, left_fat = f"({src}_volume - {churned})", f"({src}_fat - {fat})"
    goal = WHOLE_MILK_POWDER_FAT_FRACTION
    lacking = quotient(f"{number(goal)} * {left} - {left_fat}", number(1 - goal))
    return {
        churned: quotient(fat, quotient(target_pct, "100D")),
        moved: f"IF({powder_type} = 'wmp', {lacking}, 0D)",
        f"{butter}_snf": f"{churned} * {number(BUTTER_SNF_FRACTION)}",
        f"{butter}_water": f"{churned} - {fat} - {butter}_snf",
        f"{butter}_volume": f"{churned} - {moved}",
        f"{butter}_fat": f"{fat} - {moved}",
        f"{powder}_volume": f"{left} + {moved}",
        f"{powder}_fat": f"{left_fat} + {moved}",
        f"{powder}_snf": f"{src}_snf - {butter}_snf",
        f"{powder}_water": f"{src}_water - {butter}_water",
    }


def step_share(src: str, first: str, second: str, percent: str) -> Step:
    """Proportional shares of a flow: a percentage of it, and what that leaves."""
    share = f"{first}_share"
    return {
        share: quotient(percent, "100D"),
        **{f"{first}_{m}": f"{src}_{m} * {share}" for m in MASSES},
        **{f"{second}_{m}": f"{src}_{m} * (1D - {share})" for m in MASSES},
    }


def fan_out(df: DataFrame, keep: Sequence[str], legs: Mapping[str, str]) -> DataFrame:
    """Long rows ``keep..., kind, volume, fat, snf, water`` from the flows under the prefixes."""
    return df.selectExpr(*keep, fan([
        flow_struct(prefix, kind=f"'{kind}'") for kind, prefix in legs.items()]))


def _prefixed(flows: DataFrame, prefix: str) -> DataFrame:
    """Move the masses of a long row under a prefix, so that a wide step can read them."""
    return flows.withColumnsRenamed(dict(zip(MASSES, mass_names(prefix))))


def _other(flows: DataFrame, *dropped: str) -> list[str]:
    return [c for c in flows.columns if c not in {*MASSES, "kind", *dropped}]


def split_to_target(
    flows: DataFrame, target_pct: str | float, lean_fraction: float = LEAN_FAT_FRACTION
) -> DataFrame:
    """Two rows per flow: ``cream`` at the target (a number or a column) and ``skim``."""
    target = target_pct if isinstance(target_pct, str) else number(target_pct)
    wide = run_steps(_prefixed(flows, "src"),
                     step_split_to_target("src", "cream", "skim", target, lean_fraction))
    return fan_out(wide, _other(flows), {"cream": "cream", "skim": "skim"})


def yield_split(flows: DataFrame, recipes: DataFrame) -> DataFrame:
    """Three rows per flow: ``cheese``, ``whey`` and ``excess_cream`` by ``cheese_type``."""
    wide = run_steps(with_recipe(_prefixed(flows, "src"), recipes),
                     step_yield_split("src", "cheese", "whey", "excess"))
    return fan_out(wide, _other(flows),
                   {"cheese": "cheese", "whey": "whey", "excess_cream": "excess"})


def churn_split(
    flows: DataFrame, target_pct: str = "butter_fat_pct", powder_type: str = "powder_type"
) -> DataFrame:
    """Two rows per flow: ``butter`` and ``powder``, with the ``product`` each is sold as."""
    wide = run_steps(_prefixed(flows, "src"),
                     step_churn_split("src", "butter", "powder", target_pct, powder_type))
    return wide.selectExpr(*_other(flows, "product"), fan([
        flow_struct("butter", kind="'butter'", product="'butter'"),
        flow_struct("powder", kind="'powder'", product=powder_type)]))


def checked_allocations(allocations: DataFrame) -> DataFrame:
    """The routing table with a verdict per source node.

    ``valid`` is false when a fraction is missing or lies outside 0..1 or the fractions do not add up to 1.
    ``share`` is the fraction, except that the last target takes one minus the others.
    """
    node = Window.partitionBy("from_node")
    in_order = node.orderBy("ord")
    before = F.sum("fraction").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    is_last = F.lead("ord").over(in_order).isNull()
    return allocations.withColumns({
        "valid": F.bool_and(F.coalesce(F.col("fraction").between(0.0, 1.0), F.lit(False))).over(node)
        & (F.abs(F.sum("fraction").over(node) - 1.0) < 1e-9),
        "share": F.when(is_last, F.lit(1.0) - F.coalesce(before, F.lit(0.0)))
        .otherwise(F.col("fraction")),
    })


def allocate(flows: DataFrame, allocations: DataFrame, node: str = "node") -> DataFrame:
    """Send each flow on to the targets of its node, in proportion.

    Flows of a node without a valid routing are in ``unallocated``.
    """
    routes = checked_allocations(allocations).filter("valid").select(
        F.col("from_node").alias(node), "to_node", "share")
    return flows.join(routes, node).withColumns(
        {m: F.col(m) * F.col("share") for m in MASSES}).drop("share")


def unallocated(flows: DataFrame, allocations: DataFrame, node: str = "node") -> DataFrame:
    routes = checked_allocations(allocations).filter("valid").select(
        F.col("from_node").alias(node)).distinct()
    return flows.join(routes, node, "left_anti")
