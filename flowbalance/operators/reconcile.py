"""Two-sided reconciliation: what went in against what came out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..constants import AUDIT_TOLERANCE_PCT, COMPONENTS
from ..functions.composition import fan, number
from ..functions.exact import exact_sum

INFLOW_KINDS = ("milk",)
OUTFLOW_KINDS = ("cheese", "whey", "butter", "powder")
INNER_NODES = ("separator", "cheese_a", "cheese_b", "pool", "butter_a", "butter_b")


def _listed(names: Sequence[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def audit(
    sums: DataFrame, keys: Sequence[str], components: Sequence[str],
    tol_pct: float = AUDIT_TOLERANCE_PCT,
) -> DataFrame:
    """One row per key and component from columns ``in_<c>`` and ``out_<c>``."""
    rows = fan([f"STRUCT('{c}' AS component, in_{c} AS total_in, out_{c} AS total_out)"
                for c in components])
    return sums.selectExpr(*keys, rows).selectExpr(
        "*",
        "total_in - total_out AS residual",
        "IF(total_in > 0, ABS(residual) / total_in * 100D, 0D) AS err_pct",
        f"err_pct < {number(tol_pct)} AS ok",
    )


def reconcile(
    inflow: DataFrame, outflow: DataFrame, keys: Sequence[str],
    components: Sequence[str] = COMPONENTS, tol_pct: float = AUDIT_TOLERANCE_PCT,
) -> DataFrame:
    """Residual per key and component; a key known to one side only counts 0 on the other.

    Both sides go through one aggregate instead of two aggregates and a full outer join: one
    shuffle, map-side partial sums, and no join that a hot key could skew.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.selectExpr(*keys, *[f"{c} AS {name}_{c}" for c in components])

    both = side(inflow, "in").unionByName(side(outflow, "out"), allowMissingColumns=True)
    sums = both.groupBy(*keys).agg(*[
        exact_sum(f"{s}_{c}").alias(f"{s}_{c}") for s in ("in", "out") for c in components])
    return audit(sums, keys, components, tol_pct)


def mass_balance(
    movements: DataFrame, keys: Sequence[str], tol_pct: float = AUDIT_TOLERANCE_PCT
) -> DataFrame:
    """Raw milk against finished products; internal movements do not count."""
    sums = movements.groupBy(*keys).agg(*[
        exact_sum(c, where=f"kind IN ({_listed(kinds)})").alias(f"{name}_{c}")
        for name, kinds in (("in", INFLOW_KINDS), ("out", OUTFLOW_KINDS)) for c in COMPONENTS])
    return audit(sums, keys, COMPONENTS, tol_pct)


def node_balance(
    movements: DataFrame, keys: Sequence[str], tol_pct: float = AUDIT_TOLERANCE_PCT
) -> DataFrame:
    """The same per node. Movements are summed per edge first, so only a handful of rows per key
    is doubled into an arriving and a leaving side."""
    edges = movements.groupBy(*keys, "from_node", "to_node").agg(
        *[exact_sum(c).alias(c) for c in COMPONENTS])
    sides = edges.selectExpr(*keys, *COMPONENTS, fan([
        "STRUCT(to_node AS node, true AS arrives)", "STRUCT(from_node AS node, false AS arrives)"]))
    sums = sides.where(f"node IN ({_listed(INNER_NODES)})").groupBy(*keys, "node").agg(*[
        exact_sum(c, where=side).alias(f"{name}_{c}")
        for name, side in (("in", "arrives"), ("out", "NOT arrives")) for c in COMPONENTS])
    return audit(sums, [*keys, "node"], COMPONENTS, tol_pct)
