"""Component masses, closure, composition, domains, pooling and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLOSURE_TOLERANCE, COMPONENTS, MASSES, MEMBERS, PRODUCTS, RANGES
from ..functions.composition import closure_gap, fan, number, percent_of, quoted
from ..functions.exact import exact_sum, most
from ..sources.dims import sql_literal

MILK_INPUTS = ("volume", "fat_pct", "snf_pct")
PLANT_INPUTS = tuple(RANGES)
#: What a plant can have, and what sums can hold: (least, most) of each input.
BOUNDS = {
    "volume": (0.0, most() / 1000),
    "fat_pct": (0.0, 100.0),
    "snf_pct": (0.0, 100.0),
    "cream_fat_pct": (1.0, 100.0),
    "skim_split_pct": (0.0, 100.0),
    "cream_split_pct": (0.0, 100.0),
    "butter_a_fat_pct": (1.0, 100.0),
    "butter_b_fat_pct": (1.0, 100.0),
}


def _solids(inputs: Sequence[str]) -> str | None:
    """Fat and the other solids together, where both are inputs: at most all of the milk."""
    return "fat_pct + snf_pct" if {"fat_pct", "snf_pct"} <= set(inputs) else None


def reject_reason(
    inputs: Sequence[str] = MILK_INPUTS, bounds: Mapping[str, tuple[float, float]] = BOUNDS
) -> str:
    """Why a lot cannot enter the ledger, NULL when it can. Zero volume is fine, NaN is not."""
    checks = [
        f"WHEN {c} IS NULL OR ISNAN({c}) OR ABS({c}) = DOUBLE('Infinity') "
        f"THEN '{c} is not a number'" for c in inputs]
    checks.append("WHEN volume < 0 THEN 'negative volume'")
    checks.append(f"WHEN NOT ABS({' + '.join(inputs)}) < DOUBLE('Infinity') "
                  "THEN 'beyond the range of DOUBLE'")
    checks += [f"WHEN {c} < {number(bounds[c][0])} THEN '{c} is too low' "
               f"WHEN {c} > {number(bounds[c][1])} THEN '{c} is too high'"
               for c in inputs if c in bounds]
    if (solids := _solids(inputs)) is not None:
        checks.append(f"WHEN {solids} > 100D THEN 'more solids than milk'")
    return f"CASE {' '.join(checks)} END"


def within(inputs: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> str:
    """The complement of ``reject_reason`` as plain comparisons; NULL counts as false.

    NaN is greater than any bound and NULL fails every comparison, so a bounded input needs no other
    check. The sum of all inputs is only checked where the bounds let it overflow.
    """
    checks = []
    for c in inputs:
        low, high = bounds.get(c, (float("-inf"), float("inf")))
        low = max(low, 0.0) if c == "volume" else low
        if c in bounds:
            checks += [f"{c} >= {number(low)}", f"{c} <= {number(high)}"]
        else:
            checks.append(f"ABS({c}) < DOUBLE('Infinity')")
            checks += ["volume >= 0D"] if c == "volume" else []
    most_of_all = sum(max(map(abs, bounds[c])) if c in bounds else float("inf") for c in inputs)
    if most_of_all == float("inf"):
        checks.append(f"ABS({' + '.join(inputs)}) < DOUBLE('Infinity')")
    if (solids := _solids(inputs)) is not None:
        checks.append(f"{solids} <= 100D")
    return " AND ".join(checks)


def usable(
    lots: DataFrame, inputs: Sequence[str] = MILK_INPUTS,
    bounds: Mapping[str, tuple[float, float]] = BOUNDS, apart: bool = False,
) -> DataFrame:
    """Lots whose ``inputs`` are numbers within ``bounds``; for the whole ledger ``PLANT_INPUTS``.

    ``apart`` compiles the filter on its own, for a stage whose method would become too large for the
    JVM to compile with it: a stage ends at a lambda, and the comparisons before it stay compiled.
    """
    checks = within(inputs, bounds)
    return lots.where(f"{checks} AND FORALL(ARRAY(volume), v -> v >= 0D)" if apart else checks)


def rejected(
    lots: DataFrame, inputs: Sequence[str] = MILK_INPUTS,
    bounds: Mapping[str, tuple[float, float]] = BOUNDS,
) -> DataFrame:
    """The other side of ``usable``: nothing is dropped without being listed here. The cheap
    complement filters first, so that only rejected lots go through the list of reasons."""
    return lots.where(f"NOT COALESCE({within(inputs, bounds)}, FALSE)").selectExpr(
        "*", f"{reject_reason(inputs, bounds)} AS reject_reason")


def component_masses(lots: DataFrame) -> DataFrame:
    """Turn percentages into masses; water is what remains."""
    return lots.selectExpr(
        "*",
        "volume * (fat_pct / 100D) AS fat",
        "volume * (snf_pct / 100D) AS snf",
        "volume - fat - snf AS water",
    )


def closure_check(flows: DataFrame, tol: float = CLOSURE_TOLERANCE) -> DataFrame:
    return flows.selectExpr("*", f"{closure_gap()} AS gap", f"gap < {number(tol)} AS closed")


def closure_summary(
    flows: DataFrame, keys: Sequence[str], tol: float = CLOSURE_TOLERANCE
) -> DataFrame:
    return _aggregate(closure_check(flows, tol), keys, {
        "n_flows": "COUNT(*)", "n_open": "COUNT_IF(NOT closed)", "max_gap": "MAX(gap)"})


def _aggregate(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(sql).alias(name) for name, sql in outputs.items()])


def composition_pct(flows: DataFrame) -> DataFrame:
    """Replaces or adds ``fat_pct``, ``snf_pct`` and ``water_pct`` computed from the masses."""
    added = {f"{c}_pct": f"{percent_of(c, 'volume')} AS {c}_pct" for c in COMPONENTS}
    return flows.selectExpr(*[c for c in flows.columns if c not in added], *added.values())


def domain_check(
    rows: DataFrame,
    ranges: Mapping[str, tuple[float, float]] = RANGES,
    members: Mapping[str, Sequence[str]] = MEMBERS,
) -> DataFrame:
    """One row per violated rule, with the columns of the input row kept.

    Clean rows are filtered before anything is fanned out, and nothing is shuffled. NaN is greater
    than any bound, so it is found.
    """
    broken = {c: ("range", f"NOT ({c} BETWEEN {number(low)} AND {number(high)})")
              for c, (low, high) in ranges.items()}
    broken |= {c: ("member", f"{c} NOT IN ({', '.join(repr(m) for m in allowed)})")
               for c, allowed in members.items()}
    any_broken = " OR ".join(f"{c} IS NULL OR {condition}" for c, (_, condition) in broken.items())
    checks = fan([
        f"STRUCT('{c}' AS parameter, CASE WHEN {c} IS NULL THEN 'missing' "
        f"WHEN {condition} THEN '{rule}' END AS rule, CAST({c} AS STRING) AS found)"
        for c, (rule, condition) in broken.items()])
    return rows.where(any_broken).selectExpr("*", checks).where("rule IS NOT NULL")


def domain_summary(violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _aggregate(violations, [*keys, "parameter", "rule"], {"n_violations": "COUNT(*)"})


def producing(supply: DataFrame) -> DataFrame:
    # NaN compares greater than any number, so it has to be excluded by name.
    return supply.where("volume > 0 AND NOT ISNAN(volume)")


def union_flows(*flows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, flows)


def pool(flows: DataFrame, keys: Sequence[str], spine: DataFrame | None = None) -> DataFrame:
    """Component-wise sum per key. Keys of ``spine`` without any flow come out as zeros.

    The spine joins in as zero flows, so the whole is one partial-then-final aggregate.
    """
    if spine is not None:
        zeros = spine.selectExpr(*keys, *[f"0D AS {m}" for m in MASSES])
        flows = flows.select(*keys, *MASSES).unionByName(zeros)
    return flows.groupBy(*keys).agg(*[exact_sum(m).alias(m) for m in MASSES])


def to_wide(
    supply: DataFrame, keys: Sequence[str], products: Sequence[str] = PRODUCTS
) -> DataFrame:
    """One row per key and one column per product, zero where a product is missing.

    Conditional sums over an explicit list take one shuffle; ``pivot`` would take two.
    """
    return supply.groupBy(*keys).agg(*[
        exact_sum("volume", where=f"product = {sql_literal(p)}").alias(p) for p in products])


def unknown_product(supply: DataFrame, products: Sequence[str] = PRODUCTS) -> DataFrame:
    """Supply of products outside the list, a missing product included: what ``to_wide`` and
    ``densify`` have no column for."""
    listed = ", ".join(sql_literal(p) for p in products)
    return supply.where(f"product IS NULL OR product NOT IN ({listed})")


def to_long(
    wide: DataFrame, keys: Sequence[str], products: Sequence[str] = PRODUCTS
) -> DataFrame:
    return wide.selectExpr(*keys, fan([
        f"STRUCT({i} AS product_ord, {sql_literal(p)} AS product, {quoted(p)} AS volume)"
        for i, p in enumerate(products)]))


def densify(
    supply: DataFrame, keys: Sequence[str], products: Sequence[str] = PRODUCTS
) -> DataFrame:
    """Supply per key with every product present. One shuffle, no spine join.

    The rows of a key come out together and stay hash-partitioned by the keys.
    """
    return to_long(to_wide(supply, keys, products), keys, products)
