"""Elasticity and demand read back from quotes: the price formula inverted by least squares.

``price = base * (demand / volume) ^ elasticity`` is a line in logarithms. Against the market's own figures,
``ln(price / base)`` falls with ``ln(volume / demand)`` by the elasticity, and where it crosses zero lies the demand.
Six moments a key hold all that a fit needs. They are plain aggregates, combined before the shuffle, and moments
of parts (days, files, sites) merge into those of the whole without a second look at the quotes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithms of quotes that a fit may use; the rest is counted as left out.
_USABLE = ("volume > 0D AND price > 0D AND base_price > 0D AND demand > 0D AND NOT ISNAN(volume) AND NOT ISNAN(price) "
           "AND volume < DOUBLE('Infinity') AND price < DOUBLE('Infinity')")


def demand_moments(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments per key of quotes that carry ``volume``, ``price``, ``base_price`` and ``demand``.

    ``x`` is ln(volume / demand), ``y`` is ln(price / base_price); second moments are centred. A quote whose price
    or supply is missing, zero, negative or not finite is ``left_out``. A key has one reference demand.
    """
    logs = quotes.selectExpr(
        *keys, "demand", f"COALESCE({_USABLE}, FALSE) AS _use", f"IF({_USABLE}, LN(volume / demand), NULL) AS x",
        f"IF({_USABLE}, LN(price / base_price), NULL) AS y")
    return logs.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count_if(~F.col("_use")).alias("left_out"),
        F.min(F.when(F.col("_use"), F.col("demand"))).alias("demand"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.coalesce(F.expr("REGR_SXX(y, x)"), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.expr("REGR_SXY(y, x)"), F.lit(0.0)).alias("sxy"),
        F.coalesce(F.expr("REGR_SYY(y, x)"), F.lit(0.0)).alias("syy"))


def merge_moments(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of the coarser ``keys`` from those of their parts.

    A part's mean is a point of weight n; its spread about the whole's mean is added to the parts' own.
    """
    def between(a: str, b: str) -> str:
        return f"COALESCE(SUM(n * {a} * {b}) - SUM(n * {a}) * SUM(n * {b}) / NULLIF(SUM(n), 0), 0D)"

    whole = {
        "n": "SUM(n)", "left_out": "SUM(left_out)", "demand": "MIN(demand)", "min_x": "MIN(min_x)", "max_x": "MAX(max_x)",
        "mean_x": "SUM(n * mean_x) / NULLIF(SUM(n), 0)", "mean_y": "SUM(n * mean_y) / NULLIF(SUM(n), 0)",
        "sxx": f"SUM(sxx) + {between('mean_x', 'mean_x')}", "sxy": f"SUM(sxy) + {between('mean_x', 'mean_y')}",
        "syy": f"SUM(syy) + {between('mean_y', 'mean_y')}"}
    return moments.groupBy(*keys).agg(*[F.expr(x).alias(name) for name, x in whole.items()])


def fit_demand(moments: DataFrame, tol: float = 1e-9) -> DataFrame:
    """``elasticity``, ``demand``, ``r2`` and what became of the fit, per row of moments.

    ``outcome`` is ``none`` without a usable quote, ``point`` with one, ``constant`` where supply never differs by
    more than ``tol`` of itself, ``inelastic`` where the price does not react (demand is then undefined), else
    ``fitted``. Figures that do not exist are NULL; a price that never moves has no ``r2``.
    """
    kept = [c for c in moments.columns if c not in (
        "demand", "min_x", "max_x", "mean_x", "mean_y", "sxx", "sxy", "syy")]
    sloped = moments.selectExpr(
        "*", f"CASE WHEN n >= 2 AND max_x - min_x > {tol!r}D THEN -sxy / sxx END AS elasticity")
    flat = f"ABS(elasticity) <= {tol!r}D"
    return sloped.selectExpr(
        *kept, "elasticity",
        f"CASE WHEN NOT {flat} THEN demand * EXP(mean_x + mean_y / elasticity) END AS demand",
        f"CASE WHEN elasticity IS NOT NULL AND syy > {tol!r}D * {tol!r}D * n THEN sxy * sxy / (sxx * syy) END AS r2",
        f"CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'point' WHEN elasticity IS NULL THEN 'constant' "
        f"WHEN {flat} THEN 'inelastic' ELSE 'fitted' END AS outcome")
