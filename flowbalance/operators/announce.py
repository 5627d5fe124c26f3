"""Price moves with hysteresis: a quote is announced when it leaves the dead band around the last announced one.

What was announced before decides what is announced next, so ``lag`` cannot express it. Time is cut into
segments. What a segment does is a function from the price announced before it to the one announced after it:
constant pieces, and one stretch of prices that it leaves as they are. Such functions compose into such
functions, so they are folded in a tree of ``fan`` children a node, and the announced prices then come down the
tree. No group but a segment's own quotes grows with a key's history; a node holds ``fan`` functions, whose pieces
are few, as trajectories that announce one common price stay together.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGN = np.int64(np.iinfo(np.int64).min)
#: (cuts between pieces, value of each piece; NaN leaves the price as it is).
Pieces = tuple[list[float], list[float]]
SAME: Pieces = ([], [math.nan])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, _SIGN - bits, bits)


def _doubles(n: np.ndarray) -> np.ndarray:
    return np.where(n < 0, _SIGN - n, n).view(np.float64)


def band_edges(prices: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest announced price that each quote leaves as it is, exactly as doubles compare."""
    edges = []
    for side in (-1, 1):  # the farthest double to that side from which the quote is within the band
        inside = _ordered(prices)
        outside = np.full(len(prices), _ordered(np.array([side * np.finfo(float).max]))[0])
        for _ in range(65):
            middle = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
            with np.errstate(over="ignore"):
                within = side * (_doubles(middle) - prices) <= band
            inside, outside = np.where(within, middle, inside), np.where(within, outside, middle)
        edges.append(_doubles(inside))
    return edges[0], edges[1]


def _tidy(cuts: list[float], values: list[float]) -> Pieces:
    """Neighbours of one value are one piece."""
    out_cuts, out = [], values[:1]
    for cut, value in zip(cuts, values[1:]):
        if value != out[-1] and not (math.isnan(value) and math.isnan(out[-1])):
            out_cuts.append(cut)
            out.append(value)
    return out_cuts, out


def applied(pieces: Pieces, price: float) -> float:
    value = pieces[1][bisect_right(pieces[0], price)]
    return price if math.isnan(value) else value


def composed(first: Pieces, second: Pieces) -> Pieces:
    """``second`` after ``first``."""
    cuts: list[float] = []
    values: list[float] = []
    bounds = [-math.inf, *first[0], math.inf]
    for low, high, value in zip(bounds, bounds[1:], first[1]):
        if values:
            cuts.append(low)
        if not math.isnan(value):
            values.append(applied(second, value))
            continue
        a, b = bisect_right(second[0], low), bisect_right(second[0], high)
        inner = [c for c in second[0][a:b] if low < c < high]
        cuts += inner
        values += second[1][a:a + len(inner) + 1]
    return _tidy(cuts, values)


def segment_pieces(prices: np.ndarray, band: float) -> tuple[Pieces, float]:
    """(what a segment does with a price announced before it, what it announces if nothing was)."""
    low, high = band_edges(prices, band)
    after = np.nextafter(high, np.inf)
    pieces, fresh = SAME, math.nan
    for p, a, b in zip(prices.tolist(), low.tolist(), after.tolist()):
        pieces = composed(pieces, ([a, b], [p, math.nan, p]))
        fresh = p if math.isnan(fresh) or abs(p - fresh) > band else fresh
    return pieces, fresh


_TABLE = "_at long, cuts array<double>, values array<double>, fresh double"


def _folded(tables: pd.DataFrame) -> tuple[Pieces, float]:
    pieces, fresh = SAME, math.nan
    for row in tables.sort_values("_at").itertuples():
        own = (list(row.cuts), list(row.values))
        pieces = composed(pieces, own)
        fresh = row.fresh if math.isnan(fresh) else applied(own, fresh)
    return pieces, fresh


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_r_{k}"])
    return named, on


def announced_moves(
    quotes: DataFrame, keys: Sequence[str], band: float, segment: Column, order: str = "tick",
    fan: int = 64,
) -> DataFrame:
    """Adds ``announced`` (the price announced after a quote), ``delta`` to the one before and ``direction``.

    ``segment`` is an integer that grows with ``order``; ``order`` tells a key's quotes apart. The first
    quote of a key is announced and flat. A quote without a number changes nothing. Needs a checkpoint folder.
    """
    cut = quotes.withColumn("_at", segment.cast("long"))
    least = cut.agg(F.min("_at")).first()[0]
    cut = cut.withColumn("_at", F.col("_at") - F.lit(least or 0))
    named, keys = _fields(quotes, keys), list(keys)
    shown = [*quotes.columns, "announced", "delta", "direction"]

    def key_row(frame: pd.DataFrame) -> list:
        return [frame[k].iloc[0] for k in keys]

    def table_of(rows: pd.DataFrame) -> pd.DataFrame:
        prices = rows.sort_values(order)["price"].dropna().to_numpy(np.float64)
        (cuts, values), fresh = segment_pieces(prices, band)
        return pd.DataFrame([[*key_row(rows), rows["_at"].iloc[0], cuts, values, fresh]], columns=[*keys, "_at", "cuts", "values", "fresh"])

    def parent_of(rows: pd.DataFrame) -> pd.DataFrame:
        (cuts, values), fresh = _folded(rows)
        return pd.DataFrame([[*key_row(rows), rows["_at"].iloc[0] // fan, cuts, values, fresh]], columns=[*keys, "_at", "cuts", "values", "fresh"])

    def children_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        state, states = rows["_before"].iloc[0], []
        state = math.nan if state is None else state
        for row in rows.itertuples():
            states.append(state)
            state = row.fresh if math.isnan(state) else applied((list(row.cuts), list(row.values)), state)
        return pd.DataFrame({**{k: rows[k] for k in keys}, "_at": rows["_at"], "_before": states})

    def moves_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        state = rows["_before"].iloc[0]
        state = math.nan if state is None else state
        announced, deltas, directions = [], [], []
        for p in rows["price"]:
            known = p is not None and not math.isnan(p)
            delta = p - state if known and not math.isnan(state) else 0.0
            move = "up" if delta > band else "down" if delta < -band else "flat"
            if known and (math.isnan(state) or move != "flat"):
                state = p
            announced.append(state)
            deltas.append(delta)
            directions.append(move)
        return rows.assign(announced=announced, delta=deltas, direction=directions)[shown]

    slim = cut.select(*keys, "_at", order, F.col("price").cast("double").alias("price"))
    levels = [slim.groupBy(*keys, "_at").applyInPandas(table_of, f"{named}, {_TABLE}").checkpoint()]
    while not levels[-1].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        above = levels[-1].groupBy(*keys, F.expr(f"_at DIV {fan}").alias("_parent")).applyInPandas(
            lambda _, rows: parent_of(rows), f"{named}, {_TABLE}")
        levels.append(above.checkpoint())
    states = levels[-1].select(*keys, "_at", F.lit(None).cast("double").alias("_before"))
    for level in reversed(levels[:-1]):
        right, on = _same(keys, level, states.withColumnRenamed("_at", "_parent"))
        met = level.join(right, on & (F.expr(f"_at DIV {fan}") == F.col("_parent"))).select(*level.columns, "_parent", "_before")
        states = met.groupBy(*keys, "_parent").applyInPandas(
            lambda _, rows: children_of(rows), f"{named}, _at long, _before double")
    right, on = _same(keys, cut, states.withColumnRenamed("_at", "_own"))
    opened = cut.join(right, on & (F.col("_at") == F.col("_own"))).select(*cut.columns, "_before")
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quotes.schema)
    return opened.groupBy(*keys, "_at").applyInPandas(
        lambda _, rows: moves_of(rows), f"{result}, announced double, delta double, direction string")
