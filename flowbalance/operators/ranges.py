"""Means and extremes over a span of time, from stored panes, at a cost that does not grow with the span.

A quote at ``t`` looks back over all quotes of its key from ``t - span`` to ``t``, however irregular their ticks are.
Time is cut into panes; a span is a whole number ``m`` of them, so it always consists of

* the head: its own pane up to ``t``,
* the middle: the ``m - 1`` whole panes before, read from one thin row per key and pane,
* the tail: the pane before those, from ``t - span`` on. Its quotes, moved on by a span, fall into the quote's own pane.

Head and tail are running frames over one key and pane, which hold each quote twice. The middle is cut the same way,
into blocks of ``m - 1`` panes: it is the end of one block and the beginning of the next, two running frames over
panes. No frame slides, so nothing is added up again per row, and no group is larger than a pane of quotes or two blocks of panes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exact import exact_halves, whole

#: What a pane stores, and how two stored values become one.
_MERGE = {"high": "SUM", "low": "SUM", "n": "SUM", "least": "MIN", "most": "MAX"}


def _floor_div(x: str, width: int) -> str:
    """Integer division that rounds down, also below zero."""
    return f"(({x} - PMOD({x}, {width}L)) DIV {width}L)"


def pane_aggregates(
    quotes: DataFrame, keys: Sequence[str], pane: int, order: str = "tick", value: str = "price"
) -> DataFrame:
    """One row per key and pane of ``order``: ``pane``, the halves of the exact sum, count and extremes of ``value``.

    Rows without a time belong to no pane. The result may be stored and merged with that of later quotes.
    """
    high, low = exact_halves(value, weight="1")
    return (quotes.where(F.col(order).isNotNull())
            .groupBy(*keys, F.expr(_floor_div(order, pane)).alias("pane"))
            .agg(high.alias("high"), low.alias("low"), F.count(value).alias("n"), F.min(value).alias("least"),
                 F.max(value).alias("most")))


def merge_panes(panes: DataFrame, keys: Sequence[str], width: int = 1) -> DataFrame:
    """Panes of several sources as one, ``width`` of them to a coarser pane."""
    return panes.groupBy(*keys, F.expr(_floor_div("pane", width)).alias("pane")).agg(
        *[F.expr(f"{how}({c})").alias(c) for c, how in _MERGE.items()])


def _over(window: WindowSpec, prefix: str, named: str) -> dict[str, Column]:
    return {f"{named}{c}": F.expr(f"{how}({prefix}{c})").over(window) for c, how in _MERGE.items()}


def _middles(panes: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Per key and pane, the merged ``length`` panes before it, as ``mid_*``.

    A pane stands at its own number as data for later ones, at the number plus ``length`` as data for the block
    after, and at the number before its own as the one who asks.
    """
    def fields(at: str, asks: str, now: bool, late: bool) -> str:
        def given(c: str, there: bool) -> str:
            return c if there else f"CAST(NULL AS {'DOUBLE' if c in ('least', 'most') else 'BIGINT'})"

        values = [f"{given(c, now)} AS {c}" for c in _MERGE] + [f"{given(c, late)} AS late_{c}" for c in _MERGE]
        return f"STRUCT({at} AS at, CAST({asks} AS BIGINT) AS asks, {', '.join(values)})"

    roles = [fields("pane", "NULL", True, False), fields(f"pane + {length}", "NULL", False, True), fields("pane - 1", "pane", False, False)]
    asked = panes.selectExpr(*keys, f"INLINE(ARRAY({', '.join(roles)}))").withColumn("_block", F.expr(_floor_div("at", length)))
    block = Window.partitionBy(*keys, "_block")
    upto = block.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = block.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    merged = asked.withColumns(_over(upto, "", "_a_")).withColumns(_over(beyond, "late_", "_b_")).where("asks IS NOT NULL")
    return merged.selectExpr(*keys, "asks AS pane", *[f"{_two('_a_' + c, '_b_' + c, how)} AS mid_{c}" for c, how in _MERGE.items()])


def _two(a: str, b: str, how: str) -> str:
    return f"COALESCE({a}, 0L) + COALESCE({b}, 0L)" if how == "SUM" else f"{'LEAST' if how == 'MIN' else 'GREATEST'}({a}, {b})"


def range_trend(
    quotes: DataFrame, keys: Sequence[str], span: int, pane: int, order: str = "tick", value: str = "price",
    panes: DataFrame | None = None,
) -> DataFrame:
    """Count, mean, least and greatest ``value`` of the key from ``span`` before a row up to it, ties included.

    ``order`` is an integer; ``span`` is a multiple of ``pane``. ``panes`` are stored ``pane_aggregates`` of the same
    quotes; then quotes are read for heads and tails only. A row without a time keeps NULL figures; missing
    values do not count, and a span without any has a mean of NULL. Columns: ``n_<value>``, ``mean_<value>``, ``min_<value>``, ``max_<value>``.
    """
    if pane < 1 or span < pane or span % pane:
        raise ValueError(f"a span of {span} is no whole number of panes of {pane}")
    whole_panes = span // pane - 1
    columns = [f"`{c}`" for c in quotes.columns]
    # The row itself travels as one struct, so that its columns cannot clash with those made here.
    row = f"STRUCT({', '.join(columns)}) AS _row"
    own = quotes.selectExpr(*keys, f"{order} AS _at", f"{_floor_div(order, pane)} AS _pane", f"CAST({value} AS DOUBLE) AS _v",
        "CAST(NULL AS DOUBLE) AS _w", row)
    kind = own.schema["_row"].dataType.simpleString()
    none = f"CAST(NULL AS {kind}) AS _row"
    late = quotes.where(F.col(order).isNotNull()).selectExpr(
        *keys, f"{order} + {span} AS _at", f"{_floor_div(order, pane)} + {span // pane} AS _pane",
        "CAST(NULL AS DOUBLE) AS _v", f"CAST({value} AS DOUBLE) AS _w", none)
    rows = own.unionByName(late)
    if whole_panes:
        if panes is None:
            panes = pane_aggregates(quotes, keys, pane, order, value)
        mids = _middles(panes, keys, whole_panes).selectExpr(
            *keys, f"pane * {pane} AS _at", "pane AS _pane", "CAST(NULL AS DOUBLE) AS _v", "CAST(NULL AS DOUBLE) AS _w",
            none, *[f"mid_{c}" for c in _MERGE])
        rows = rows.unionByName(mids, allowMissingColumns=True)
    group = Window.partitionBy(*keys, "_pane")
    head = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def summed(x: str, window: WindowSpec, named: str) -> dict[str, Column]:
        high, low = exact_halves(x, weight="1")
        return {f"{named}high": high.over(window), f"{named}low": low.over(window), f"{named}n": F.count(x).over(window),
                f"{named}least": F.min(x).over(window), f"{named}most": F.max(x).over(window)}

    parts = ["_h_", "_t_"]
    found = rows.withColumns(summed("_v", head, "_h_")).withColumns(summed("_w", tail, "_t_"))
    if whole_panes:
        # one row of a key and pane has the middle; its place in the pane does not matter
        found = found.withColumns({f"_m_{c}": F.max(f"mid_{c}").over(group) for c in _MERGE})
        parts.append("_m_")

    def all_of(c: str) -> str:
        merged = parts[0] + c
        for p in parts[1:]:
            merged = f"({_two(merged, p + c, _MERGE[c])})"
        return merged

    timed = f"_row.`{order}` IS NOT NULL"
    return found.where("_row IS NOT NULL").selectExpr(
        "_row.*", f"IF({timed}, {all_of('n')}, NULL) AS `n_{value}`",
        f"IF({timed} AND {all_of('n')} > 0, {whole(all_of('high'), all_of('low'))} / {all_of('n')}, NULL) AS `mean_{value}`",
        f"IF({timed}, {all_of('least')}, NULL) AS `min_{value}`", f"IF({timed}, {all_of('most')}, NULL) AS `max_{value}`")
