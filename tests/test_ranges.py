from __future__ import annotations

import math

import numpy as np
import pytest

from flowbalance.operators.ranges import merge_panes, pane_aggregates, range_trend

SCHEMA = "id int, site int, tick int, price double"
FIGURES = ("n_price", "mean_price", "min_price", "max_price")


def by_hand(rows, span):
    found = {}
    for i, site, tick, _ in rows:
        seen = [p for _, s, t, p in rows if s == site and t is not None and tick is not None and tick - span <= t <= tick and p is not None]
        found[i] = ((None,) * 4 if tick is None else
                    (len(seen), sum(seen) / len(seen) if seen else None, min(seen, default=None), max(seen, default=None)))
    return found


def figures(df):
    return {r.id: tuple(r[c] for c in FIGURES) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w), i


def quotes_of(seed, n=300, sites=(1, 2, None)):
    rng = np.random.default_rng(seed)
    rows = [(i, sites[i % len(sites)], int(rng.integers(-150, 250)), float(round(rng.uniform(-9, 99), 3))) for i in range(n)]
    rows += [(n + k, 1, 7, 5.0) for k in range(5)] + [(n + 5, 1, None, 3.0), (n + 6, 2, 9, None), (n + 7, 9, 0, None), (n + 8, 1, 9999, 1.0)]
    return rows


@pytest.mark.parametrize(("span", "pane"), [(10, 10), (20, 10), (30, 10), (70, 7), (120, 5), (400, 100), (1, 1)])
def test_equals_all_pairs(spark, span, pane):
    rows = quotes_of(span)
    same(figures(range_trend(spark.createDataFrame(rows, SCHEMA), ["site"], span, pane)), by_hand(rows, span))


def test_stored_panes_stand_for_the_middle(spark):
    rows = quotes_of(5)
    df = spark.createDataFrame(rows, SCHEMA)
    halves = [pane_aggregates(df.where(f"id % 2 = {k}"), ["site"], 5) for k in (0, 1)]
    stored = merge_panes(halves[0].unionByName(halves[1]), ["site"])
    same(figures(range_trend(df, ["site"], 60, 5, panes=stored)), by_hand(rows, 60))
    coarse = merge_panes(stored, ["site"], 2)
    same(figures(range_trend(df, ["site"], 60, 10, panes=coarse)), by_hand(rows, 60))


def test_empty_and_clashing_columns(spark):
    assert range_trend(spark.createDataFrame([], SCHEMA), ["site"], 6, 2).isEmpty()
    rows = [(1, 1, 3, 2.0, 1, 7, 8.0), (2, 1, 4, 4.0, 2, 9, 8.0)]
    df = spark.createDataFrame(rows, SCHEMA + ", _pane int, pane int, n double")
    got = range_trend(df, ["site"], 6, 2)
    assert got.columns == [*df.columns, *FIGURES]
    assert sorted((r._pane, r.pane, r.mean_price) for r in got.collect()) == [(1, 7, 2.0), (2, 9, 3.0)]


def test_spans_that_are_no_panes(spark):
    for span, pane in ((5, 2), (0, 1), (2, 4), (4, 0)):
        with pytest.raises(ValueError, match="panes"):
            range_trend(spark.createDataFrame([], SCHEMA), ["site"], span, pane)


def test_work_does_not_grow_with_the_span(spark):
    """Rows that enter the window frames: each quote twice and each pane three times, whatever the span."""
    df = spark.createDataFrame(quotes_of(3, 200), SCHEMA)

    def windowed(span):
        plan = range_trend(df, ["site"], span, 10)._jdf.queryExecution().toString()
        return plan.count("Window ["), plan.count("Generate")

    assert windowed(50) == windowed(5000)
    assert math.isclose(range_trend(df, ["site"], 5000, 10).agg({"n_price": "max"}).first()[0], max(v[0] or 0 for v in by_hand(quotes_of(3, 200), 5000).values()))
