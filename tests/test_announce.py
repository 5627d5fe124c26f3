from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbalance.operators.announce import (
    SAME,
    announced_moves,
    applied,
    band_edges,
    composed,
    segment_pieces,
)
from flowbalance.sources.sinks import with_checkpoints

QUOTE = "site int, product string, tick long, price double"


def told(prices, band):
    """(announced, delta, direction) quote by quote."""
    state, out = math.nan, []
    for p in prices:
        known = p is not None and not math.isnan(p)
        delta = p - state if known and not math.isnan(state) else 0.0
        move = "up" if delta > band else "down" if delta < -band else "flat"
        if known and (math.isnan(state) or move != "flat"):
            state = p
        out.append((state, delta, move))
    return out


def walk(rng, n):
    prices, p = [], 10.0
    for _ in range(n):
        p += rng.choice([0.0, 0.01, -0.01, 0.03, -0.03, 0.2, -0.2])
        prices.append(round(p, 6))
    return prices


@pytest.mark.parametrize("fan", [3, 64])
def test_segments_and_tree_equal_the_sequence(spark, fan):
    with_checkpoints(spark)
    rng = random.Random(fan)
    series = {(1, "hot"): walk(rng, 200), (1, "b"): walk(rng, 7), (2, "b"): [5.0], (None, None): walk(rng, 60), (3, "gaps"): [None, math.nan, 1.0, None, 1.02, 1.2, math.nan]}
    rows = [(*key, 13 * i - 100, p) for key, prices in series.items() for i, p in enumerate(prices)]
    quotes = spark.createDataFrame(rows, QUOTE).withColumn("note", F.lit("kept")).repartition(5)
    got = announced_moves(quotes, ["site", "product"], 0.05, F.expr("FLOOR(tick / 100)"), fan=fan)
    assert got.columns == ["site", "product", "tick", "price", "note", "announced", "delta", "direction"]
    found = {(r.site, r["product"], r.tick): (r.announced, r.delta, r.direction) for r in got.collect()}
    assert len(found) == len(rows)
    for key, prices in series.items():
        for i, want in enumerate(told(prices, 0.05)):
            have = found[(*key, 13 * i - 100)]
            assert have[1:] == want[1:]
            assert have[0] == want[0] or (math.isnan(want[0]) and (have[0] is None or math.isnan(have[0])))
    assert announced_moves(quotes.where("false"), ["site", "product"], 0.05, F.expr("tick DIV 100")).isEmpty()


def test_hysteresis_differs_from_the_last_quote():
    """A slow drift is announced, although no step leaves the band."""
    assert [m for _, _, m in told([1.0, 1.03, 1.06, 1.09, 1.12], 0.05)] == ["flat", "flat", "up", "flat", "up"]


def test_pieces_do_what_the_sequence_does():
    rng = random.Random(8)
    for _ in range(60):
        prices, band = walk(rng, rng.randrange(1, 40)), rng.choice([0.0, 0.02, 0.05, 0.3])
        pieces, fresh = segment_pieces(np.array(prices), band)
        assert fresh == told(prices, band)[-1][0]
        for a in [*prices, 9.0, 11.0, 10.05, -1e300, 1e300, *(x + d for x in prices[:5] for d in (band, -band))]:
            assert applied(pieces, a) == told([a, *prices], band)[-1][0]
        k = rng.randrange(len(prices) + 1)
        parts = [segment_pieces(np.array(p), band)[0] if p else SAME for p in (prices[:k], prices[k:])]
        assert composed(*parts)[0] == pieces[0]


def test_band_edges_are_exact():
    rng = random.Random(9)
    prices = np.array([rng.uniform(-1e3, 1e3) for _ in range(200)] + [0.0, 1.0, 1e17, -1e17, 1e-300, 0.05])
    for band in (0.0, 0.05, 1.0):
        low, high = band_edges(prices, band)
        assert (prices - low <= band).all() and (high - prices <= band).all()
        assert (prices - np.nextafter(low, -np.inf) > band).all() and (np.nextafter(high, np.inf) - prices > band).all()
