from __future__ import annotations

import random

import pytest
from conftest import TINY, by

from flowbalance.functions.exact import exact_sum
from flowbalance.operators.maintain import (
    apply_changes,
    inconsistent,
    merge_sums,
    read_sums,
    signed_changes,
    signed_sums,
)
from flowbalance.plans.ledger import plant, plant_measures, plant_totals
from flowbalance.sources import read_lots

ROW = "id int, k string, x double, y double"
SUMS = {"x": ["x"], "both": ["x", "y"]}


def table(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_deltas_equal_a_recomputation_to_the_bit(spark, tmp_path):
    rng = random.Random(4)
    path, state, keys = str(tmp_path / "sums"), {}, ["k"]

    def row(i):
        return (i, rng.choice(["a", "b", "c", None]), rng.uniform(-1e5, 1e9), rng.choice([0.0, -3.3, 1e-6]))

    for number in range(5):
        fresh = [row(1000 * number + i) for i in range(60)]
        gone = rng.sample(sorted(state.values(), key=lambda r: r[0]), len(state) // 3)
        left = [r for r in state.values() if r not in gone]
        old = rng.sample(sorted(left, key=lambda r: r[0]), len(left) // 3)
        new = [row(r[0]) for r in old]
        state = {r[0]: r for r in [*(r for r in left if r not in old), *new, *fresh]}
        changes = signed_changes(table(spark, fresh), table(spark, gone), (table(spark, old), table(spark, new)))
        stored = apply_changes(spark, path, number, signed_sums(changes, keys, SUMS), keys)
    before = sorted(map(tuple, stored.collect()), key=str)
    again = apply_changes(spark, path, number, signed_sums(changes, keys, SUMS), keys)  # a repeated batch
    assert sorted(map(tuple, again.collect()), key=str) == before
    want = by(table(spark, list(state.values())).groupBy("k").agg(exact_sum("x").alias("x"), exact_sum("x", "y").alias("both")), "k")
    got = by(read_sums(again, keys, list(SUMS)), "k")
    assert {k: (r.x, r.both) for k, r in got.items()} == {k: (r.x, r.both) for k, r in want.items()}
    assert {r.k: r.n_rows for r in again.collect()} == {k: sum(r[1] == k for r in state.values()) for k in want}


def test_a_row_and_its_opposite_leave_no_trace(spark):
    rows = table(spark, [(1, "a", 1e9 / 3, 0.1), (2, "b", 2.0, 3.0)])
    here = signed_sums(signed_changes(rows), ["k"], SUMS)
    gone = signed_sums(signed_changes(deleted=rows.where("k = 'a'")), ["k"], SUMS)
    left = merge_sums(here, gone, ["k"])
    assert [r.k for r in left.collect()] == ["b"] and inconsistent(left).isEmpty()
    twice = merge_sums(left, gone, ["k"])
    assert [r.k for r in inconsistent(twice).collect()] == ["a"]
    other = signed_sums(signed_changes(rows.where("k = 'b'"), rows.where("k = 'b'").selectExpr("id", "k", "x + 1 AS x", "y")), ["k"], SUMS)
    assert sorted(r.k for r in inconsistent(merge_sums(gone, other, ["k"])).collect()) == ["a", "b"]
    wrong = merge_sums(here.where("false"), other, ["k"])  # a changed row that was never there: no rows, but a sum
    assert [r.k for r in inconsistent(wrong).collect()] == ["b"]
    with pytest.raises(ValueError):
        signed_changes()


def test_the_plants_totals_are_maintained(spark, recipes):
    lots = read_lots(spark, TINY)
    changes = signed_changes(lots, lots.where("order_key % 3 = 0"))
    stored = signed_sums(plant(changes, recipes), ["site"], plant_measures())
    got = by(read_sums(stored, ["site"], list(plant_measures())), "site")
    want = by(plant_totals(plant(lots.where("order_key % 3 <> 0"), recipes), ["site"]), "site")
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in want.items()}
