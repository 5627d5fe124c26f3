from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import by

from flowbalance.constants import DEFAULT_CONFIG
from flowbalance.functions.clock import day_tick, hour_tick
from flowbalance.operators.params import apply_overrides, asof_params, untimed
from flowbalance.sources import defaults

PATHS = {"separator.targetCreamFatPercent": "cream_fat_pct", "skimSplitPercent": "skim_split_pct"}
FACT = "fact_id long, site int, ts timestamp_ntz"
CHANGE = "change_id long, site int, ts timestamp_ntz, path string, value double"
START = dt.datetime(2024, 1, 1)


def latest(changes, site, ts, path, default):
    known = [(c[2], c[0], c[4]) for c in changes if c[1] == site and c[3] == path and c[2] <= ts]
    return max(known)[2] if known else default


@pytest.mark.parametrize("options", [
    {}, {"salts": 4}, {"bucket": day_tick, "era": 2}, {"bucket": hour_tick, "era": 5, "salts": 3}])
def test_asof_against_brute_force_with_a_hot_key(spark, options):
    """Site 0 has most facts and changes; many share a timestamp with each other."""
    rng = random.Random(7)

    def moment():
        return START + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 3, 30))

    def site():
        return 0 if rng.random() < 0.7 else rng.randrange(1, 5)

    facts = [(i, site(), moment()) for i in range(400)]
    changes = [(i, site(), moment(), rng.choice(list(PATHS)), float(rng.randrange(30, 46)))
               for i in range(120)] + [(999, 0, START, "unknown.path", 1.0)]
    got = by(asof_params(spark.createDataFrame(facts, FACT), spark.createDataFrame(changes, CHANGE),
                         ["site"], PATHS, DEFAULT_CONFIG, **options), "fact_id")
    assert len(got) == len(facts)
    for fact_id, where, ts in facts:
        for path, column in PATHS.items():
            want = latest(changes, where, ts, path, DEFAULT_CONFIG[column])
            assert got[fact_id][column] == want, (fact_id, column)


def test_asof_spans_empty_buckets_and_keeps_facts_without_changes(spark):
    facts = spark.createDataFrame([(1, 1, START), (2, 1, START + dt.timedelta(days=90)),
                                   (3, 2, START)], FACT)
    changes = spark.createDataFrame(
        [(1, 1, START + dt.timedelta(seconds=1), "skimSplitPercent", 75.0)], CHANGE)
    got = by(asof_params(facts, changes, ["site"], PATHS, DEFAULT_CONFIG), "fact_id")
    assert [got[i].skim_split_pct for i in (1, 2, 3)] == [50.0, 75.0, 50.0]
    assert {r.cream_fat_pct for r in got.values()} == {40.0}


@pytest.mark.parametrize("options", [{}, {"salts": 3}, {"bucket": hour_tick, "era": 24}])
def test_rows_without_a_time(spark, options):
    """Such a fact gets the defaults, such a change is never in effect and is listed."""
    facts = spark.createDataFrame([(1, 1, None), (2, 1, START), (3, 1, None)], FACT)
    changes = spark.createDataFrame([(1, 1, None, "skimSplitPercent", 80.0), (2, 1, None, "skimSplitPercent", 70.0),
                                     (3, 2, START, "skimSplitPercent", 60.0)], CHANGE)
    got = by(asof_params(facts, changes, ["site"], PATHS, DEFAULT_CONFIG, **options), "fact_id")
    assert {i: r.skim_split_pct for i, r in got.items()} == {1: 50.0, 2: 50.0, 3: 50.0}
    assert sorted(r.change_id for r in untimed(changes).collect()) == [1, 2]


def test_facts_are_not_grouped_by_key_alone(spark):
    facts = spark.createDataFrame([(1, 1, START)], FACT)
    changes = spark.createDataFrame([(1, 1, START, "skimSplitPercent", 75.0)], CHANGE)
    plan = asof_params(facts, changes, ["site"], PATHS, DEFAULT_CONFIG, salts=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    last_window = text[text.index("Window"):].split("\n")[0]
    assert "_bucket" in last_window and "_salt" in last_window
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ticks_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(START + dt.timedelta(hours=5, minutes=59),)], "ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        row = df.selectExpr(f"{day_tick('ts')} AS d", f"{hour_tick('ts')} AS h").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    days = (START.date() - dt.date(1970, 1, 1)).days
    assert (row.d, row.h) == (days, days * 24 + 5)


def test_a_group_replaces_the_default_as_a_whole(spark):
    rows = defaults(spark).selectExpr(
        "*",
        "named_struct('butter_a_fat_pct', 78D, 'powder_a', 'wmp') AS butter_plant_a",
        "CAST(NULL AS STRUCT<cheese_a: STRING>) AS cheese_plant_a")
    got = apply_overrides(rows).first().asDict()
    assert got == {**DEFAULT_CONFIG, "butter_a_fat_pct": 78.0, "powder_a": "wmp"}
