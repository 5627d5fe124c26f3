"""Amended windows and keyed parameter state against batch results and brute force."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from conftest import by

from flowbalance.constants import DEFAULT_CONFIG, PARAM_PATHS
from flowbalance.operators.accounting import producing
from flowbalance.operators.market import quotes
from flowbalance.sources import read_arrivals, read_supply_events, read_supply_stream, write_quotes
from flowbalance.sources.tables import EVENT_SCHEMA
from flowbalance.streaming.amend import KEYS, create, latest, merge, versions, write_amended
from flowbalance.streaming.feed import ROCKSDB_PROVIDER, price_feed
from flowbalance.streaming.keyed import CHANGE, FACT, _InEffect, params_in_effect_keyed

START = dt.datetime(2024, 1, 1)


def event(i, hours, user, value, kind="view"):
    return (i, START + dt.timedelta(hours=hours), user, kind, float(value))


def arrive(spark, folder, number, events):
    spark.createDataFrame(events, EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/events-{number}.parquet")


def test_late_events_make_new_versions(spark, market, tmp_path):
    rng = random.Random(1)
    events = [event(i, i / 25, rng.randrange(90), rng.randrange(1, 50)) for i in range(400)]
    arrived = sorted(events, key=lambda e: e[0] + rng.randrange(25))  # up to an hour late
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(4):
        arrive(spark, tmp_path, k, arrived[100 * k:100 * k + 100])
        write_amended(price_feed(read_supply_stream(spark, str(tmp_path)), market), out, state).awaitTermination()
    got = by(latest(spark, out), *KEYS)
    spark.createDataFrame(events, EVENT_SCHEMA).write.parquet(str(tmp_path / "all" / "events.parquet"))
    supply = read_supply_events(spark, str(tmp_path / "all")).withColumnRenamed("hour", "tick")
    want = by(producing(quotes(supply, market, ["site", "tick"])), *KEYS)
    assert {k: (r.volume, r.price) for k, r in got.items()} == {k: (r.volume, r.price) for k, r in want.items()}
    history = versions(spark, out).collect()
    assert max(r.version for r in history) > 1
    for key in got:  # versions of a key are 1, 2, ... in the order of the batches
        own = sorted((r.batch_id, r.version) for r in history if tuple(r[c] for c in KEYS) == key)
        assert [v for _, v in own] == list(range(1, len(own) + 1))


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [[(1, 1, "butter", 5.0, 2.0, 10.0), (1, 1, "whey", 1.0, 1.0, 1.0)], [(1, 1, "butter", 7.0, 1.5, 10.5), (30, 2, "whey", 3.0, 1.0, 3.0)]]
    batches = [spark.createDataFrame(r, "tick long, site long, product string, volume double, price double, revenue double") for r in rows]
    create(spark, path)
    assert latest(spark, path).isEmpty()
    for batch, number in ((batches[0], 0), (batches[1], 1), (batches[1], 1), (batches[1].where("false"), 2)):
        merge(batch, number, path)
    before = sorted(map(tuple, versions(spark, path).collect()))
    merge(batches[1], 1, path)
    create(spark, path)
    assert sorted(map(tuple, versions(spark, path).collect())) == before and len(before) == 4
    got = {(r.tick, r["product"]): (r.volume, r.version) for r in latest(spark, path).collect()}
    assert got == {(1, "butter"): (7.0, 2), (1, "whey"): (1.0, 1), (30, "whey"): (3.0, 1)}


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB_PROVIDER)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("salts", [1, 3])
def test_changes_may_come_after_their_facts(spark, tmp_path, rocksdb, salts):
    rng = random.Random(2)
    events = [event(i, i / 20, rng.randrange(30), rng.randrange(1, 300), rng.choice(["purchase", "purchase", "signup", "click", "view"])) for i in range(300)]
    events += [event(300 + k, 5.0, 3, 10 * k, kind) for k, kind in enumerate(["signup", "purchase", "signup", "click"])]  # equal times
    arrived = sorted(events, key=lambda e: (e[1], rng.random()) if rng.random() < 0.5 else (e[1] + dt.timedelta(hours=1), 0))
    paths = {p: PARAM_PATHS[p] for p in ("separator.targetCreamFatPercent", "skimSplitPercent")}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(3):  # each run goes on from the checkpoint
        arrive(spark, tmp_path, k, arrived[102 * k:102 * k + 102] if k < 2 else arrived[204:])
        found = params_in_effect_keyed(read_arrivals(spark, str(tmp_path)), ["site"], paths, DEFAULT_CONFIG, salts=salts)
        write_quotes(found, out, state).awaitTermination()
    got = {r.fact_id: tuple(r)[1:] for r in spark.read.schema(found.schema).parquet(out).collect()}
    log = [e for e in events if e[3] in ("purchase", "signup", "click")]
    end = max(e[1] for e in log) - dt.timedelta(hours=2)
    want = {}
    for i, ts, user, kind, value in log:
        if kind != "purchase" or ts > end:
            continue
        def last(wanted, of, default):
            own = [(e[1], e[0], of(int(e[4]))) for e in log if e[3] == wanted and e[2] % 10 == user % 10 and e[1] <= ts]
            return float(max(own)[2]) if own else default
        want[i] = (user % 10, ts, value, last("signup", lambda v: 30 + v % 16, 40.0), last("click", lambda v: v % 21 * 5, 50.0))
    assert got == want and len(got) > 80


def test_a_row_in_effect_costs_no_call_to_the_state_store():
    """Calls to the store grow with blocks, whatever the number of facts and changes."""
    calls = []

    class State:
        def __init__(self):
            self.values = []

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("put", "clear"):
                    self.values = []
                if name in ("put", "appendList"):
                    self.values += given[0]
                return iter(list(self.values))
            return call

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        getMapState = getListState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 5

    def run(n):
        calls.clear()
        state = _InEffect([7.0, 8.0], ["site"], ["a", "b"])
        state.init(Handle())
        rows = [(FACT, 10 * i, i, 1.0, None) for i in range(n)] + [(CHANGE, 10 * i + 5, i, float(i), 0) for i in range(n)]
        list(state.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["kind", "us", "id", "number", "path"])]), Now()))
        found = pd.concat(state.handleExpiredTimer((1,), Now(), None))
        assert found["fact_id"].tolist() == list(range(min(n, 501))) and set(found["b"]) == {8.0}
        assert found["a"].tolist() == [7.0, *map(float, range(min(n, 501) - 1))]
        return len(calls)

    assert run(400) == run(40) and run(4000) <= run(400) + 2
