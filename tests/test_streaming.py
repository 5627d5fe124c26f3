from __future__ import annotations

import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from conftest import TINY, by

from flowbalance.constants import DEFAULT_CONFIG, PARAM_PATHS
from flowbalance.operators.accounting import producing
from flowbalance.operators.market import price_direction, quotes
from flowbalance.operators.params import asof_params
from flowbalance.sources import (
    read_fact_stream,
    read_facts,
    read_param_changes,
    read_supply_events,
    read_supply_stream,
    write_quotes,
)
from flowbalance.sources.sinks import shared_folder
from flowbalance.sources.tables import EVENT_SCHEMA
from flowbalance.streaming import params_in_effect_stream, price_direction_stream, price_feed
from flowbalance.streaming.feed import DIRECTION_SCHEMA, ROCKSDB_PROVIDER

START = dt.datetime(2024, 1, 1)
HOUR_ZERO = (START.date() - dt.date(1970, 1, 1)).days * 24


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB_PROVIDER)
    yield
    spark.conf.set(key, before)


def write_files(spark, folder, files):
    """One parquet file per list of events, with increasing modification times."""
    for i, events in enumerate(files):
        out = str(folder / f"events-{i}.parquet")
        spark.createDataFrame(events, EVENT_SCHEMA).coalesce(1).write.parquet(out)
        for root, _, names in os.walk(out):
            for name in names:
                os.utime(os.path.join(root, name), (1_700_000_000 + i * 60,) * 2)
    return str(folder)


def event(i, hours, user, value, kind="view"):
    return (i, START + dt.timedelta(hours=hours), user, kind, float(value))


def run_feed(spark, source, tmp_path, market, **options):
    feed = price_feed(read_supply_stream(spark, source, **options), market)
    write_quotes(feed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.schema(feed.schema).parquet(str(tmp_path / "out"))


def test_feed_equals_batch_on_closed_windows(spark, market, tmp_path):
    feed = run_feed(spark, TINY, tmp_path, market)
    events = read_supply_events(spark, TINY)
    batch = producing(quotes(events.withColumnRenamed("hour", "tick"), market, ["site", "tick"]))
    last = events.selectExpr("MAX(ts) - INTERVAL 2 HOURS AS t").first().t
    closed = [r for r in batch.collect()
              if dt.datetime(1970, 1, 1) + dt.timedelta(hours=r.tick + 1) <= last]
    want = {(r.tick, r.site, r["product"]): (r.volume, r.price) for r in closed}
    got = {(r.tick, r.site, r["product"]): (r.volume, r.price) for r in feed.collect()}
    assert got == want and len(got) > 900


def test_late_events_amend_within_the_watermark_and_drop_beyond(spark, market, tmp_path):
    source = write_files(spark, tmp_path, [
        [event(0, 0.5, 0, 10), event(1, 4.5, 0, 20)],        # watermark 2.5 h
        [event(2, 3.5, 0, 7)],                               # late, but its window is open
        [event(3, 0.2, 0, 100)],                             # its window has been emitted
        [event(4, 9.0, 0, 1)],
    ])
    rows = by(run_feed(spark, source, tmp_path, market, max_files_per_trigger=1), "tick")
    got = {tick - HOUR_ZERO: r.volume for tick, r in rows.items()}
    assert got == {0: 10.0, 3: 7.0, 4: 20.0}


def test_shuffled_input_within_the_watermark_changes_nothing(spark, market, tmp_path):
    rng = random.Random(3)
    events = [event(i, i / 20, rng.randrange(90), rng.randrange(1, 50)) for i in range(200)]
    ordered = write_files(spark, tmp_path / "a", [events[:100], events[100:]])
    swapped = sorted(events, key=lambda e: e[0] + rng.randrange(-15, 15))
    shuffled = write_files(spark, tmp_path / "b", [swapped[:70], swapped[70:140], swapped[140:]])
    one = run_feed(spark, ordered, tmp_path / "a", market)
    three = run_feed(spark, shuffled, tmp_path / "b", market, max_files_per_trigger=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, three.collect()))


def test_restart_continues_from_the_checkpoint(spark, market, tmp_path):
    source = write_files(spark, tmp_path, [[event(0, 0.5, 0, 10), event(1, 1.5, 0, 5)]])
    assert run_feed(spark, source, tmp_path, market).isEmpty()
    spark.createDataFrame([event(2, 1.2, 0, 3), event(3, 8.0, 0, 1)], EVENT_SCHEMA).write.parquet(
        f"{source}/events-9.parquet")
    rows = by(run_feed(spark, source, tmp_path, market), "tick")
    assert {t - HOUR_ZERO: r.volume for t, r in rows.items()} == {0: 10.0, 1: 8.0}


def test_direction_stream_equals_batch_lag(spark, market, tmp_path, rocksdb):
    rng = random.Random(5)
    events = [event(i, i / 15, rng.randrange(90), rng.randrange(1, 500)) for i in range(300)]
    source = write_files(spark, tmp_path, [events[:120], events[120:200], events[200:]])
    feed = price_feed(read_supply_stream(spark, source, max_files_per_trigger=1), market)
    moves = price_direction_stream(feed)
    write_quotes(moves, str(tmp_path / "m"), str(tmp_path / "ms")).awaitTermination()
    got = by(spark.read.schema(DIRECTION_SCHEMA).parquet(str(tmp_path / "m")),
             "tick", "site", "product")
    batch = run_feed(spark, source, tmp_path, market)
    want = by(price_direction(batch, ["site", "product"]), "tick", "site", "product")
    assert got.keys() == want.keys() and len(got) > 100
    for key, row in want.items():
        assert (got[key].prev_price, got[key].direction) == (row.prev_price, row.direction)


def test_params_stream_equals_batch(spark, tmp_path):
    paths = {p: PARAM_PATHS[p] for p in ("separator.targetCreamFatPercent", "skimSplitPercent")}

    def resolve(facts, changes):
        return asof_params(facts, changes, ["site"], paths, DEFAULT_CONFIG)

    query = params_in_effect_stream(
        read_fact_stream(spark, TINY), lambda: read_param_changes(spark, TINY), resolve,
        str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = resolve(read_facts(spark, TINY), read_param_changes(spark, TINY))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shared_folder_follows_the_session():
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: settings.get(k, d)))

    named = session(**{"spark.checkpoint.dir": "hdfs://shared/x/", "spark.master": "yarn"})
    first, second = shared_folder(named, "feed"), shared_folder(named, "feed")
    assert first.startswith("hdfs://shared/x/feed-") and first != second
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(**{"spark.master": "yarn"}), "feed")
