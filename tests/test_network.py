from __future__ import annotations

import pytest
from conftest import by

from flowbalance.operators.network import propagate, route_flows
from flowbalance.sources.sinks import with_checkpoints

SOURCE = "run int, node string, volume double, fat double, snf double, water double"
ROUTE = "from_node string, to_node string, ord int, fraction double, recirculates boolean"


@pytest.fixture(autouse=True)
def checkpoints(spark):
    with_checkpoints(spark)


def through(spark, sources, routes, **options):
    rows = [(run, node, v, v * 0.04, v * 0.09, v * 0.87) for run, node, v in sources]
    table = spark.createDataFrame(routes, ROUTE)
    return propagate(spark.createDataFrame(rows, SOURCE), table, ["run"], **options), table


def volumes(df):
    return {k: r.volume for k, r in by(df, "run", "node").items()}


def fixed_point(sources, routes):
    """By plain iteration."""
    found = {}
    for run in {s[0] for s in sources}:
        wave = {}
        for r, node, v in sources:
            if r == run:
                wave[node] = wave.get(node, 0.0) + v
        total = dict.fromkeys(wave, 0.0)
        for _ in range(5000):
            for node, v in wave.items():
                total[node] = total.get(node, 0.0) + v
            following = {}
            for a, b, _, f, _ in routes:
                if a in wave:
                    following[b] = following.get(b, 0.0) + wave[a] * f
            wave = following
        found |= {(run, node): v for node, v in total.items()}
    return found


TREE = [("a", "b", 0, 0.5, False), ("a", "c", 1, 0.5, None), ("b", "d", 0, 1.0, False), ("c", "d", 0, 0.25, False), ("c", "e", 1, 0.75, False)]
LOOPS = [("a", "b", 0, 1.0, False), ("b", "c", 0, 0.6, False), ("b", "a", 1, 0.3, True), ("b", "x", 2, 0.1, False),
         ("c", "d", 0, 0.5, False), ("c", "b", 1, 0.45, True), ("c", "c", 2, 0.05, True)]


def test_paths_meet_and_levels_differ(spark):
    got, table = through(spark, [(1, "a", 100.0), (1, "c", 8.0), (2, "b", 5.0), (2, "z", 1.0)], TREE)
    assert volumes(got) == {(1, "a"): 100.0, (1, "b"): 50.0, (1, "c"): 58.0, (1, "d"): 64.5, (1, "e"): 43.5, (2, "b"): 5.0, (2, "d"): 5.0, (2, "z"): 1.0}
    edges = {(r.run, r.from_node, r.to_node): r.volume for r in route_flows(got, table, ["run"]).collect()}
    assert edges[1, "c", "e"] == 43.5 and len(edges) == 6
    assert by(got, "run", "node")[1, "d"].fat == pytest.approx(64.5 * 0.04)


def test_recirculation_is_the_fixed_point(spark):
    sources = [(1, "a", 100.0), (1, "d", 1.0), (2, "c", 10.0)]
    got, table = through(spark, sources, LOOPS)
    want = fixed_point(sources, LOOPS)
    assert volumes(got) == pytest.approx(want, abs=1e-4)
    out = sum(v for (run, node), v in volumes(got).items() if run == 1 and node in ("d", "x"))
    assert out == pytest.approx(101.0, abs=1e-4)  # what goes in comes out
    for (run, node), v in volumes(got).items():  # every node passes on what it gets
        if node in "abc":
            left = sum(r.volume for r in route_flows(got, table, ["run"]).collect() if (r.run, r.from_node) == (run, node))
            assert left == pytest.approx(v, abs=1e-4)


def test_a_slow_loop_takes_few_doublings(spark):
    """999 of 1,000 go round again: 20,000 rounds, but 15 squarings."""
    got, _ = through(spark, [(1, "a", 1.0)], [("a", "b", 0, 0.001, False), ("a", "a", 1, 0.999, True)], doublings=18)
    assert volumes(got) == pytest.approx({(1, "a"): 1000.0, (1, "b"): 1.0}, rel=1e-6)


def test_networks_without_an_end_are_refused(spark):
    with pytest.raises(ValueError, match="marked"):
        through(spark, [(1, "a", 1.0)], [("a", "b", 0, 1.0, False), ("b", "a", 0, 1.0, False)])
    with pytest.raises(ValueError, match="lets nothing out"):
        through(spark, [(1, "a", 1.0)], [("a", "b", 0, 1.0, False), ("b", "a", 0, 1.0, True)])


def test_nothing_in_nothing_out(spark):
    got, _ = through(spark, [(1, "a", 1.0)], TREE)
    table = spark.createDataFrame(LOOPS, ROUTE)
    none = spark.createDataFrame([], SOURCE)
    assert propagate(none, table, ["run"]).isEmpty() and not got.isEmpty()
    bad, _ = through(spark, [(1, "a", 1.0)], [("a", "b", 0, 0.5, False)])  # half of the flow has no way
    assert volumes(bad) == {(1, "a"): 1.0}
