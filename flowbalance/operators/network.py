"""Flows through any network of nodes that a routing table describes.

A wave of flows moves along the routes, all nodes of a level at once: it meets the routes by an equi-join
and is pooled by node, so a wave has one row per key and node however many paths lead there. Without
cycles the waves end by themselves. Routes that lead back are marked ``recirculates``; what they carry is
a geometric series. One unit let in at the end of each marked route shows how much of it comes back through each
of them, and the series of these gains is summed by doubling (1 + G, (1 + G)(1 + G^2), ...), so the work
grows with the logarithm of the number of rounds a flow would take.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MASSES
from ..functions.exact import exact_sum
from .fanout import checked_allocations

#: Gains are fractions, so they are summed in smaller units than masses.
GAIN_DIGITS = 12


def _routes(routes: DataFrame) -> DataFrame:
    back = F.col("recirculates") if "recirculates" in routes.columns else F.lit(False)
    return checked_allocations(routes).where("valid").select(
        "from_node", "to_node", "ord", "share", F.coalesce(back, F.lit(False)).alias("recirculates"))


def _sent(
    flows: DataFrame, routes: DataFrame, keys: Sequence[str], masses: Sequence[str], digits: int
) -> DataFrame:
    """What arrives at the next nodes."""
    arriving = flows.join(routes, flows["node"] == routes["from_node"])
    return arriving.groupBy(*keys, F.col("to_node").alias("node")).agg(*[
        exact_sum(f"{m} * share", digits=digits).alias(m) for m in masses])


def _through(
    start: DataFrame, routes: DataFrame, keys: Sequence[str], masses: Sequence[str],
    most: int, digits: int = 6,
) -> DataFrame:
    """What goes through every node, by waves along routes without a cycle."""
    def pooled(flows: DataFrame) -> DataFrame:
        return flows.groupBy(*keys, "node").agg(*[exact_sum(m, digits=digits).alias(m) for m in masses])

    wave = pooled(start).checkpoint()
    waves = []
    while not wave.isEmpty():
        if len(waves) > most:
            raise ValueError("the routes have a cycle of which no route is marked as recirculating")
        waves.append(wave)
        wave = _sent(wave, routes, keys, masses, digits).checkpoint()
    return pooled(reduce(DataFrame.unionByName, waves)) if waves else wave


def _largest(gains: DataFrame) -> float:
    return gains.agg(F.coalesce(F.max(F.abs("gain")), F.lit(0.0))).first()[0]


def _times(one: DataFrame, other: DataFrame) -> DataFrame:
    """The product of two matrices (i, j, gain)."""
    left = one.select("i", F.col("j").alias("_k"), F.col("gain").alias("_one"))
    right = other.select(F.col("i").alias("_k"), "j", "gain")
    return left.join(right, "_k").groupBy("i", "j").agg(exact_sum("_one * gain", digits=GAIN_DIGITS).alias("gain"))


def propagate(
    sources: DataFrame, routes: DataFrame, keys: Sequence[str], masses: Sequence[str] = MASSES,
    residual: float = 1e-10, doublings: int = 40,
) -> DataFrame:
    """What goes through every node: ``keys, node`` and the masses, recirculated flows included.

    ``sources`` has the keys, ``node`` and the masses let in there; ``routes`` has ``from_node, to_node, ord,
    fraction`` and maybe ``recirculates``. Nodes without a valid route keep what they get. The series of
    what recirculates is summed until a power of the gains is below ``residual``; a loop that lets nothing
    out never gets there and raises, as does a cycle without a marked route. Needs a checkpoint folder.
    """
    table = _routes(routes).checkpoint()
    forward, back = table.where("NOT recirculates"), table.where("recirculates")
    most = table.select("from_node").distinct().count() + 1
    through = _through(sources, forward, keys, masses, most)
    if back.isEmpty():
        return through

    ends = back.select(F.struct("from_node", "ord").alias("edge"), "from_node", "to_node", "share")
    units = ends.select(F.col("edge").alias("j"), F.col("to_node").alias("node"), F.lit(1.0).alias("gain"))
    seen = _through(units, forward, ["j"], ["gain"], most, GAIN_DIGITS)
    gains = seen.join(ends, F.col("node") == F.col("from_node")).select(
        F.col("edge").alias("i"), "j", (F.col("gain") * F.col("share")).alias("gain"))
    powers = [gains.checkpoint()]
    # after as many rounds as there are marked routes, only what is in a loop is still on its way
    within = ends.count().bit_length() + 1
    while (left := _largest(powers[-1])) > residual:
        if len(powers) > doublings or (len(powers) > within and left > 1 - 1e-12):
            raise ValueError("a loop lets nothing out, so what recirculates has no end")
        powers.append(_times(powers[-1], powers[-1]).checkpoint())

    carried = through.join(ends, F.col("node") == F.col("from_node")).select(
        *keys, F.col("edge").alias("j"), *[(F.col(m) * F.col("share")).alias(m) for m in masses])
    for gain in powers:
        more = carried.join(gain, "j").groupBy(*keys, F.col("i").alias("j")).agg(*[
            exact_sum(f"{m} * gain").alias(m) for m in masses])
        carried = carried.unionByName(more).groupBy(*keys, "j").agg(*[
            exact_sum(m).alias(m) for m in masses]).checkpoint()
    returned = carried.join(ends, F.col("j") == F.col("edge")).select(
        *keys, F.col("to_node").alias("node"), *masses)
    everything = sources.select(*keys, "node", *masses).unionByName(returned)
    return _through(everything, forward, keys, masses, most)


def route_flows(
    through: DataFrame, routes: DataFrame, keys: Sequence[str], masses: Sequence[str] = MASSES
) -> DataFrame:
    """Movements along every route: ``keys, from_node, to_node`` and the masses."""
    met = through.join(_routes(routes), F.col("node") == F.col("from_node"))
    return met.select(*keys, "from_node", "to_node", *[
        (F.col(m) * F.col("share")).alias(m) for m in masses])
