"""The rows of a key that no other row beats: at least as good in every criterion and better in one.

A key whose points fit a task is settled there. Of a larger one, quantiles of each criterion cut the points into a
grid. A cell that another occupied cell exceeds in every
direction holds no such row and goes unread. What is left is thinned cell by cell, in groups of bounded
size; then the points of a cell meet those of the cells that could beat them, block against block. Cells that are
read share a coordinate with all of those, so most of the grid is never paired.

Equal rows are one point until the end, and all of them are kept. A row with a missing criterion (NULL or
NaN) takes no part. The rows are written once, so that what made them is not evaluated again; the work beyond that
grows with the points that survive their own cell. Needs a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.composition import quoted

#: Points of a group that one task holds.
BLOCK = 20_000


def undominated(points: np.ndarray) -> np.ndarray:
    """Positions of the distinct ``points`` that no other beats, larger being better."""
    left = np.lexsort(points.T[::-1])[::-1]
    found = []
    while len(left):
        best = left[0]
        found.append(best)
        left = left[(points[left] > points[best]).any(axis=1)]
    return np.array(found, np.int64)


def beaten(points: np.ndarray, by: np.ndarray, step: int = 256) -> np.ndarray:
    """Which of ``points`` another point of ``by`` beats."""
    out = np.zeros(len(points), bool)
    for lo in range(0, len(by), step):
        judge = by[lo:lo + step, None, :]
        out |= ((judge >= points).all(axis=2) & (judge > points).any(axis=2)).any(axis=0)
    return out


def frontier(
    rows: DataFrame, keys: Sequence[str], largest: Sequence[str] = (), smallest: Sequence[str] = (),
    cuts: int = 5, block: int = BLOCK,
) -> DataFrame:
    """Rows of each key that no other row of it beats in ``largest`` and ``smallest``; columns as they came.

    ``cuts`` quantiles a criterion make the grid, which has at most (cuts + 1) ** criteria cells a key.
    """
    goals = [f"_g{i}" for i in range(len(largest) + len(smallest))]
    own = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [f"{quoted(k)} AS {o}" for k, o in zip(keys, own)] or ["0 AS _k0"]
    signed = [f"CAST({quoted(c)} AS DOUBLE) + 0D" for c in largest]
    signed += [f"-CAST({quoted(c)} AS DOUBLE) + 0D" for c in smallest]
    valued = rows.selectExpr("*", *named, *[f"{x} AS {g}" for x, g in zip(signed, goals)])
    valued = valued.where(" AND ".join(f"{g} IS NOT NULL AND NOT ISNAN({g})" for g in goals)).checkpoint()
    points = valued.select(*own, *goals).distinct()

    steps = ", ".join(f"{(i + 1) / (cuts + 1)!r}D" for i in range(cuts))
    grid = points.groupBy(*own).agg(F.count("*").alias("_points"), *[
        F.expr(f"PERCENTILE_APPROX({g}, ARRAY({steps}))").alias(f"_at{g}") for g in goals])
    place = ", ".join(f"SIZE(FILTER(_at{g}, c -> c < {g}))" for g in goals)
    placed = _matched(points, grid, own).selectExpr(*own, *goals, f"IF(_points > {block}, ARRAY({place}), CAST(ARRAY() AS ARRAY<INT>)) AS _cell").checkpoint()

    ahead = " AND ".join(f"GET(o._cell, {i}) > GET(c._cell, {i})" for i in range(len(goals)))
    cells = placed.groupBy(*own, "_cell").agg(F.count("*").alias("_n"))
    cells = (cells.groupBy(*own).agg(F.collect_list(F.struct("_cell", "_n")).alias("_all"))
             .selectExpr(*own, f"INLINE(FILTER(_all, c -> NOT EXISTS(_all, o -> COALESCE({ahead}, FALSE))))"))
    thin = _matched(placed, cells, [*own, "_cell"]).withColumn("_deal", F.expr(
        f"PMOD(XXHASH64({', '.join(goals)}), CAST(CEIL(_n / {block}D) AS BIGINT))"))

    kinds = ", ".join(f"{f.simpleString().replace(':', ' ', 1)}" for f in placed.schema)

    def thinned(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[undominated(group[goals].to_numpy())][[*own, *goals, "_cell"]]

    near = thin.groupBy(*own, "_cell", "_deal").applyInPandas(thinned, kinds).checkpoint()

    gridded = near.where("SIZE(_cell) > 0")
    held = gridded.groupBy(*own, "_cell").agg(F.count("*").alias("_n"))
    reach = " AND ".join(f"o._cell[{i}] >= _cell[{i}]" for i in range(len(goals)))
    cells_held = held.groupBy(*own).agg(F.collect_list(F.struct("_cell", "_n")).alias("_all"))
    reached = (_matched(held, cells_held, own)
               .selectExpr(*own, "_cell", "_n", f"FILTER(_all, o -> {reach}) AS _from")
               .selectExpr(*own, "_cell", "_from._cell AS _from", f"CAST(CEIL(_n / {block}D) AS BIGINT) AS _parts",
                           f"CAST(CEIL(AGGREGATE(_from, 0L, (t, o) -> t + o._n) / {block}D) AS BIGINT) AS _judges"))
    judging = reached.withColumn("_from", F.explode("_from"))
    dealt = f"XXHASH64({', '.join(goals)})"
    judged = _matched(gridded, reached.drop("_from"), [*own, "_cell"]).selectExpr(
        *own, *goals, "_cell", f"PMOD({dealt}, _parts) AS _a", "EXPLODE(SEQUENCE(0L, _judges - 1)) AS _b", "FALSE AS _judge")
    judges = _matched(gridded.withColumnRenamed("_cell", "_from"), judging, [*own, "_from"]).selectExpr(
        *own, *goals, "_cell", "EXPLODE(SEQUENCE(0L, _parts - 1)) AS _a", f"PMOD({dealt}, _judges) AS _b", "TRUE AS _judge")

    def losing(group: pd.DataFrame) -> pd.DataFrame:
        judge = group["_judge"].to_numpy(bool)
        values = group[goals].to_numpy()
        return group[~judge][beaten(values[~judge], values[judge])][[*own, *goals, "_cell"]]

    lost = judged.unionByName(judges).groupBy(*own, "_cell", "_a", "_b").applyInPandas(losing, kinds)
    won = _matched(near, lost.select(*own, *goals), [*own, *goals], "left_anti").select(*own, *goals)
    return _matched(valued, won, [*own, *goals], "left_semi").select(*[F.col(quoted(c)) for c in rows.columns])


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join whose keys may be NULL; ``right`` adds its other columns."""
    other = right.select(*[F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_r{c}" for c in on])
