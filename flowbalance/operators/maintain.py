"""Sums that are kept up to date by signed changes instead of being computed anew.

A change is a row with weight +1 (it is there now) or -1 (it no longer is); a changed row is both. Sums are
stored as two BIGINTs and a count, which form a group under addition: adding a row and its opposite leaves no
trace, in whatever order and however split. A maintained result equals the one computed anew to the bit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_halves, whole

COUNT = "n_rows"


def signed_changes(
    inserted: DataFrame | None = None, deleted: DataFrame | None = None,
    changed: tuple[DataFrame, DataFrame] | None = None, weight: str = "weight",
) -> DataFrame:
    """One table of signed rows; ``changed`` holds rows as they were and as they are."""
    parts = [(inserted, 1), (deleted, -1), *zip(changed or (), (-1, 1))]
    rows = [df.withColumn(weight, F.lit(sign).cast("long")) for df, sign in parts if df is not None]
    if not rows:
        raise ValueError("no change given")
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def signed_sums(
    rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Sequence[str]],
    weight: str = "weight",
) -> DataFrame:
    """``keys``, the count and two halves per measure; a measure is a sum over all its expressions."""
    halves = [half.alias(f"{name}_{end}") for name, parts in measures.items()
              for end, half in zip(("high", "low"), exact_halves(*parts, weight=weight))]
    return rows.groupBy(*keys).agg(F.sum(weight).alias(COUNT), *halves)


def merge_sums(stored: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sums with a delta added; keys that lost all their rows are gone."""
    names = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return both.where(" OR ".join(f"`{c}` <> 0" for c in names))


def inconsistent(stored: DataFrame) -> DataFrame:
    """Keys whose changes do not fit their rows: more was taken away than had been there."""
    sums = " OR ".join(f"`{c}` <> 0" for c in stored.columns if c.endswith(("_high", "_low")))
    return stored.where(f"{COUNT} < 0 OR ({COUNT} = 0 AND ({sums}))")


def read_sums(stored: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The sums as numbers."""
    return stored.select(*keys, *[F.expr(whole(f"`{m}_high`", f"`{m}_low`")).alias(m) for m in measures])


def version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={number}")


def apply_changes(
    spark: SparkSession, path: str, number: int, delta: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Version ``number`` of the sums at ``path``: version ``number - 1`` with ``delta``; version 0 is the first delta.

    Done again after a failure it writes the same version from the same one before it.
    """
    sums = delta if number == 0 else merge_sums(version(spark, path, number - 1), delta, keys)
    sums.write.mode("overwrite").parquet(f"{path}/version={number}")
    return version(spark, path, number)
