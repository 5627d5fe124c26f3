"""Parameters as tables: overrides and the value in effect at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONFIG_GROUPS
from ..functions.clock import minute_tick
from .market import MARKET_FIELDS


def apply_overrides(
    configs: DataFrame, groups: Mapping[str, Sequence[str]] = CONFIG_GROUPS
) -> DataFrame:
    """Replace whole groups of settings.

    A row has its default settings as plain columns and, per group, a nullable struct of the
    group's settings named after the group. A group that is set replaces the defaults as a whole.
    """
    present = {g: fields for g, fields in groups.items() if g in configs.columns}
    merged = {
        field: F.when(F.col(group).isNotNull(), F.col(f"{group}.{field}"))
        .otherwise(F.col(field))
        for group, fields in present.items() for field in fields
    }
    return configs.withColumns(merged).drop(*present)


def override_market(
    supply_with_market: DataFrame, overrides: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Replace market fields per key where an override sets them; other fields stay.

    The keys match null-safe. That also keeps Catalyst from adding a not-null filter to one side,
    so overrides derived from the same rollup reuse its shuffle instead of reading it again.
    """
    fields = [f for f in MARKET_FIELDS if f in overrides.columns]
    plain, changed = supply_with_market.alias("s"), overrides.alias("o")
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return plain.join(changed, same, "left").select(*[
        F.coalesce(F.col(f"o.{c}"), F.col(f"s.{c}")).alias(c) if c in fields else F.col(f"s.{c}")
        for c in supply_with_market.columns])


def untimed(changes: DataFrame, ts: str = "ts") -> DataFrame:
    """Changes without a time, which can't be in effect at any; ``asof_params`` leaves them out."""
    return changes.where(F.col(ts).isNull())


def asof_params(
    facts: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    paths: Mapping[str, str],
    defaults: Mapping[str, float],
    ts: str = "ts",
    fact_id: str = "fact_id",
    change_id: str = "change_id",
    bucket: Callable[[str], str] = minute_tick,
    era: int = 1440,
    salts: int = 1,
) -> DataFrame:
    """Add to each fact the latest value of every path at its time, or the default.

    ``changes`` is a sparse log (``path``, ``value``); a change at the time of a fact counts, and
    of changes at the same time the one with the higher id. A fact without a time gets the
    defaults; a change without a time is in ``untimed``.

    A key may hold any share of the facts and changes, so no window over facts or changes spans a
    key. Time is cut into buckets (``bucket``, an expression over ``ts``), narrow enough that one
    key's rows of a bucket fit a task, and buckets into eras of ``era`` buckets. What is in effect
    when a bucket opens follows from the closing values of the earlier buckets of its era, and of
    the earlier eras: thin tables with a row per key and touched bucket, and per key and era. It
    enters the bucket as one more change. Where facts crowd in one bucket and changes are few,
    ``salts`` spreads the facts of a bucket over that many groups and copies its changes to each.
    """
    columns = list(paths.values())
    at = F.expr(bucket(ts))
    log = changes.filter(F.col("path").isin(*paths) & F.col(ts).isNotNull()).select(
        *keys, ts, F.col(change_id).alias("_order"), at.alias("_bucket"),
        *[F.when(F.col("path") == p, F.col("value")).alias(c) for p, c in paths.items()])
    # Facts without a time are dealt to buckets before all others, where nothing is in effect.
    undated = F.lit(-(1 << 40)) - F.pmod(F.xxhash64(fact_id), F.lit(4096))
    stamped = facts.withColumn("_bucket", F.coalesce(at, undated))

    moment = F.struct(ts, "_order")
    closing = log.groupBy(*keys, "_bucket").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), moment)).alias(c) for c in columns])
    touched = stamped.select(*keys, "_bucket").distinct()
    buckets = (touched.unionByName(closing, allowMissingColumns=True)
               .groupBy(*keys, "_bucket").agg(*[F.max(c).alias(c) for c in columns])
               .withColumn("_era", F.floor(F.col("_bucket") / era)))
    states = log.unionByName(_opening(buckets, keys, columns), allowMissingColumns=True)

    fallback = {c: F.coalesce(F.col(c), F.lit(defaults[c])) for c in columns}
    group = [*keys, "_bucket"]
    known = stamped.withColumn("_is_fact", F.lit(True))
    states = states.withColumn("_is_fact", F.lit(False))
    if salts > 1:
        group.append("_salt")
        known = known.withColumn("_salt", F.pmod(F.xxhash64(fact_id), F.lit(salts)).cast("int"))
        states = states.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = known.unionByName(states, allowMissingColumns=True)
    so_far = (Window.partitionBy(*group)
              .orderBy(F.asc_nulls_first(ts), "_is_fact", F.asc_nulls_first("_order"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
            .filter("_is_fact").withColumns(fallback).select(*facts.columns, *columns))


def _opening(buckets: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What is in effect when each bucket opens: the last value of its era, else of earlier eras.

    An era's opening values stand in its first place, before the era's own buckets.
    """
    earlier = Window.unboundedPreceding, -1
    in_era = Window.partitionBy(*keys, "_era").orderBy("_bucket")
    whole = in_era.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per key and era: what its last bucket leaves
    left = (buckets.withColumns({c: F.last(c, ignorenulls=True).over(whole) for c in columns})
            .withColumn("_is_last", F.lead("_bucket").over(in_era).isNull())
            .filter("_is_last").select(*keys, "_era", *columns))
    over_eras = Window.partitionBy(*keys).orderBy("_era").rowsBetween(*earlier)
    eras = left.select(*keys, "_era", *[
        F.last(c, ignorenulls=True).over(over_eras).alias(c) for c in columns])
    both = buckets.unionByName(eras, allowMissingColumns=True)
    before = (Window.partitionBy(*keys, "_era").orderBy(F.asc_nulls_first("_bucket"))
              .rowsBetween(*earlier))
    return (both.select(*keys, "_bucket", *[
                F.last(c, ignorenulls=True).over(before).alias(c) for c in columns])
            .filter(F.col("_bucket").isNotNull()
                    & F.coalesce(*[F.col(c) for c in columns]).isNotNull()))
