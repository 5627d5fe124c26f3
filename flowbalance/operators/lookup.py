"""Lookups of small dimensions. Catalyst picks the join by the size it knows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import POWDER_TYPES
from ..sources.dims import sql_literal

RECIPE_COLUMNS = ("moisture", "fat_recovery", "casein_fat_ratio", "casein_recovery")


def with_recipe(
    flows: DataFrame, recipes: DataFrame, key: str = "cheese_type", prefix: str = ""
) -> DataFrame:
    """Add the recipe columns for ``key``. Rows of an unknown type are in ``unknown_recipe``."""
    named = recipes.select(
        F.col("cheese_type").alias(key),
        *[F.col(c).alias(f"{prefix}_{c}" if prefix else c) for c in RECIPE_COLUMNS])
    return flows.join(named, key)


def unknown_recipe(
    flows: DataFrame, recipes: DataFrame, key: str = "cheese_type"
) -> DataFrame:
    """Rows whose type has no recipe, the missing type included."""
    return flows.join(recipes.select(F.col("cheese_type").alias(key)), key, "left_anti")


def unknown_powder(
    flows: DataFrame, key: str = "powder_type", powders: Sequence[str] = POWDER_TYPES
) -> DataFrame:
    """Rows whose powder is not on the list, the missing powder included."""
    listed = ", ".join(sql_literal(p) for p in powders)
    return flows.where(f"NOT COALESCE({key} IN ({listed}), FALSE)")
