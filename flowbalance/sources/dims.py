"""Constant tables as inline relations.

An inline relation has an exact size in the optimizer, so Catalyst broadcasts it by its own size
check (``spark.sql.autoBroadcastJoinThreshold``) and falls back to a shuffle join when a caller
passes a table that is too large. No broadcast is forced anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..constants import DEFAULT_CONFIG, MARKET, RECIPES


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return repr(value)


def inline_table(
    spark: SparkSession, columns: Sequence[tuple[str, str]], rows: Iterable[Sequence[object]]
) -> DataFrame:
    """A small relation from literal rows; ``columns`` are (name, type) pairs."""
    names = [name for name, _ in columns]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


def recipes(spark: SparkSession) -> DataFrame:
    columns = [("cheese_type", "string"), ("moisture", "double"), ("fat_recovery", "double"),
               ("casein_fat_ratio", "double"), ("casein_recovery", "double")]
    return inline_table(spark, columns, RECIPES)


def market_params(spark: SparkSession) -> DataFrame:
    columns = [("product_ord", "int"), ("product", "string"), ("base_price", "double"),
               ("demand", "double"), ("elasticity", "double")]
    return inline_table(spark, columns, [(i, *row) for i, row in enumerate(MARKET)])


def defaults(spark: SparkSession) -> DataFrame:
    columns = [(k, "string" if isinstance(v, str) else "double") for k, v in DEFAULT_CONFIG.items()]
    return inline_table(spark, columns, [list(DEFAULT_CONFIG.values())])


def allocations(spark: SparkSession, rows: Iterable[tuple[str, str, int, float]]) -> DataFrame:
    """Routing table: where each node sends its flow and which fraction of it, in ``ord`` order."""
    columns = [("from_node", "string"), ("to_node", "string"), ("ord", "int"),
               ("fraction", "double")]
    return inline_table(spark, columns, rows)
