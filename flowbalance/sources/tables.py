"""Readers with explicit schemas. Columns that a query does not use never reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CHEESE_TYPES, POWDER_TYPES, PRODUCTS
from ..functions.clock import as_instant, day_tick, hour_tick
from ..functions.composition import one_of

LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()),
    T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

LOT_KEYS = ["order_key", "line_number", "part_key", "site"]


def _events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{path}/events.parquet")


def read_lots(spark: SparkSession, path: str) -> DataFrame:
    """Milk lots with their plant settings, one row per line item.

    Key: ``LOT_KEYS``. ``cheese_type``, ``powder_type`` and ``butter_fat_pct`` serve the single
    operators; the ``_a`` / ``_b`` columns configure the two plants of the whole ledger.
    """
    li = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{path}/lineitem.parquet")
    return li.selectExpr(
        "l_orderkey AS order_key",
        "l_linenumber AS line_number",
        "l_partkey AS part_key",
        "l_suppkey AS site",
        "l_shipdate AS ts",
        "l_quantity * 100D AS volume",
        "3D + l_discount * 20D AS fat_pct",
        "7.5D + l_tax * 25D AS snf_pct",
        f"{one_of(CHEESE_TYPES, 'l_partkey % 4')} AS cheese_type",
        f"{one_of(POWDER_TYPES, 'l_suppkey % 3')} AS powder_type",
        "30D + l_partkey % 16 AS cream_fat_pct",
        "78D + l_suppkey % 7 AS butter_fat_pct",
        "l_orderkey % 21 * 5D AS skim_split_pct",
        "l_partkey % 21 * 5D AS cream_split_pct",
        f"{one_of(CHEESE_TYPES, 'l_partkey % 4')} AS cheese_a",
        f"{one_of(CHEESE_TYPES, 'l_orderkey % 4')} AS cheese_b",
        "78D + l_suppkey % 7 AS butter_a_fat_pct",
        "78D + l_partkey % 7 AS butter_b_fat_pct",
        f"{one_of(POWDER_TYPES, 'l_suppkey % 3')} AS powder_a",
        f"{one_of(POWDER_TYPES, 'l_linenumber % 3')} AS powder_b",
    )


def spread(lots: DataFrame, tasks: int) -> DataFrame:
    """Lots dealt over ``tasks`` tasks, for work that costs far more per row than this shuffle.

    A scan has as many tasks as its files have splits; where that is enough, leave this out.
    """
    return lots.repartition(tasks, *LOT_KEYS)


def read_orders(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Order totals (inflow) and line amounts (outflow) for a two-sided reconciliation."""
    orders = spark.read.parquet(f"{path}/orders.parquet").selectExpr(
        "o_orderkey AS order_key", "o_totalprice AS amount")
    lines = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{path}/lineitem.parquet").selectExpr(
        "l_orderkey AS order_key", "l_extendedprice AS amount")
    return orders, lines


def _as_supply(events: DataFrame, *more: str) -> DataFrame:
    return events.selectExpr(
        "event_id",
        "ts",
        "user_id % 10 AS site",
        f"{one_of(PRODUCTS, 'user_id % 9')} AS product",
        "value AS volume",
        *more,
    )


def read_supply_events(spark: SparkSession, path: str) -> DataFrame:
    """Supply events in batch, with the day and the hour as integer ticks."""
    return _as_supply(_events(spark, path),
                      f"{day_tick('ts')} AS day", f"{hour_tick('ts')} AS hour")


def _event_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None
) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{path}/events*.parquet")


def read_supply_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Supply events as a file stream, with ``ts`` as an event-time TIMESTAMP."""
    return _as_supply(_event_stream(spark, path, max_files_per_trigger)).withColumn(
        "ts", F.expr(as_instant("ts")))


def read_param_changes(spark: SparkSession, path: str) -> DataFrame:
    """Sparse change log: one parameter path per row, numeric values."""
    return _events(spark, path).where("event_type IN ('signup', 'click')").selectExpr(
        "event_id AS change_id",
        "user_id % 10 AS site",
        "ts",
        "IF(event_type = 'signup', 'separator.targetCreamFatPercent', 'skimSplitPercent') AS path",
        "CAST(IF(event_type = 'signup', 30 + FLOOR(value) % 16, FLOOR(value) % 21 * 5) AS DOUBLE)"
        " AS value",
    )


def _as_facts(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").selectExpr(
        "event_id AS fact_id", "user_id % 10 AS site", "ts", "value AS volume")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts that need the parameters in effect at their time."""
    return _as_facts(_events(spark, path))


def read_fact_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same facts as they arrive."""
    return _as_facts(_event_stream(spark, path, max_files_per_trigger))


def read_arrivals(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Facts and parameter changes as one stream: kind 1 and 0, each with its number."""
    log = _event_stream(spark, path, max_files_per_trigger).where(
        "event_type IN ('purchase', 'signup', 'click')")
    return log.selectExpr(
        "user_id % 10 AS site", f"{as_instant('ts')} AS ts", "IF(event_type = 'purchase', 1, 0) AS kind",
        "event_id AS id",
        "CAST(CASE event_type WHEN 'purchase' THEN value WHEN 'signup' THEN 30 + FLOOR(value) % 16 "
        "ELSE FLOOR(value) % 21 * 5 END AS DOUBLE) AS number",
        "CASE event_type WHEN 'signup' THEN 'separator.targetCreamFatPercent' "
        "WHEN 'click' THEN 'skimSplitPercent' END AS path")


def late_slices(spark: SparkSession, path: str, slices: int, late: str = "INTERVAL 1 HOUR") -> list[DataFrame]:
    """The events as they might arrive: each up to ``late`` after its time, cut into equal times of arrival.

    The delay follows from the event's id, so every slice can be made again.
    """
    events = _events(spark, path)
    arrival = f"ts + {late} * (PMOD(XXHASH64(event_id), 1000) / 1000D)"
    first, last = events.selectExpr("MIN(ts)", f"MAX(ts) + {late}").first()
    if first is None:
        return [events]
    cuts = [first + (last - first) * k / slices for k in range(1, slices)]
    number = " + ".join(f"IF({arrival} >= TIMESTAMP_NTZ'{c}', 1, 0)" for c in cuts) or "0"
    return [events.where(f"COALESCE({number}, 0) = {k}") for k in range(slices)]
