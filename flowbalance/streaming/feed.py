"""Windowed price feed, price direction and parameters in effect, as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..constants import PRICE_DEAD_BAND
from ..functions.clock import window_tick
from ..functions.exact import exact_sum
from ..operators.market import elastic_price

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

FEED_FIELDS = ("tick", "site", "product", "volume", "price", "revenue")

DIRECTION_SCHEMA = T.StructType([
    T.StructField("tick", T.LongType()),
    T.StructField("site", T.LongType()),
    T.StructField("product", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("prev_price", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("direction", T.StringType()),
])


def price_feed(
    events: DataFrame, market: DataFrame, window: str = "1 hour", watermark: str = "2 hours"
) -> DataFrame:
    """Supply, price and revenue per window, site and product. ``tick`` numbers the windows.

    Late events within the watermark still count; later ones are dropped by the engine. In append
    mode a window is emitted once, when the watermark has passed its end.
    """
    supply = (events.withWatermark("ts", watermark)
              .groupBy(F.window("ts", window).alias("span"), "site", "product")
              .agg(exact_sum("volume").alias("volume")))
    quoted = elastic_price(supply, market)
    return quoted.selectExpr(f"{window_tick('span')} AS tick", *FEED_FIELDS[1:])


class _LastPrice(StatefulProcessor):
    """Keeps the last price of a key; the only Python code that sees rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_price", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
        quotes = pd.concat(list(rows)).sort_values("tick", ignore_index=True)
        known = self._last.get()
        first = known[0] if known is not None else quotes["price"].iloc[0]
        quotes["prev_price"] = quotes["price"].shift(1).fillna(first)
        quotes["delta"] = quotes["price"] - quotes["prev_price"]
        quotes["direction"] = "flat"
        quotes.loc[quotes["delta"] > PRICE_DEAD_BAND, "direction"] = "up"
        quotes.loc[quotes["delta"] < -PRICE_DEAD_BAND, "direction"] = "down"
        self._last.update((float(quotes["price"].iloc[-1]),))
        yield quotes[DIRECTION_SCHEMA.names]

    def close(self) -> None:
        pass


def price_direction_stream(feed: DataFrame) -> DataFrame:
    """Direction of every emitted quote against the last one of its site and product.

    A key's input per micro-batch is its closed windows, one row each. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (feed.select("tick", "site", "product", "price").groupBy("site", "product")
            .transformWithStateInPandas(_LastPrice(), DIRECTION_SCHEMA, "Append", "None"))


def params_in_effect_stream(
    facts: DataFrame,
    read_changes: Callable[[], DataFrame],
    resolve: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Resolve parameters for arriving facts against the newest version of the change table.

    ``read_changes`` is called per micro-batch. A batch writes its own folder and overwrites it
    when it is repeated after a failure, so a fact never appears twice. The batch is read once
    and kept while it is resolved, as resolving looks at it twice; a lost part is read again.
    """
    def resolve_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            resolve(kept, read_changes()).write.mode("overwrite").parquet(
                f"{path}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    return (facts.writeStream.foreachBatch(resolve_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
