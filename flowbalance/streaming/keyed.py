"""Parameters in effect as keyed state: no table is read again, and changes may come after their facts.

Facts and changes are one stream. A fact waits in its key's state until the watermark has passed its
time; by then every change that counts for it has come, whatever the order of arrival. An event-time
timer wakes the key. What is in effect before the watermark stays as one change per path, older ones
go, so that the state holds what is open and not the history. Facts and changes are kept in blocks and
resolved by sorting and searching arrays, so that a row costs no call to the state store of its own. (State expiry by age exists for
processing time only; here the watermark does it.)
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE, FACT = 0, 1


#: Rows of the state. A state value holds many of them, as their bytes: one call to the store a block, not a row.
_WAITING = np.dtype([("us", "i8"), ("id", "i8"), ("volume", "f8")])
_LOG = np.dtype([("path", "i4"), ("us", "i8"), ("id", "i8"), ("value", "f8")])
_BLOCK = 1 << 16


def _packed(kind: np.dtype, *columns: pd.Series) -> np.ndarray:
    rows = np.empty(len(columns[0]), kind)
    for name, column in zip(kind.names, columns, strict=True):
        rows[name] = column.to_numpy(kind[name], na_value=np.nan) if kind[name].kind == "f" else column.to_numpy(kind[name])
    return rows


def _blocks(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k:k + _BLOCK].tobytes(),) for k in range(0, len(rows), _BLOCK)]


def _rows(blocks: Iterator[tuple[bytes]], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(block) for block, in blocks), kind)


class _InEffect(StatefulProcessor):
    def __init__(self, defaults: Sequence[float], keys: Sequence[str], columns: Sequence[str]) -> None:
        self._defaults, self._keys, self._columns = defaults, keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "block binary")
        self._changes = handle.getListState("changes", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
        first = None
        for batch in rows:
            dated = batch["us"].notna()
            facts = batch[(batch["kind"] == FACT) & dated]
            if len(facts):
                self._waiting.appendList(_blocks(_packed(_WAITING, facts["us"], facts["id"], facts["number"])))
                least = int(facts["us"].min())
                first = least if first is None else min(first, least)
            log = batch[(batch["kind"] == CHANGE) & dated]
            if len(log):
                self._changes.appendList(_blocks(_packed(_LOG, log["path"], log["us"], log["id"], log["number"])))
            undated = batch[(batch["kind"] == FACT) & ~dated]
            if len(undated):
                yield self._output(key, None, undated["id"], undated["number"], [np.full(len(undated), d) for d in self._defaults])
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _rows(self._waiting.get(), _WAITING)
        ready, rest = waiting[waiting["us"] <= now], waiting[waiting["us"] > now]
        if len(rest):
            self._wake(max(int(rest["us"].min()), now + 1000))
        if not len(ready):  # an earlier timer of this watermark has served them
            return
        if len(rest):
            self._waiting.put(_blocks(rest))
        else:
            self._waiting.clear()
        log = _rows(self._changes.get(), _LOG)
        names = ["path", "us", "id"]
        log = log[np.lexsort([log[c] for c in reversed(names)])]
        # of a change that came twice the later one counts; the sort keeps the order of arrival
        log = log[np.append(log[names][1:] != log[names][:-1], np.ones(min(len(log), 1), bool))]
        found, kept = [], []
        for path, default in enumerate(self._defaults):
            own = log[log["path"] == path]
            at = np.searchsorted(own["us"], ready["us"], side="right")
            found.append(np.append(default, own["value"])[at])
            passed = int(np.searchsorted(own["us"], now, side="right"))
            kept.append(own[max(passed - 1, 0):])
        self._changes.clear()
        if sum(map(len, kept)):
            self._changes.put(_blocks(np.concatenate(kept)))
        for k in range(0, len(ready), _BLOCK):
            part = slice(k, k + _BLOCK)
            yield self._output(key, ready["us"][part], ready["id"][part], ready["volume"][part], [f[part] for f in found])

    def close(self) -> None:
        pass

    def _wake(self, us: int) -> None:
        self._handle.registerTimer(us // 1000)

    def _output(self, key, us: np.ndarray | None, ids, volumes, found: list[np.ndarray]) -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({
            "fact_id": pd.Series(np.asarray(ids), dtype="int64"), **{k: pd.Series([v] * n) for k, v in zip(self._keys, key, strict=False)},
            "us": pd.Series([None] * n if us is None else us, dtype="Int64"), "volume": pd.Series(np.asarray(volumes), dtype="float64"),
            **{c: pd.Series(f, dtype="float64") for c, f in zip(self._columns, found, strict=True)}})


def params_in_effect_keyed(
    arrivals: DataFrame, keys: Sequence[str], paths: Mapping[str, str], defaults: Mapping[str, float],
    watermark: str = "2 hours", salts: int = 1,
) -> DataFrame:
    """Facts with the value of every path at their time, as soon as the watermark has passed them.

    ``arrivals`` has the keys, ``ts`` (event time), ``kind`` (``FACT`` or ``CHANGE``), ``id``, ``number`` (a fact's volume
    or a change's value) and ``path``. Of changes at one time the higher id counts; a fact without
    a time has the defaults. Rows later than the watermark are dropped by the engine. A key's facts are
    spread over ``salts`` states, each of which gets all its changes. Needs the RocksDB state store.
    """
    columns = list(paths.values())
    number_of = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p, i)])
    rows = arrivals.where((F.col("kind") == FACT) | F.col("path").isin(*paths)).withWatermark("ts", watermark)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    rows = rows.select(*keys, F.explode(F.when(F.col("kind") == FACT, own).otherwise(every)).alias("_salt"), "ts",
                       "kind", "id", "number", number_of[F.col("path")].alias("path"), F.unix_micros("ts").alias("us"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"fact_id long, {fields}, us long, volume double, " + ", ".join(f"`{c}` double" for c in columns)
    processor = _InEffect([float(defaults[c]) for c in columns], list(keys), columns)
    found = rows.groupBy(*keys, "_salt").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return found.withColumn("ts", F.expr("TIMESTAMPADD(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")).select(
        "fact_id", *keys, "ts", "volume", *columns)
