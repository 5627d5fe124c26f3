"""Metrics that ride along with a query, compared with limits without a second pass over the data.

``observe`` adds aggregates to the tasks that compute the rows anyway. On the last step before a write or an action they are
exact: Spark counts a result task once, however often a lost executor made it repeat. Below a shuffle a repeated
stage would count again, so watch what is written, not what it is made of.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Limit:
    """An aggregate expression and the range it has to stay in; None is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None


REPORT = "metric string, value double, low double, high double, ok boolean"


def invariant_limits(value: str, low: float = 0.0, high: float | None = None) -> dict[str, Limit]:
    """The invariants of results: rows there are, none of them NaN, none missing, all between ``low`` and ``high``."""
    number = f"CASE WHEN NOT ISNAN({value}) THEN {value} END"
    return {"n_rows": Limit("COUNT(1)", 1.0), "n_nan": Limit(f"COUNT_IF(ISNAN({value}))", high=0.0),
            "n_missing": Limit(f"COUNT_IF({value} IS NULL)", high=0.0),
            "least": Limit(f"MIN({number})", low, high), "most": Limit(f"MAX({number})", low, high)}


def _metrics(limits: Mapping[str, Limit]) -> list[Column]:
    return [F.expr(f"CAST({x.metric} AS DOUBLE)").alias(name) for name, x in limits.items()]


def judged(values: Mapping[str, float | None], limits: Mapping[str, Limit]) -> list[tuple]:
    """(metric, value, low, high, ok) per limit. A metric without a value (no rows) breaks no bound; NaN breaks any."""
    def ok(v: float | None, x: Limit) -> bool:
        return v is None or ((x.low is None or v >= x.low) and (x.high is None or v <= x.high))

    return [(name, values.get(name), x.low, x.high, ok(values.get(name), x)) for name, x in limits.items()]


class Watch:
    """What a watched query has to report once it has run."""

    def __init__(self, observation: Observation, limits: Mapping[str, Limit]) -> None:
        self._observation, self._limits = observation, limits

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per limit. Waits for the first action on the watched rows."""
        return spark.createDataFrame(judged(self._observation.get, self._limits), REPORT)


def watched(results: DataFrame, limits: Mapping[str, Limit]) -> tuple[DataFrame, Watch]:
    """The same rows, and the watch that an action on them fills."""
    observation = Observation()
    return results.observe(observation, *_metrics(limits)), Watch(observation, limits)


def watched_stream(feed: DataFrame, limits: Mapping[str, Limit], name: str = "limits") -> DataFrame:
    """A stream whose micro-batches carry the metrics in their progress."""
    return feed.observe(name, *_metrics(limits))


def batch_reports(query: StreamingQuery, limits: Mapping[str, Limit], name: str = "limits") -> list[tuple]:
    """(batch id, metric, value, low, high, ok) of the micro-batches in the query's recent progress."""
    found = []
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        if row is not None:
            found += [(progress.batchId, *x) for x in judged(row.asDict(), limits)]
    return found
