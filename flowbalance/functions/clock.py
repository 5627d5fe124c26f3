"""Time as an integer tick, as SQL expressions.

``TIMESTAMP_NTZ`` has no zone. These expressions use calendar fields only, so that a result does
not depend on the session time zone.
"""

from __future__ import annotations


def day_tick(ts: str) -> str:
    """Days since 1970-01-01."""
    return f"CAST(DATEDIFF(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT)"


def hour_tick(ts: str) -> str:
    """Hours since 1970-01-01."""
    return f"({day_tick(ts)} * 24 + HOUR({ts}))"


def minute_tick(ts: str) -> str:
    """Minutes since 1970-01-01."""
    return f"({hour_tick(ts)} * 60 + MINUTE({ts}))"


def as_instant(ts: str) -> str:
    """A zone-less timestamp read as UTC, as event time needs a TIMESTAMP."""
    return (f"MAKE_TIMESTAMP(YEAR({ts}), MONTH({ts}), DAY({ts}), HOUR({ts}), MINUTE({ts}), "
            f"EXTRACT(SECOND FROM {ts}), 'UTC')")


def window_tick(span: str) -> str:
    """Number of a tumbling window since the epoch; for windows of an hour, the hour tick."""
    start, end = f"UNIX_SECONDS({span}.start)", f"UNIX_SECONDS({span}.end)"
    return f"{start} DIV ({end} - {start})"
