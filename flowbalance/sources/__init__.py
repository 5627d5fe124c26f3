"""Readers, dimension tables and sinks."""

from .dims import allocations, defaults, market_params, recipes
from .sinks import write_quotes
from .tables import (
    late_slices,
    read_arrivals,
    read_fact_stream,
    read_facts,
    read_lots,
    read_orders,
    read_param_changes,
    read_supply_events,
    read_supply_stream,
    spread,
)

__all__ = [
    "allocations",
    "defaults",
    "late_slices",
    "market_params",
    "read_arrivals",
    "read_fact_stream",
    "read_facts",
    "read_lots",
    "read_orders",
    "read_param_changes",
    "read_supply_events",
    "read_supply_stream",
    "recipes",
    "spread",
    "write_quotes",
]
