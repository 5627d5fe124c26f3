"""SQL expressions of the market."""

from __future__ import annotations

from ..constants import PRICE_DEAD_BAND


def constant_elasticity_price() -> str:
    """Base price scaled by (demand / supply) ^ elasticity; the base price without supply."""
    return ("CASE WHEN volume <= 0 THEN base_price "
            "ELSE base_price * POW(demand / volume, elasticity) END")


def direction(delta: str = "delta", dead_band: float = PRICE_DEAD_BAND) -> str:
    return (f"CASE WHEN {delta} > {dead_band}D THEN 'up' "
            f"WHEN {delta} < -{dead_band}D THEN 'down' ELSE 'flat' END")
