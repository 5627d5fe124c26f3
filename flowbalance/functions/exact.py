"""Order-independent sums of DOUBLE columns.

A ledger must add up to the same number on every run, whatever the partitioning and however often
a lost executor's tasks are repeated. ``sum(double)`` does not promise that, and
``sum(decimal(18,6))`` does but measured about thirty times slower, as its buffer is a BigDecimal.
Here each value is rounded once to a unit (1e-6 by default) and added as two BIGINTs, which stay in the
code-generated hash aggregate and combine map-side like any other sum.

Expressions are SQL text: one call to the driver's JVM per query instead of one per operator.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Low 20 bits and the rest are added apart: room for 2**43 rows per group before BIGINT overflows,
# and under ANSI mode an overflow raises.
_LOW_BITS = 20


#: The unit of a sum is 10 ** -DIGITS. A value is rounded to it before it is added, so data whose
#: values are near the unit need more digits.
DIGITS = 6


def most(digits: int = DIGITS) -> float:
    """Values are summed exactly up to this size. Beyond it the cast raises under ANSI mode."""
    return 9e18 / 10 ** digits


def units_of(x: str, digits: int = DIGITS) -> str:
    """``x`` in whole units. NaN and infinity raise under ANSI mode instead of becoming 0."""
    return f"CAST(RINT(({x}) * {float(10 ** digits)!r}D) AS BIGINT)"


def rounded(x: str, digits: int = 6) -> str:
    """``x`` rounded half to even, without leaving DOUBLE."""
    scale = f"{float(10 ** digits)!r}D"
    return f"(RINT(({x}) * {scale}) / {scale})"


def exact_sum(
    *xs: str, where: str | None = None, over: WindowSpec | None = None, digits: int = DIGITS
) -> Column:
    """Sum of all expressions ``xs`` over the group, equal on every run; 0 without any value.

    ``where`` restricts the rows that count; ``over`` makes it a window aggregate; ``digits`` sets
    the unit (and with it ``most``).
    """
    unit = float(10 ** digits)
    units = " + ".join(units_of(x, digits) for x in xs)
    if where is not None:
        units = f"CASE WHEN {where} THEN {units} END"
    high = f"SUM(SHIFTRIGHT({units}, {_LOW_BITS}))"
    low = f"SUM(({units}) & {(1 << _LOW_BITS) - 1}L)"
    if over is None:
        return F.expr(f"COALESCE({high} * {float(1 << _LOW_BITS)}D + {low}, 0D) / {unit!r}D")
    total = F.expr(high).over(over) * float(1 << _LOW_BITS) + F.expr(low).over(over)
    return F.coalesce(total, F.lit(0.0)) / unit


def exact_halves(*xs: str, weight: str, digits: int = DIGITS) -> tuple[Column, Column]:
    """The two BIGINTs of ``exact_sum`` with rows counted ``weight`` times; their sums form a group."""
    units = " + ".join(units_of(x, digits) for x in xs)
    return (F.expr(f"SUM({weight} * SHIFTRIGHT({units}, {_LOW_BITS}))"),
            F.expr(f"SUM({weight} * (({units}) & {(1 << _LOW_BITS) - 1}L))"))


def whole(high: str, low: str, digits: int = DIGITS) -> str:
    """The sum that two halves stand for, as ``exact_sum`` gives it."""
    return f"(COALESCE({high} * {float(1 << _LOW_BITS)}D + {low}, 0D) / {float(10 ** digits)!r}D)"
