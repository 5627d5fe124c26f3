"""Every row of one table with every row of a small other one, as an equi-join that spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one share of a pairing makes, about.
ROWS_PER_SHARE = 2_000_000


def shares_of(rows: int, others: int, per_share: int = ROWS_PER_SHARE) -> int:
    """How many shares keep each below ``per_share`` result rows; never more than there are rows."""
    return max(1, min(rows, -(-rows * others // per_share)))


def paired(
    rows: DataFrame, others: DataFrame, keys: Sequence[str], shares: int | None = None
) -> DataFrame:
    """``rows`` are dealt by ``keys`` to ``shares`` shares and each share meets one copy of ``others``.

    Without ``shares`` both sides are counted, so that the number of shares, and with it of tasks,
    grows with the result. Neither side is broadcast unless Catalyst knows it to be small.
    """
    if shares is None:
        shares = shares_of(rows.count(), others.count())
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*keys), F.lit(shares)))
    copied = others.withColumn("_share", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return dealt.join(copied, "_share").drop("_share")
