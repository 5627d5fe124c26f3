"""Supply, prices, revenue, rankings and price movements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.composition import number
from ..functions.exact import exact_sum
from ..functions.pricing import constant_elasticity_price, direction
from .accounting import densify, producing
from .pairing import paired

MARKET_FIELDS = ("base_price", "demand", "elasticity")
#: Products that sums are written out for as columns; a larger market is joined as a table.
MOST_COLUMNS = 64


def market_products(market: DataFrame, most: int = MOST_COLUMNS) -> list[str] | None:
    """The market's products in its own order, or None if there are more than ``most``.

    At most ``most`` + 1 names reach the driver; for an inline market that takes no job.
    """
    order = "product_ord" if "product_ord" in market.columns else "product"
    first = market.where("product IS NOT NULL").select("product", F.col(order).alias("_ord"))
    names = [r["product"] for r in first.orderBy("_ord", "product").limit(most + 1).collect()]
    return names if len(names) <= most else None


def market_supply(
    supply: DataFrame, market: DataFrame, keys: Sequence[str],
    products: Sequence[str] | None = None, most: int = MOST_COLUMNS,
) -> DataFrame:
    """Supply per key and product of the market, 0 where there is none: the market drives.

    Products come from the market unless they are given. Up to ``most`` of them are conditional sums,
    which take one shuffle; beyond that the keys are paired with the market's rows, and the
    pairs enter the sum as zeros. Products that the market does not know are in ``unmarketed``.
    """
    listed = market_products(market, most) if products is None else products
    if listed is not None:
        return densify(supply, keys, listed)
    sums = supply.groupBy(*keys, "product").agg(exact_sum("volume").alias("volume"))
    order = "product_ord" if "product_ord" in market.columns else "product"
    wanted = market.where("product IS NOT NULL").select("product", F.col(order).alias("product_ord"))
    zeros = paired(sums.select(*keys).distinct(), wanted, keys).withColumn("volume", F.lit(0.0))
    known = sums.join(wanted, "product").select(*zeros.columns)
    return zeros.unionByName(known).groupBy(*keys, "product_ord", "product").agg(
        exact_sum("volume").alias("volume"))


def with_market(supply: DataFrame, market: DataFrame) -> DataFrame:
    """Add the market parameters of each product to supply that ``market_supply`` made dense."""
    return supply.join(market.select("product", *MARKET_FIELDS), "product")


def unmarketed(supply: DataFrame, market: DataFrame) -> DataFrame:
    """Supply of products that the market does not know, a missing product included."""
    return supply.join(market.select("product"), "product", "left_anti")


def priced(rows: DataFrame) -> DataFrame:
    """``price`` and ``revenue`` of rows that carry their market parameters."""
    return rows.selectExpr(
        "*", f"{constant_elasticity_price()} AS price", "volume * price AS revenue")


def elastic_price(supply: DataFrame, market: DataFrame) -> DataFrame:
    return priced(with_market(supply, market)).drop(*MARKET_FIELDS)


def quotes(
    supply: DataFrame, market: DataFrame, keys: Sequence[str],
    products: Sequence[str] | None = None,
) -> DataFrame:
    """Supply events rolled up to one priced row per key and product of the market."""
    return elastic_price(market_supply(supply, market, keys, products), market)


def price_sensitivity(
    supply: DataFrame, market: DataFrame, elasticities: Sequence[float]
) -> DataFrame:
    """Price and revenue under each elasticity of a short list."""
    options = ", ".join(number(e) for e in elasticities)
    rows = with_market(supply, market).drop("elasticity").selectExpr(
        "*", f"EXPLODE(ARRAY({options})) AS elasticity")
    return priced(rows).drop("base_price", "demand")


def revenue(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quotes.groupBy(*keys).agg(exact_sum("volume * price").alias("revenue"))


def revenue_breakdown(quotes: DataFrame, group: str = "site") -> DataFrame:
    """Revenue per group and product, per group, and in total, told apart by ``level`` (0, 1, 3).

    The grouping sets triple their input, so they run on the rolled-up rows.
    """
    fine = revenue(producing(quotes), [group, "product"])
    return fine.rollup(group, "product").agg(
        F.grouping_id().cast("int").alias("level"), exact_sum("revenue").alias("revenue"))


def rank_revenue(quotes: DataFrame, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """Rank producing products by revenue within a key, product order breaking ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc("revenue"), F.asc("product_ord"))
    ranked = producing(quotes).withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def sort_revenue(
    quotes: DataFrame, limit: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Producing rows in global order of revenue; product order, then ``keys`` break ties.

    With a limit each task keeps its best rows only.
    """
    ordered = producing(quotes).orderBy(F.desc("revenue"), F.asc("product_ord"), *keys)
    return ordered if limit is None else ordered.limit(limit)


def bar_ratio(supply: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Volume in percent of the largest of the key, or of 1 if all are smaller."""
    largest = F.max("volume").over(Window.partitionBy(*keys))
    return (producing(supply).withColumn("_largest", largest)
            .selectExpr("*", "volume / GREATEST(_largest, 1D) * 100D AS bar_pct")
            .drop("_largest"))


def _with_history(
    quotes: DataFrame, keys: Sequence[str], order: str, segment: Column, depth: int
) -> DataFrame:
    """Rows cut into ``_segment``, each opened by the ``depth`` quotes before it (``_carried``).

    The last quotes before a segment are among the last quotes of the segments before it, so they
    follow from a thin table of segment tails.
    """
    cut = quotes.withColumn("_segment", segment)
    backwards = Window.partitionBy(*keys, "_segment").orderBy(F.desc(order))
    tails = (cut.select(*keys, "_segment", order, "price")
             .withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= depth))
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - depth, Window.currentRow)
    closing = tails.withColumn(
        "_past", F.collect_list(F.struct(order, "price")).over(so_far)).filter("_back = 1")
    following = F.lead("_segment").over(Window.partitionBy(*keys).orderBy("_segment"))
    opening = (closing.withColumn("_segment", following).filter("_segment IS NOT NULL")
               .select(*keys, "_segment", F.inline("_past"), F.lit(True).alias("_carried")))
    return cut.withColumn("_carried", F.lit(False)).unionByName(opening, allowMissingColumns=True)


def _over_history(
    quotes: DataFrame, keys: Sequence[str], order: str, segment: Column | None, depth: int,
    added: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add window columns that look back over at most ``depth`` quotes of a key.

    A key has one quote per tick, so its window grows with the time covered and not with the
    events. ``segment``, a coarse bucket of ``order``, cuts that window too.
    """
    if segment is None:
        return quotes.withColumns(added(Window.partitionBy(*keys).orderBy(order)))
    rows = _with_history(quotes, keys, order, segment, depth)
    window = Window.partitionBy(*keys, "_segment").orderBy(order)
    return rows.withColumns(added(window)).filter("NOT _carried").select(
        *quotes.columns, *added(window))


def price_direction(
    quotes: DataFrame, keys: Sequence[str], order: str = "tick", segment: Column | None = None
) -> DataFrame:
    """Change against the previous quote of the key and its direction outside the dead band."""
    def previous(window: WindowSpec) -> dict[str, Column]:
        return {"prev_price": F.coalesce(F.lag("price").over(window), F.col("price"))}

    rows = _over_history(quotes, keys, order, segment, 1, previous)
    return rows.selectExpr("*", "price - prev_price AS delta", f"{direction()} AS direction")


def price_trend(
    quotes: DataFrame, keys: Sequence[str], n: int, order: str = "tick",
    segment: Column | None = None,
) -> DataFrame:
    """Mean, least and greatest price of the last ``n`` quotes of a key."""
    def recent(window: WindowSpec) -> dict[str, Column]:
        last_n = window.rowsBetween(1 - n, Window.currentRow)
        return {
            "mean_price": exact_sum("price", over=last_n) / F.count("price").over(last_n),
            "min_price": F.min("price").over(last_n),
            "max_price": F.max("price").over(last_n),
        }

    return _over_history(quotes, keys, order, segment, max(n - 1, 1), recent)
