"""Gold: the category scorecard, the monthly trend and the evidence queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbmark.functions.measures import money_parts, money_sum, money_total, ratio
from ebbmark.functions.names import col
from ebbmark.operators.cleanse import surrogate_key
from ebbmark.operators.merge import merge_left
from ebbmark.operators.signal import join_keys
from ebbmark.session import stage

# Fixed value: how many categories a "worst" list holds.
TOP_K = 3
# Above this many rows a Gold table is numbered by a distributed sort.
ONE_TASK_ROWS = 1_000_000


def _keyed(df: DataFrame, order: list[str], large: bool = False) -> DataFrame:
    """Number the rows of an aggregated table: in one task for a few categories, else by ranges."""
    if large:
        return surrogate_key(df, "pk_gold_id", order, total_order=True)
    place = W.orderBy(*[F.asc_nulls_last(c) for c in order])
    return df.select(F.row_number().over(place).cast("bigint").alias("pk_gold_id"), "*")


def month_grain(signal: DataFrame) -> DataFrame:
    """All sums both Gold tables need, by category and month: one pass over Signal.

    Money is kept as whole-number sums, so adding months up gives exactly what a direct sum would.
    """
    return signal.groupBy("category", "order_month").agg(
        F.count("order_id").alias("orders"),
        F.sum("is_returned").alias("returns"),
        *[part for c in ("order_amount", "revenue_erosion", "net_revenue") for part in money_parts(F.col(c), c)],
        F.sum("days_to_return").alias("days"),
        F.count("days_to_return").alias("days_known"),
    )


def category_performance(signal: DataFrame, large: bool = False) -> DataFrame:
    """Orders, returns, money and rates per category; a NULL category is a group of its own.

    ``large`` says that there are too many categories to number them in one task.
    """
    return _scorecard(
        signal.groupBy("category").agg(
            F.count("order_id").alias("total_orders"),
            F.coalesce(F.sum("is_returned"), F.lit(0)).alias("total_returns"),
            money_sum(F.col("order_amount")).alias("gross_revenue"),
            money_sum(F.col("revenue_erosion")).alias("total_refunds"),
            money_sum(F.col("net_revenue")).alias("net_revenue"),
            F.avg("days_to_return").alias("avg_days_to_return"),
        ),
        large,
    )


def _scorecard(sums: DataFrame, large: bool) -> DataFrame:
    rated = sums.select(
        "*",
        ratio(F.col("total_returns"), F.col("total_orders")).alias("return_rate"),
        ratio(F.col("total_refunds"), F.col("gross_revenue")).alias("revenue_erosion_pct"),
    )
    return _keyed(rated, ["category"], large)


def monthly_trend(signal: DataFrame, large: bool = False) -> DataFrame:
    """Orders, returns, net revenue and return rate per category and month, in that order."""
    return _trend(
        signal.groupBy("category", "order_month").agg(
            F.count("order_id").alias("orders"),
            F.coalesce(F.sum("is_returned"), F.lit(0)).alias("returns"),
            money_sum(F.col("net_revenue")).alias("net_revenue"),
        ),
        large,
    )


def _trend(sums: DataFrame, large: bool) -> DataFrame:
    rated = sums.select("*", ratio(F.col("returns"), F.col("orders")).alias("return_rate"))
    return _keyed(rated, ["category", "order_month"], large).orderBy("pk_gold_id")


def gold(signal: DataFrame | None) -> dict[str, DataFrame]:
    """Both Gold tables from one pass over Signal; its month sums are written once and shared."""
    if signal is None:
        raise ValueError("Gold needs the Signal table")
    months = stage(month_grain(signal), "month-grain")
    large = months.count() > ONE_TASK_ROWS

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    def money(name: str) -> Column:
        return money_total(*(F.sum(f"{name}_{part}") for part in ("units", "parts", "rest")))

    scorecard = months.groupBy("category").agg(
        total("orders").alias("total_orders"),
        total("returns").alias("total_returns"),
        money("order_amount").alias("gross_revenue"),
        money("revenue_erosion").alias("total_refunds"),
        money("net_revenue").alias("net_revenue"),
        ratio(F.sum("days"), F.sum("days_known")).alias("avg_days_to_return"),
    )
    trend = months.select(
        "category",
        "order_month",
        "orders",
        F.coalesce("returns", F.lit(0)).alias("returns"),
        money_total(*(F.col(f"net_revenue_{part}") for part in ("units", "parts", "rest"))).alias("net_revenue"),
    )
    return {"category_return_performance": _scorecard(scorecard, large), "monthly_category_trend": _trend(trend, large)}


def overall_return_rate(signal: DataFrame) -> DataFrame:
    return signal.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("is_returned"), 4).alias("return_rate"))


def category_return_rate(signal: DataFrame) -> DataFrame:
    return signal.groupBy("category").agg(F.avg("is_returned").alias("return_rate"))


# ---------------------------------------------------------------- evidence queries

def _top(scorecard: DataFrame, measure: str, k: int) -> DataFrame:
    worst = scorecard.orderBy(F.desc_nulls_last(measure), F.asc_nulls_last("category")).limit(k)
    place = W.orderBy(F.desc_nulls_last(measure), F.asc_nulls_last("category"))
    return worst.select(F.row_number().over(place).cast("bigint").alias("place"), "category", measure)


def top_return_rate(scorecard: DataFrame, k: int = TOP_K) -> DataFrame:
    return _top(scorecard, "return_rate", k)


def top_erosion(scorecard: DataFrame, k: int = TOP_K) -> DataFrame:
    return _top(scorecard, "revenue_erosion_pct", k)


def worst_both(scorecard: DataFrame, k: int = TOP_K) -> DataFrame:
    """Categories among the worst by return rate and by erosion."""
    return top_return_rate(scorecard, k).select("category").intersect(top_erosion(scorecard, k).select("category"))


def worst_one_only(scorecard: DataFrame, k: int = TOP_K) -> DataFrame:
    """Categories among the worst by one measure but not by the other."""
    by_rate, by_erosion = top_return_rate(scorecard, k).select("category"), top_erosion(scorecard, k).select("category")
    rate_only = by_rate.exceptAll(by_erosion).select("category", F.lit("return_rate").alias("measure"))
    return rate_only.unionByName(by_erosion.exceptAll(by_rate).select("category", F.lit("revenue_erosion").alias("measure")))


def rank_compare(scorecard: DataFrame) -> DataFrame:
    """Each category's rank by return rate and by erosion."""
    def rank(measure: str) -> Column:
        return F.rank().over(W.orderBy(F.desc_nulls_last(measure))).cast("bigint")

    return scorecard.select("category", rank("return_rate").alias("rate_rank"), rank("revenue_erosion_pct").alias("erosion_rank"))


def slow_returns(scorecard: DataFrame) -> DataFrame:
    return scorecard.select("category", "avg_days_to_return").orderBy(F.desc_nulls_last("avg_days_to_return"))


def erosion_ratio(scorecard: DataFrame) -> DataFrame:
    return scorecard.select("category", "total_refunds", "gross_revenue", "revenue_erosion_pct")


def returns_by_reason(signal: DataFrame) -> DataFrame:
    return signal.where("is_returned = 1").groupBy("category", "return_reason").agg(
        F.count(F.lit(1)).alias("returns"), money_sum(F.col("revenue_erosion")).alias("refunds")
    )


def month_over_month(trend: DataFrame) -> DataFrame:
    """Change of the return rate against the previous month of the category."""
    months = W.partitionBy("category").orderBy("order_month")
    return trend.select(
        "category",
        "order_month",
        "return_rate",
        (F.col("return_rate") - F.lag("return_rate").over(months)).alias("rate_change"),
    )


def channel_category(orders: DataFrame, returns: DataFrame, products: DataFrame, channel: str = "channel") -> DataFrame:
    """Return rate by sales channel and category, from Silver (Signal has no channel)."""
    left, right = join_keys(orders.columns, returns.columns, "order_id")
    lines = merge_left(
        orders.select(*[col(c) for c in dict.fromkeys([left, *join_keys(orders.columns, products.columns, "product_id")[:1], channel])]),
        returns.select(col(right).alias("_returned_order"), col("return_id")),
        left,
        "_returned_order",
    )
    left, right = join_keys(orders.columns, products.columns, "product_id")
    lines = merge_left(lines, products.select(col(right).alias("_product"), col("category")), left, "_product")
    counted = lines.groupBy(col(channel).alias("channel"), "category").agg(
        F.count(left).alias("orders"), F.count("return_id").alias("returns")
    )
    return counted.select("*", ratio(F.col("returns"), F.col("orders")).alias("return_rate"))
