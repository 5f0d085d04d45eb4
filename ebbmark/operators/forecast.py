"""Linear trend per category, its projection and what revenue it puts at risk."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbmark.functions.dates import month_after
from ebbmark.functions.measures import clip_rate, direction

# Months projected, months of history needed, length of the at-risk list.
HORIZON_MONTHS = int(os.environ.get("FORECAST_HORIZON_MONTHS", "3"))
MIN_HISTORY_MONTHS = 3
AT_RISK_TOP = 3


def positions(trend: DataFrame) -> DataFrame:
    """The months of each category numbered from 0; a month without rows leaves no gap."""
    months = W.partitionBy("category").orderBy("order_month")
    known = trend.where(F.col("category").isNotNull() & F.col("order_month").isNotNull())
    return known.select("*", (F.row_number().over(months) - 1).alias("t"))


def series(trend: DataFrame) -> DataFrame:
    """Month, return-rate and net-revenue arrays per category, in month order."""
    return positions(trend).groupBy("category").agg(*_histories())


def _histories() -> list[Column]:
    def history(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("t", name)))
        return F.transform(ordered, lambda point: point[name])

    return [
        history("order_month").alias("history_months"),
        history("return_rate").alias("history_return_rate"),
        history("net_revenue").alias("history_net_revenue"),
    ]


def _fits(trend: DataFrame, min_history: int, *extra: Column) -> DataFrame:
    """Least-squares line and last month per category with enough history."""
    fitted = positions(trend).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("return_rate", "t").alias("rate_slope"),
        F.regr_intercept("return_rate", "t").alias("rate_start"),
        F.regr_slope("net_revenue", "t").alias("revenue_slope"),
        F.regr_intercept("net_revenue", "t").alias("revenue_start"),
        F.max("order_month").alias("last_month"),
        F.max_by("return_rate", "order_month").alias("last_rate"),
        F.max_by("net_revenue", "order_month").alias("last_revenue"),
        *extra,
    )
    return fitted.where(F.col("n") >= min_history)


def _rate_at(step: Column) -> Column:
    return clip_rate(F.col("rate_slope") * (F.col("n") - 1 + step) + F.col("rate_start"))


def _revenue_at(step: Column) -> Column:
    return F.col("revenue_slope") * (F.col("n") - 1 + step) + F.col("revenue_start")


def _at_risk(steps: Column) -> Column:
    shortfalls = F.transform(steps, lambda i: F.greatest(F.col("last_revenue") - _revenue_at(i), F.lit(0.0)))
    return F.aggregate(shortfalls, F.lit(0.0), lambda total, x: total + x)


def _steps(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon)) if horizon > 0 else F.array().cast("array<int>")


def forecast(trend: DataFrame, horizon: int = HORIZON_MONTHS, min_history: int = MIN_HISTORY_MONTHS) -> DataFrame:
    """One row per category: history, projection, slopes, direction and revenue at risk."""
    steps = _steps(horizon)
    fits = _fits(trend, min_history, *_histories())
    return fits.select(
        "category",
        "history_months",
        "history_return_rate",
        "history_net_revenue",
        F.transform(steps, lambda i: month_after(F.col("last_month"), i)).alias("future_months"),
        F.transform(steps, _rate_at).alias("projected_return_rate"),
        F.transform(steps, _revenue_at).alias("projected_net_revenue"),
        F.col("rate_slope").alias("return_rate_slope_per_month"),
        F.col("revenue_slope").alias("net_revenue_slope_per_month"),
        direction(F.col("rate_slope")).alias("trend_direction"),
        _at_risk(steps).alias("projected_revenue_at_risk"),
    )


def forecast_long(trend: DataFrame, horizon: int = HORIZON_MONTHS, min_history: int = MIN_HISTORY_MONTHS) -> DataFrame:
    """One row per category and projected month."""
    stepped = _fits(trend, min_history).select("*", F.explode(_steps(horizon)).alias("step"))
    return stepped.select(
        "category",
        F.col("step").cast("bigint").alias("step"),
        month_after(F.col("last_month"), F.col("step")).alias("order_month"),
        _rate_at(F.col("step")).alias("return_rate"),
        _revenue_at(F.col("step")).alias("net_revenue"),
    )


def to_long(forecasts: DataFrame) -> DataFrame:
    """The arrays of :func:`forecast` as rows, labelled ``Actual`` and ``Forecast``."""
    def rows(months: str, rates: str, revenues: str, label: str) -> DataFrame:
        points = F.arrays_zip(F.col(months).alias("order_month"), F.col(rates).alias("return_rate"), F.col(revenues).alias("net_revenue"))
        return forecasts.select("category", F.lit(label).alias("series"), F.inline(points))

    return rows("history_months", "history_return_rate", "history_net_revenue", "Actual").unionByName(
        rows("future_months", "projected_return_rate", "projected_net_revenue", "Forecast")
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(
        "category",
        "trend_direction",
        F.round(F.element_at("history_return_rate", -1), 4).alias("current_return_rate"),
        F.round(F.try_element_at("projected_return_rate", F.lit(-1)), 4).alias("projected_return_rate_end_of_horizon"),
        F.round("return_rate_slope_per_month", 5).alias("return_rate_slope_per_month"),
        F.round("net_revenue_slope_per_month", 2).alias("net_revenue_slope_per_month"),
        F.round("projected_revenue_at_risk", 2).alias("projected_revenue_at_risk"),
    )


def rank_at_risk(forecasts: DataFrame, top_n: int = AT_RISK_TOP) -> DataFrame:
    """Categories whose return rate rises while net revenue falls, most revenue at risk first."""
    candidates = forecasts.where("return_rate_slope_per_month > 0 and net_revenue_slope_per_month < 0")
    worst = candidates.orderBy(F.desc("projected_revenue_at_risk"), "category").limit(top_n)
    place = W.orderBy(F.desc("projected_revenue_at_risk"), "category")
    return worst.select(F.row_number().over(place).cast("bigint").alias("place"), "category", "projected_revenue_at_risk")


def chart_series(forecasts: DataFrame) -> DataFrame:
    """Points to draw per category and metric; the last actual point also starts the forecast."""
    points = to_long(forecasts)
    last = forecasts.select(
        "category",
        F.lit("Forecast").alias("series"),
        F.element_at("history_months", -1).alias("order_month"),
        F.element_at("history_return_rate", -1).alias("return_rate"),
        F.element_at("history_net_revenue", -1).alias("net_revenue"),
    )
    return points.unionByName(last).unpivot(
        ["category", "series", "order_month"], ["return_rate", "net_revenue"], "metric", "value"
    )


def at_risk_chart_series(forecasts: DataFrame, top_n: int = AT_RISK_TOP) -> DataFrame:
    return chart_series(forecasts).join(rank_at_risk(forecasts, top_n).select("category"), "category", "left_semi")
