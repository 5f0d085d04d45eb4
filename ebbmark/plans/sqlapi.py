"""SQL over registered layer tables, with small JSON answers."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.functions.names import col, table_name
from ebbmark.operators.forecast import at_risk_chart_series, chart_series, forecast, forecast_summary, rank_at_risk
from ebbmark.operators.gold import erosion_ratio, slow_returns, top_erosion, top_return_rate, worst_both, worst_one_only
from ebbmark.sources.readers import read_parquet
from ebbmark.sources.sinks import RECORD_LIMIT, records

# The chart types known; anything else is drawn as a bar chart.
CHART_TYPES = ("bar", "line", "pie")


def register(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Make tables known to SQL under their names and return the columns of each."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return {name: df.columns for name, df in tables.items()}


def register_layer(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Register written layer tables under the names of their files."""
    return register({table_name(path): read_parquet(spark, path) for path in paths})


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a query. As a sub-query only a query can run, never a command."""
    return spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")


def query_records(spark: SparkSession, sql: str, limit: int = RECORD_LIMIT) -> DataFrame:
    return records(query(spark, sql), limit)


def run_sql(spark: SparkSession, sql: str, limit: int = RECORD_LIMIT) -> str:
    """Up to ``limit`` result rows as a JSON list; a failure is ``{"error": ...}``, never raised."""
    try:
        rows = query_records(spark, sql, limit).collect()
    except PySparkException as error:
        return json.dumps({"error": str(error)})
    return "[" + ",".join(row.record for row in rows) + "]"


def chart_data(spark: SparkSession, sql: str, x: str, y: str, chart_type: str | None = "bar", title: str = "") -> DataFrame:
    """The x and y values of a chart with its type; ``status`` is ok, failed or skipped, and ``reason`` says why where it is not ok."""
    kind = (chart_type or "bar").lower()
    kind = kind if kind in CHART_TYPES else "bar"

    def shaped(status: str, reason: str | None, x_value: Column, y_value: Column) -> list[Column]:
        return [
            F.lit(title).alias("title"),
            F.lit(kind).alias("chart_type"),
            x_value.cast("string").alias("x"),
            y_value.try_cast("double").alias("y"),
            F.lit(status).alias("status"),
            F.lit(reason).cast("string").alias("reason"),
        ]

    try:
        result = query(spark, sql)
    except PySparkException as error:
        status, reason = "failed", str(error)
    else:
        if x in result.columns and y in result.columns:
            return result.select(*shaped("ok", None, col(x), col(y)))
        status, reason = "skipped", "no column " + " and ".join(c for c in (x, y) if c not in result.columns)
    none = F.lit(None).cast("string")
    return spark.range(1).select(*shaped(status, reason, none, none))


def report(spark: SparkSession, tables: Mapping[str, DataFrame], at_risk: list[str] | None = None) -> dict[str, DataFrame]:
    """The data sets of a report: evidence, forecasts and the at-risk list (given or ranked)."""
    scorecard = tables["category_return_performance"]
    forecasts = forecast(tables["monthly_category_trend"])
    if at_risk:
        charts = chart_series(forecasts).where(F.col("category").isin(*at_risk))
        listed = spark.createDataFrame(list(enumerate(at_risk, 1)), "place bigint, category string")
    else:
        charts, listed = at_risk_chart_series(forecasts), rank_at_risk(forecasts)
    return {
        "top_return_rate": top_return_rate(scorecard),
        "top_erosion": top_erosion(scorecard),
        "worst_both": worst_both(scorecard),
        "worst_one_only": worst_one_only(scorecard),
        "slow_returns": slow_returns(scorecard),
        "erosion_ratio": erosion_ratio(scorecard),
        "forecast": forecasts,
        "forecast_summary": forecast_summary(forecasts),
        "at_risk": listed,
        "forecast_charts": charts,
    }


def answer(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, chart: Mapping[str, str] | None = None) -> dict:
    """Run the SQL and the chart of a follow-up question over the given tables."""
    catalog = register(tables)
    result = {"catalog": catalog, "records": run_sql(spark, sql), "chart": None}
    if chart:
        result["chart"] = chart_data(spark, chart["sql"], chart["x"], chart["y"], chart.get("chart_type"), chart.get("title", ""))
    return result
