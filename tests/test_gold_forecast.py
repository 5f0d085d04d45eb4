"""Scorecard, trend, profile and the linear forecast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbmark.operators import forecast as fc
from ebbmark.operators import gold
from ebbmark.operators import profile as pf

SIGNAL = ("order_id string, category string, order_month string, order_amount double, is_returned int, revenue_erosion double, "
          "net_revenue double, days_to_return bigint, return_reason string")


@pytest.fixture
def signal(spark):
    return spark.createDataFrame(
        [("1", "A", "2025-01-01", 100.0, 1, 60.0, 40.0, 4, "x"), ("2", "A", "2025-02-01", 50.0, 0, 0.0, 50.0, None, None),
         ("3", None, "2025-01-01", 10.0, 1, 5.0, 5.0, None, "y"), ("4", "B", None, None, 0, 0.0, 0.0, None, None),
         (None, "B", "2025-01-01", 0.0, 0, 0.0, 0.0, None, None)],
        SIGNAL,
    )


@pytest.fixture
def trend(spark):
    months = [f"2025-{m:02d}-01" for m in range(1, 7)]
    rows = [("Apparel", m, 100, 10 + 5 * i, (10 + 5 * i) / 100, 5000.0 - 400 * i) for i, m in enumerate(months)]
    rows += [("Books", m, 100, 2, 0.02, 3000.0 + 10 * i) for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "category string, order_month string, orders bigint, returns bigint, return_rate double, net_revenue double").repartition(4)


def test_scorecard(signal):
    rows = [tuple(r) for r in gold.category_performance(signal).orderBy("pk_gold_id").collect()]
    assert rows == [
        (1, "A", 2, 1, 150.0, 60.0, 90.0, 4.0, 0.5, 0.4),
        (2, "B", 1, 0, 0.0, 0.0, 0.0, None, 0.0, None),
        (3, None, 1, 1, 10.0, 5.0, 5.0, None, 1.0, 0.5),
    ]


def test_staged_gold_equals_direct(signal):
    staged = gold.gold(signal)
    assert staged["category_return_performance"].collect() == gold.category_performance(signal).collect()
    assert staged["monthly_category_trend"].collect() == gold.monthly_trend(signal).collect()
    with pytest.raises(ValueError):
        gold.gold(None)


def test_trend_order_and_null_groups(signal):
    rows = [(r.pk_gold_id, r.category, r.order_month, r.orders, r.return_rate) for r in gold.monthly_trend(signal).collect()]
    assert rows == [(1, "A", "2025-01-01", 1, 1.0), (2, "A", "2025-02-01", 1, 0.0), (3, "B", "2025-01-01", 0, None), (4, "B", None, 1, 0.0), (5, None, "2025-01-01", 1, 1.0)]


def test_worst_lists(spark):
    card = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.4, 0.9), ("c", 0.1, 0.8)], "category string, return_rate double, revenue_erosion_pct double")
    assert [r.category for r in gold.worst_both(card, 2).collect()] == ["b"]
    assert sorted(tuple(r) for r in gold.worst_one_only(card, 2).collect()) == [("a", "return_rate"), ("c", "revenue_erosion")]
    assert {tuple(r) for r in gold.rank_compare(card).collect()} == {("a", 1, 3), ("b", 2, 1), ("c", 3, 2)}


def test_forecast_values(trend):
    rows = {r.category: r for r in fc.forecast(trend, 3).collect()}
    a = rows["Apparel"]
    assert a.history_months[0] == "2025-01-01" and len(a.history_months) == 6
    assert a.future_months == ["2025-07-01", "2025-08-01", "2025-09-01"]
    assert a.projected_return_rate == pytest.approx([0.40, 0.45, 0.50])
    assert a.projected_net_revenue == pytest.approx([2600, 2200, 1800])
    assert a.return_rate_slope_per_month == pytest.approx(0.05) and a.net_revenue_slope_per_month == pytest.approx(-400)
    assert a.trend_direction == "rising" and a.projected_revenue_at_risk == pytest.approx(2400)
    assert rows["Books"].trend_direction == "flat" and rows["Books"].return_rate_slope_per_month == 0.0


def test_forecast_needs_history(trend):
    assert fc.forecast(trend.where("order_month <= '2025-02-01'")).count() == 0
    assert fc.forecast(trend.where("order_month <= '2025-03-01'")).count() == 2


def test_at_risk_ranking(trend):
    assert [r.category for r in fc.rank_at_risk(fc.forecast(trend)).collect()] == ["Apparel"]


def test_forecast_agrees_with_polyfit(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame([
        {"category": f"c{c}", "order_month": f"{2024 + m // 12}-{m % 12 + 1:02d}-01", "return_rate": rng.uniform(0, 1), "net_revenue": rng.uniform(-1e5, 1e5)}
        for c in range(20) for m in range(int(rng.integers(1, 18))) if m != 5  # a missing month leaves no gap
    ])
    rows = {r.category: r for r in fc.forecast(spark.createDataFrame(data), 4).collect()}
    assert set(rows) == {c for c, g in data.groupby("category") if len(g) >= 3}
    for name, group in data.groupby("category"):
        if name not in rows:
            continue
        group = group.sort_values("order_month")
        t, n = np.arange(len(group)), len(group)
        slope, start = np.polyfit(t, group.return_rate, 1)
        assert rows[name].projected_return_rate == pytest.approx(list(np.clip(slope * np.arange(n, n + 4) + start, 0, 1)))
        slope, start = np.polyfit(t, group.net_revenue, 1)
        projected = slope * np.arange(n, n + 4) + start
        assert rows[name].projected_net_revenue == pytest.approx(list(projected))
        assert rows[name].projected_revenue_at_risk == pytest.approx(np.maximum(group.net_revenue.iloc[-1] - projected, 0).sum(), abs=1e-6)


def test_unknown_category_and_month_leave_the_forecast(spark, trend):
    extra = spark.createDataFrame([(None, f"2025-0{m}-01", 0.1, 1.0) for m in range(1, 6)] + [("Books", None, 0.9, 9.0)], "category string, order_month string, return_rate double, net_revenue double")
    both = trend.select(*extra.columns).unionByName(extra)
    assert {r.category: len(r.history_months) for r in fc.forecast(both).collect()} == {"Apparel": 6, "Books": 6}


def test_long_and_chart_forms(trend):
    forecasts = fc.forecast(trend)
    long = fc.to_long(forecasts)
    assert long.where("series = 'Forecast'").count() == 6 and long.where("series = 'Actual'").count() == 12
    assert fc.forecast_long(trend).count() == 6
    chart = fc.at_risk_chart_series(forecasts)
    assert {r.category for r in chart.collect()} == {"Apparel"}
    bridge = chart.where("series = 'Forecast' and metric = 'net_revenue'").orderBy("order_month").collect()
    assert [r.order_month for r in bridge] == ["2025-06-01", "2025-07-01", "2025-08-01", "2025-09-01"]
    assert bridge[0].value == 3000.0
    summary = {r.category: r for r in fc.forecast_summary(forecasts).collect()}
    assert summary["Apparel"].current_return_rate == 0.35 and summary["Apparel"].projected_return_rate_end_of_horizon == 0.5


def test_profile_agrees_with_pandas(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", True), (2, float("nan"), None, None), (2, 2.25, "b", False), (None, None, "b", True)], "i int, d double, s string, b boolean")
    rows = {r.column: r for r in pf.profile(df, "t", "csv").collect()}
    for name, series in {"i": [1, 2, 2, None], "d": [1.5, None, 2.25, None], "s": ["a", None, "b", "b"], "b": [True, None, False, True]}.items():
        s = pd.Series(series, dtype="object")
        r = rows[name]
        assert (r.row_count, r.null_count, r.null_pct, r.unique_count) == (4, s.isna().sum(), round(s.isna().mean() * 100, 2), s.nunique())
        if name == "s":
            assert (r.min, r.max, r.mean) == (None, None, None)
        else:
            known = s.dropna().astype(float)
            assert (r.min, r.max, r.mean) == (known.min(), known.max(), round(known.mean(), 4))
    assert {r.column: r.unique_count for r in pf.profile(df, "t", approximate=True).collect()} == {"i": 2, "d": 2, "s": 2, "b": 2}


def test_distinct_counts_of_every_type(spark):
    df = spark.range(4000).selectExpr(
        "id", "cast(id % 7 as int) AS i", "cast(id as double) / 3 AS d", "cast(id % 11 as float) AS f", "if(id % 2 = 0, 0.0D, -0.0D) AS z",
        "date_add(date'2020-01-01', cast(id % 500 as int)) AS day", "timestamp_micros(id * 1000003) AS at", "cast(id as decimal(10,2)) AS m",
        "cast(id % 9 as decimal(30,2)) AS big", "array(id % 3) AS a", "repeat('x', cast(id % 300 as int)) AS s", "cast(null as int) AS n",
    )
    got = {r.column: r.unique_count for r in pf.profile(df, "t").collect()}
    assert got == {"id": 4000, "i": 7, "d": 4000, "f": 11, "z": 1, "day": 500, "at": 4000, "m": 4000, "big": 9, "a": 3, "s": 300, "n": 0}


def test_profile_of_an_empty_table(spark):
    row = pf.profile(spark.createDataFrame([], "a int"), "t").first()
    assert (row.row_count, row.null_pct, row.unique_count, row.mean) == (0, None, 0, None)


def test_layer_preview(spark):
    df = spark.range(10).select("id", F.lit("x").alias("_load_timestamp"))
    row = pf.layer_preview({"t": df, "u": df}).where("table = 't'").first()
    assert (row.columns, row.dtypes, row.row_count, len(row["sample"])) == (["id", "_load_timestamp"], ["bigint", "string"], 10, 3)
    assert pf.column_catalog({"t": df}) == {"t": ["id"]}
