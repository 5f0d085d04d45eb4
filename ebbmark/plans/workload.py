"""The registered queries over the star-schema tables and, for each, SQL that must give the same rows.

Every query reads whole tables. Money is rounded to 2 and rates to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.functions import text as tx
from ebbmark.functions.casts import to_integer, to_number, to_timestamp
from ebbmark.functions.dates import parse_timestamp, standard_date
from ebbmark.functions.names import col, drop_internal, table_name_column
from ebbmark.operators import cleanse, forecast, gold, layers, match, merge, profile, recall, rules
from ebbmark.operators.signal import signal
from ebbmark.plans import sqlapi, starmap
from ebbmark.plans.medallion import landing_to_gold
from ebbmark.plans.starmap import scan
from ebbmark.session import scratch_path, stage
from ebbmark.sources import infer, readers, runlog, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RUN_TS = "2025-01-01T00:00:00+00:00"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return function

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(col(c), digits[c]).alias(c) if c in digits else col(c) for c in df.columns])


# ---------------------------------------------------------------- shared SQL

_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_VIEWS = f"""
o AS (SELECT {_LINE_ID} AS order_id, o_orderdate AS order_date, CAST(o_custkey AS VARCHAR) AS customer_id,
        CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity, l_extendedprice AS order_amount,
        o_orderpriority AS channel
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT 'R-' || {_LINE_ID} AS return_id, {_LINE_ID} AS order_id, l_shipdate AS return_date,
        l_linestatus AS return_reason, l_extendedprice * (1 - l_discount) AS refund_amount
      FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category, p_brand AS sub_category FROM part)
"""
_SIGNAL = _VIEWS + """,
s AS (SELECT o.order_id, o.product_id, p.category, p.sub_category, o.quantity, o.order_amount,
        CASE WHEN r.return_id IS NULL THEN 0 ELSE 1 END AS is_returned, r.return_reason,
        CAST(floor((epoch_us(r.return_date) - epoch_us(o.order_date)) / 86400000000.0) AS BIGINT) AS days_to_return,
        coalesce(r.refund_amount, 0) AS revenue_erosion,
        o.order_amount - coalesce(r.refund_amount, 0) AS net_revenue,
        strftime(o.order_date, '%Y-%m-01') AS order_month
      FROM o LEFT JOIN r ON o.order_id = r.order_id LEFT JOIN p ON o.product_id = p.product_id)
"""


def _money(column: str) -> str:
    return f"coalesce(sum(CAST({column} AS DECIMAL(18,4))), 0)"


_SCORECARD = _SIGNAL + f""",
c AS (SELECT category, count(order_id) AS total_orders, CAST(sum(is_returned) AS BIGINT) AS total_returns,
        {_money('order_amount')} AS gross_revenue, {_money('revenue_erosion')} AS total_refunds,
        {_money('net_revenue')} AS net_revenue, avg(days_to_return) AS avg_days_to_return,
        CAST(sum(is_returned) AS DOUBLE) / nullif(count(order_id), 0) AS return_rate,
        CAST({_money('revenue_erosion')} AS DOUBLE) / nullif(CAST({_money('order_amount')} AS DOUBLE), 0) AS revenue_erosion_pct
      FROM s GROUP BY category)
"""
_SCORECARD_ROWS = """
SELECT row_number() OVER (ORDER BY category NULLS LAST) AS pk_gold_id, category, total_orders, total_returns,
  CAST(round(gross_revenue, 2) AS DOUBLE) AS gross_revenue, CAST(round(total_refunds, 2) AS DOUBLE) AS total_refunds,
  CAST(round(net_revenue, 2) AS DOUBLE) AS net_revenue, round(avg_days_to_return, 6) AS avg_days_to_return,
  round(return_rate, 6) AS return_rate, round(revenue_erosion_pct, 6) AS revenue_erosion_pct
FROM c
"""
_TREND = _SIGNAL + f""",
t AS (SELECT category, order_month, count(order_id) AS orders, CAST(sum(is_returned) AS BIGINT) AS returns,
        {_money('net_revenue')} AS net_revenue, CAST(sum(is_returned) AS DOUBLE) / nullif(count(order_id), 0) AS return_rate
      FROM s GROUP BY category, order_month)
"""
_TREND_ROWS = """
SELECT row_number() OVER (ORDER BY category NULLS LAST, order_month NULLS LAST) AS pk_gold_id, category, order_month,
  orders, returns, CAST(round(net_revenue, 2) AS DOUBLE) AS net_revenue, round(return_rate, 6) AS return_rate
FROM t
"""
_FITS = _TREND + f""",
h AS (SELECT category, order_month, return_rate, CAST(net_revenue AS DOUBLE) AS net_revenue,
        row_number() OVER (PARTITION BY category ORDER BY order_month) - 1 AS t
      FROM t WHERE category IS NOT NULL),
f AS (SELECT category, count(*) AS n, regr_slope(return_rate, t) AS rs, regr_intercept(return_rate, t) AS ri,
        regr_slope(net_revenue, t) AS ns, regr_intercept(net_revenue, t) AS ni, max(order_month) AS last_month,
        arg_max(return_rate, t) AS last_rate, arg_max(net_revenue, t) AS last_revenue
      FROM h GROUP BY category HAVING count(*) >= 3),
g AS (SELECT f.*, i AS step, strftime(CAST(last_month AS DATE) + to_months(CAST(i AS INTEGER)), '%Y-%m-01') AS order_month,
        least(greatest(rs * (n - 1 + i) + ri, 0), 1) AS return_rate, ns * (n - 1 + i) + ni AS net_revenue
      FROM f, (SELECT unnest(range(1, 4)) AS i)),
k AS (SELECT category, sum(greatest(last_revenue - net_revenue, 0)) AS risk,
        arg_max(return_rate, step) AS end_rate FROM g GROUP BY category)
"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return signal(**starmap.views(spark, folder))


def _scorecard(spark: SparkSession, folder: str) -> DataFrame:
    return gold.category_performance(_signals(spark, folder))


def _trend(spark: SparkSession, folder: str) -> DataFrame:
    return gold.monthly_trend(_signals(spark, folder))


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    # The month sums feed several branches of a forecast; written once, they are a few hundred rows.
    return forecast.forecast(stage(_trend(spark, folder), "trend"))


_round_scorecard = partial(
    rounded, gross_revenue=2, total_refunds=2, net_revenue=2, avg_days_to_return=6, return_rate=6, revenue_erosion_pct=6
)
_round_trend = partial(rounded, net_revenue=2, return_rate=6)


# ---------------------------------------------------------------- Signal and Gold

@query(f"WITH {_SCORECARD} {_SCORECARD_ROWS}")
def category_scorecard(spark, folder):
    return _round_scorecard(_scorecard(spark, folder))


@query(f"WITH {_TREND} {_TREND_ROWS}")
def monthly_trend(spark, folder):
    return _round_trend(_trend(spark, folder))


@query(f"""WITH {_SIGNAL} SELECT order_id, product_id, category, sub_category, quantity, order_amount, is_returned,
  return_reason, days_to_return, round(revenue_erosion, 4) AS revenue_erosion, round(net_revenue, 4) AS net_revenue, order_month
FROM s""")
def signal_features(spark, folder):
    return rounded(_signals(spark, folder), revenue_erosion=4, net_revenue=4)


@query(f"""WITH {_VIEWS} SELECT order_id, product_id, 'unknown' AS category, 'unknown' AS sub_category, quantity, order_amount,
  0 AS is_returned, CAST(NULL AS VARCHAR) AS return_reason, CAST(NULL AS BIGINT) AS days_to_return,
  CAST(0 AS DOUBLE) AS revenue_erosion, order_amount AS net_revenue, strftime(order_date, '%Y-%m-01') AS order_month FROM o""")
def signal_orders_only(spark, folder):
    return signal(starmap.orders(spark, folder))


@query(f"""WITH {_VIEWS}, big AS (SELECT CAST(o_custkey AS VARCHAR) AS order_id, o_totalprice AS order_amount, o_orderdate AS order_date FROM orders),
back AS (SELECT CAST(o_custkey AS VARCHAR) AS order_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS refund_amount FROM orders GROUP BY 1)
SELECT strftime(order_date, '%Y-%m-01') AS order_month, count(*) AS orders,
  CAST(round(sum(CAST(refund_amount AS DECIMAL(18,4))), 2) AS DOUBLE) AS refunds
FROM big LEFT JOIN back USING (order_id) GROUP BY 1""")
def signal_collapsed_returns(spark, folder):
    """Several returns per order key, combined to one before the join."""
    table = scan(spark, folder, "orders").withColumn("order_id", F.col("o_custkey").cast("string"))
    orders = table.select("order_id", F.col("o_totalprice").alias("order_amount"), F.col("o_orderdate").alias("order_date"))
    returns = table.select(
        F.col("o_orderkey").alias("return_id"), "order_id", F.col("o_orderdate").alias("return_date"), F.col("o_totalprice").alias("refund_amount")
    )
    lines = signal(orders, returns, collapse_returns=True)
    sums = lines.groupBy("order_month").agg(F.count("order_id").alias("orders"), gold.money_sum(F.col("revenue_erosion")).alias("refunds"))
    return rounded(sums, refunds=2)


@query(f"WITH {_SCORECARD} {_SCORECARD_ROWS}")
def gold_scorecard_staged(spark, folder):
    return _round_scorecard(gold.gold(_signals(spark, folder))["category_return_performance"])


@query(f"WITH {_TREND} {_TREND_ROWS}")
def gold_trend_staged(spark, folder):
    return _round_trend(gold.gold(_signals(spark, folder))["monthly_category_trend"])


@query(f"WITH {_SIGNAL} SELECT count(*) AS rows, round(avg(is_returned), 4) AS return_rate FROM s")
def overall_return_rate(spark, folder):
    return gold.overall_return_rate(_signals(spark, folder))


@query(f"WITH {_SIGNAL} SELECT category, round(avg(is_returned), 6) AS return_rate FROM s GROUP BY category")
def category_return_rate(spark, folder):
    return rounded(gold.category_return_rate(_signals(spark, folder)), return_rate=6)


# ---------------------------------------------------------------- evidence queries

def _top_sql(measure: str) -> str:
    return f"""WITH {_SCORECARD} SELECT place, category, round({measure}, 6) AS {measure} FROM (
  SELECT row_number() OVER (ORDER BY {measure} DESC NULLS LAST, category) AS place, * FROM c) WHERE place <= 3"""


@query(_top_sql("return_rate"))
def top_return_rate(spark, folder):
    return rounded(gold.top_return_rate(_scorecard(spark, folder)), return_rate=6)


@query(_top_sql("revenue_erosion_pct"))
def top_erosion(spark, folder):
    return rounded(gold.top_erosion(_scorecard(spark, folder)), revenue_erosion_pct=6)


_TOPS = _SCORECARD + """,
a AS (SELECT category FROM c ORDER BY return_rate DESC NULLS LAST, category LIMIT 3),
b AS (SELECT category FROM c ORDER BY revenue_erosion_pct DESC NULLS LAST, category LIMIT 3)
"""


@query(f"WITH {_TOPS} SELECT category FROM a INTERSECT SELECT category FROM b")
def worst_both(spark, folder):
    return gold.worst_both(stage(_scorecard(spark, folder), "scorecard"))


@query(f"""WITH {_TOPS} SELECT category, 'return_rate' AS measure FROM a WHERE category NOT IN (SELECT category FROM b)
UNION ALL SELECT category, 'revenue_erosion' AS measure FROM b WHERE category NOT IN (SELECT category FROM a)""")
def worst_one_only(spark, folder):
    return gold.worst_one_only(stage(_scorecard(spark, folder), "scorecard"))


@query(f"""WITH {_SCORECARD} SELECT category, rank() OVER (ORDER BY return_rate DESC NULLS LAST) AS rate_rank,
  rank() OVER (ORDER BY revenue_erosion_pct DESC NULLS LAST) AS erosion_rank FROM c""")
def rank_compare(spark, folder):
    return gold.rank_compare(_scorecard(spark, folder))


@query(f"WITH {_SCORECARD} SELECT category, round(avg_days_to_return, 6) AS avg_days_to_return FROM c")
def slow_returns(spark, folder):
    return rounded(gold.slow_returns(_scorecard(spark, folder)), avg_days_to_return=6)


@query(f"""WITH {_SCORECARD} SELECT category, CAST(round(total_refunds, 2) AS DOUBLE) AS total_refunds,
  CAST(round(gross_revenue, 2) AS DOUBLE) AS gross_revenue, round(revenue_erosion_pct, 6) AS revenue_erosion_pct FROM c""")
def erosion_ratio(spark, folder):
    return rounded(gold.erosion_ratio(_scorecard(spark, folder)), total_refunds=2, gross_revenue=2, revenue_erosion_pct=6)


@query(f"""WITH {_SIGNAL} SELECT category, return_reason, count(*) AS returns,
  CAST(round({_money('revenue_erosion')}, 2) AS DOUBLE) AS refunds FROM s WHERE is_returned = 1 GROUP BY category, return_reason""")
def returns_by_reason(spark, folder):
    return rounded(gold.returns_by_reason(_signals(spark, folder)), refunds=2)


@query(f"""WITH {_TREND} SELECT category, order_month, round(return_rate, 6) AS return_rate,
  round(return_rate - lag(return_rate) OVER (PARTITION BY category ORDER BY order_month), 6) AS rate_change FROM t""")
def month_over_month(spark, folder):
    return rounded(gold.month_over_month(_trend(spark, folder)), return_rate=6, rate_change=6)


@query(f"""WITH {_VIEWS} SELECT channel, category, count(o.order_id) AS orders, count(return_id) AS returns,
  round(CAST(count(return_id) AS DOUBLE) / count(o.order_id), 6) AS return_rate
FROM o LEFT JOIN r ON o.order_id = r.order_id LEFT JOIN p ON o.product_id = p.product_id GROUP BY channel, category""")
def channel_category(spark, folder):
    return rounded(gold.channel_category(**starmap.views(spark, folder)), return_rate=6)


# ---------------------------------------------------------------- forecast

@query(f"""WITH {_FITS} SELECT category, step, order_month, round(return_rate, 6) AS return_rate, round(net_revenue, 2) AS net_revenue FROM g""")
def forecast_long(spark, folder):
    return rounded(forecast.forecast_long(_trend(spark, folder)), return_rate=6, net_revenue=2)


@query(f"""WITH {_FITS} SELECT category,
  CASE WHEN rs > 0.001 THEN 'rising' WHEN rs < -0.001 THEN 'falling' ELSE 'flat' END AS trend_direction,
  round(last_rate, 4) AS current_return_rate, round(end_rate, 4) AS projected_return_rate_end_of_horizon,
  round(rs, 5) AS return_rate_slope_per_month, round(ns, 2) AS net_revenue_slope_per_month,
  round(risk, 2) AS projected_revenue_at_risk FROM f JOIN k USING (category)""")
def forecast_summary(spark, folder):
    return forecast.forecast_summary(_forecasts(spark, folder))


_AT_RISK = _FITS + """,
w AS (SELECT row_number() OVER (ORDER BY risk DESC, category) AS place, category, risk
      FROM f JOIN k USING (category) WHERE rs > 0 AND ns < 0)
"""


@query(f"WITH {_AT_RISK} SELECT place, category, round(risk, 2) AS projected_revenue_at_risk FROM w WHERE place <= 3")
def at_risk_ranking(spark, folder):
    return rounded(forecast.rank_at_risk(_forecasts(spark, folder)), projected_revenue_at_risk=2)


_POINTS = _AT_RISK + """,
pt AS (SELECT category, 'Actual' AS series, order_month, return_rate, net_revenue FROM h
       UNION ALL SELECT category, 'Forecast' AS series, order_month, return_rate, net_revenue FROM g),
ch AS (SELECT * FROM pt UNION ALL SELECT category, 'Forecast' AS series, last_month, last_rate, last_revenue FROM f),
m AS (SELECT category, series, order_month, 'return_rate' AS metric, return_rate AS value FROM ch
      UNION ALL SELECT category, series, order_month, 'net_revenue' AS metric, net_revenue FROM ch)
"""


@query(f"""WITH {_POINTS} SELECT category, series, order_month, round(return_rate, 6) AS return_rate,
  round(net_revenue, 4) AS net_revenue FROM pt WHERE category IN (SELECT category FROM f)""")
def forecast_points(spark, folder):
    return rounded(forecast.to_long(_forecasts(spark, folder)), return_rate=6, net_revenue=4)


@query(f"WITH {_POINTS} SELECT category, series, order_month, metric, round(value, 4) AS value FROM m WHERE category IN (SELECT category FROM f)")
def forecast_series(spark, folder):
    return rounded(forecast.chart_series(_forecasts(spark, folder)), value=4)


@query(f"WITH {_POINTS} SELECT category, series, order_month, metric, round(value, 4) AS value FROM m WHERE category IN (SELECT category FROM w WHERE place <= 3)")
def at_risk_charts(spark, folder):
    return rounded(forecast.at_risk_chart_series(_forecasts(spark, folder)), value=4)


@query(f"""WITH {_FITS} SELECT category, count(*) AS months, string_agg(order_month, ',' ORDER BY order_month) AS history,
  round(sum(return_rate), 6) AS rate_sum, CAST(sum(CAST(net_revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue_sum
FROM h GROUP BY category""")
def series_arrays(spark, folder):
    arrays = forecast.series(_trend(spark, folder))
    points = arrays.select(
        "category",
        F.size("history_months").cast("bigint").alias("months"),
        F.array_join("history_months", ",").alias("history"),
        F.aggregate("history_return_rate", F.lit(0.0), lambda a, x: a + x).alias("rate_sum"),
        F.aggregate("history_net_revenue", F.lit(0.0), lambda a, x: a + x).alias("revenue_sum"),
    )
    return rounded(points, rate_sum=6, revenue_sum=4)


# ---------------------------------------------------------------- profile and preview

_PROFILED = {
    "l_orderkey": ("bigint", True), "l_partkey": ("bigint", True), "l_suppkey": ("bigint", True), "l_linenumber": ("int", True),
    "l_quantity": ("double", True), "l_extendedprice": ("double", True), "l_discount": ("double", True), "l_tax": ("double", True),
    "l_returnflag": ("string", False), "l_linestatus": ("string", False), "l_shipdate": ("timestamp_ntz", False),
}


def _profile_sql(name: str, dtype: str, numeric: bool) -> str:
    number = f"CAST({name} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return f"""SELECT 'lineitem' AS dataset, 'parquet' AS format, count(*) AS row_count, '{name}' AS "column", '{dtype}' AS dtype,
  count(*) - count({name}) AS null_count, round((count(*) - count({name})) * 100.0 / count(*), 2) AS null_pct,
  count(DISTINCT {name}) AS unique_count, round(min({number}), 4) AS min, round(max({number}), 4) AS max,
  round(avg({number}), 4) AS mean FROM lineitem"""


@query(" UNION ALL ".join(_profile_sql(n, *t) for n, t in _PROFILED.items()))
def profile_lineitem(spark, folder):
    return profile.profile(scan(spark, folder, "lineitem"), "lineitem")


@query(" UNION ALL ".join(
    f"""SELECT '{n}' AS "column", '{dtype}' AS dtype, count(*) AS row_count, count(*) - count({n}) AS null_count, true AS close FROM lineitem"""
    for n, (dtype, _) in _PROFILED.items()
))
def profile_approximate(spark, folder):
    """The sketched distinct counts lie within 15 percent of the exact ones."""
    lines = scan(spark, folder, "lineitem")
    sketched = profile.profile(lines, "lineitem", approximate=True).withColumnRenamed("unique_count", "sketched")
    both = sketched.join(profile.distinct_counts(lines), "column")
    close = F.abs(F.col("sketched") - F.col("unique_count")) <= 0.15 * F.col("unique_count")
    return both.select("column", "dtype", "row_count", "null_count", close.alias("close"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents")
def profile_documents(spark, folder):
    """Distinct values of long texts."""
    documents = scan(spark, folder, "documents")
    counts = profile.profile(documents, "documents")

    def unique(name: str):
        return F.max(F.when(F.col("column") == name, F.col("unique_count")))

    return counts.agg(F.max("row_count").alias("rows"), unique("text").alias("texts"), unique("lang").alias("langs"), unique("source").alias("sources"))


_PREVIEWED = (
    ("orders", "o", "order_id,order_date,customer_id,product_id,quantity,unit_price,order_amount,channel"),
    ("returns", "r", "return_id,order_id,return_date,return_reason,refund_amount"),
    ("order_line_signals", "s", "order_id,product_id,category,sub_category,quantity,order_amount,is_returned,return_reason,"
                                "days_to_return,revenue_erosion,net_revenue,order_month"),
)


@query(f"WITH {_SIGNAL}" + " UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{columns}' AS columns, count(*) AS row_count, least(count(*), 3) AS samples FROM {source}"""
    for table, source, columns in _PREVIEWED
))
def layer_preview(spark, folder):
    """Which rows serve as samples is left to Spark; their number is not."""
    tables = {**starmap.views(spark, folder), "order_line_signals": _signals(spark, folder)}
    preview = profile.layer_preview({name: tables[name] for name, _, _ in _PREVIEWED})
    return preview.select(
        F.col("table").alias("table_name"), F.array_join("columns", ",").alias("columns"), "row_count", F.size("sample").cast("bigint").alias("samples")
    )


@query(f"WITH {_SCORECARD} {_SCORECARD_ROWS}")
def result_records(spark, folder):
    """The JSON records of a result, up to the record limit, read back."""
    card = _scorecard(spark, folder)
    records = sinks.records(card)
    return _round_scorecard(records.select(F.from_json("record", card.schema).alias("r")).select("r.*"))


# ---------------------------------------------------------------- cleansing

_GAPPY = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber <> 5 THEN l_discount END AS discount, CASE WHEN l_linenumber <> 6 THEN l_returnflag END AS flag,
  CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS status FROM lineitem"""


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose columns lack some values."""
    def but(number: int, name: str):
        return F.when(F.col("l_linenumber") != number, F.col(name))

    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        but(3, "l_quantity").alias("quantity"), but(4, "l_extendedprice").alias("price"),
        but(5, "l_discount").alias("discount"), but(6, "l_returnflag").alias("flag"), but(7, "l_linestatus").alias("status"),
    )


@query(f"""WITH x AS ({_GAPPY}),
m AS (SELECT avg(quantity) AS mq, median(price) AS mp FROM x),
d AS (SELECT flag AS mf FROM x WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(quantity, mq), 6) AS quantity, round(coalesce(price, mp), 4) AS price,
  coalesce(discount, 0) AS discount, coalesce(flag, mf) AS flag, coalesce(status, 'unknown') AS status FROM x, m, d""")
def fill_nulls_stats(spark, folder):
    logic = {"quantity": "fill:mean", "price": "fill:median", "discount": "fill:0", "flag": "fill:mode", "status": ""}
    return rounded(cleanse.fill_nulls(_gappy(spark, folder), logic), quantity=6, price=4)


@query(f"SELECT * FROM ({_GAPPY}) WHERE quantity IS NOT NULL AND price IS NOT NULL AND flag IS NOT NULL")
def drop_nulls(spark, folder):
    return cleanse.drop_nulls(_gappy(spark, folder), ["quantity", "price", "flag", "not_there"])


@query("SELECT DISTINCT l_partkey, l_quantity, l_returnflag, l_linestatus, l_discount FROM lineitem")
def dedup_rows(spark, folder):
    return cleanse.drop_copies(
        scan(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    )


@query("""SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def dedup_by_key(spark, folder):
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return cleanse.keep_first(lines, ["l_orderkey"], ["l_shipdate"])


@query("""SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pk_lines_silver_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem""")
def surrogate_key(spark, folder):
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return cleanse.surrogate_key(lines, "pk_lines_silver_id", order, total_order=True)


@query("SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS pk_flags_silver_id, l_returnflag, l_linestatus FROM lineitem")
def surrogate_key_copies(spark, folder):
    """Six distinct rows, each copied very often: every copy gets its own number."""
    flags = scan(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    return cleanse.surrogate_key(flags, "pk_flags_silver_id", ["l_returnflag", "l_linestatus"])


# ---------------------------------------------------------------- casts, dates, text

_MESSY_NUMBER = """CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  WHEN 3 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' WHEN 4 THEN 'N/A' WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5'
  WHEN 6 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e2' ELSE '' END"""
_KEY4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _messy_number():
    whole = F.col("l_quantity").cast("bigint").cast("string")
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, F.col("l_quantity").cast("string")).when(n == 2, whole).when(n == 3, F.concat(F.lit(" "), whole, F.lit(" ")))
        .when(n == 4, "N/A").when(n == 5, F.concat(whole, F.lit(".5"))).when(n == 6, F.concat(whole, F.lit("e2"))).otherwise("")
    )


@query(f"""SELECT {_KEY4}, CASE WHEN l_linenumber IN (1, 2, 3) THEN CAST(l_quantity AS BIGINT) WHEN l_linenumber = 6 THEN CAST(l_quantity * 100 AS BIGINT) END AS as_integer,
  CASE WHEN l_linenumber IN (1, 2, 3) THEN l_quantity WHEN l_linenumber = 5 THEN l_quantity + 0.5 WHEN l_linenumber = 6 THEN l_quantity * 100 END AS as_float,
  {_MESSY_NUMBER} AS as_text FROM lineitem""")
def cast_lenient(spark, folder):
    lines = scan(spark, folder, "lineitem").withColumn("n", _messy_number())
    dtype = lines.schema["n"].dataType
    return lines.select(
        *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        to_integer(F.col("n"), dtype).alias("as_integer"),
        to_number(F.col("n"), dtype).alias("as_float"),
        F.col("n").alias("as_text"),
    )


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, o_orderkey % 7 AS style FROM orders)
SELECT o_orderkey, CASE WHEN style = 6 THEN NULL WHEN style = 2 AND day(o_orderdate) <= 12
    THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_day,
  strftime(o_orderdate, '%Y-%m-01') AS order_month FROM d""")
def dates_standardised(spark, folder):
    """Dates written in seven styles; day-first ones read as month-first where that is possible."""
    day, style = F.col("o_orderdate"), F.col("o_orderkey") % 7
    styles = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss"]
    written = F.lit("not a date")
    for i, pattern in enumerate(styles):
        written = F.when(style == i, F.date_format(day, pattern)).otherwise(written)
    texts = scan(spark, folder, "orders").select("o_orderkey", "o_orderdate", written.alias("written"))
    return texts.select(
        "o_orderkey",
        standard_date(parse_timestamp(F.col("written"))).alias("order_day"),
        F.date_format(to_timestamp(F.col("o_orderdate"), texts.schema["o_orderdate"].dataType), "yyyy-MM-01").alias("order_month"),
    )


@query(r"""SELECT doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS lowered, upper(source || ' ' || lang) AS uppered,
  array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|\P{L}+'), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '') AS titled,
  '|' || source || '|' AS stripped FROM documents""")
def text_normalised(spark, folder):
    text = F.col("text")
    return scan(spark, folder, "documents").select(
        "doc_id",
        tx.normalize_text(text, "lowercase, strip").alias("lowered"),
        tx.normalize_text(F.concat_ws(" ", "source", "lang"), "UPPERCASE").alias("uppered"),
        tx.normalize_text(text, "title case").alias("titled"),
        F.concat(F.lit("|"), tx.normalize_text(F.concat(F.lit(" \t\n"), F.col("source"), F.lit("\n ")), "trim"), F.lit("|")).alias("stripped"),
    )


@query(r"SELECT page_id, lower(regexp_extract(url, '([^/]+?)(\.[^./]*)?/*$', 1)) AS table_name FROM pages")
def table_names(spark, folder):
    """The table name a path stands for, on every page address."""
    return scan(spark, folder, "pages").select("page_id", table_name_column(F.col("url")).alias("table_name"))


# ---------------------------------------------------------------- rules and layers

def _bronze_rules() -> list[rules.Rule]:
    """Landing rules for the three views. The order id of returns has no rule and must survive."""
    def make(table, source, target, kind="direct", logic=""):
        return rules.Rule("landing", table, source, "bronze", table, target, kind, logic)

    return [
        make("orders", "order_id", "order_id", "indirect", "text"),
        make("orders", "order_date", "order_date", "indirect", "datetime"),
        make("orders", "product_id", "product_id", "indirect", "text"),
        make("orders", "quantity", "quantity", "indirect", "integer"),
        make("orders", "order_amount", "order_amount", "indirect", "float"),
        make("orders", "channel", "sales_channel"),
        make("orders", "absent", "absent"),
        make("orders", None, "_load_timestamp", "metadata"),
        make("returns", "return_id", "return_id"),
        make("returns", "return_date", "return_date", "indirect", "datetime"),
        make("returns", "return_reason", "return_reason"),
        make("returns", "refund_amount", "refund_amount", "indirect", "float"),
        make("products", "product_id", "product_id"),
        make("products", "category", "category"),
        make("products", "sub_category", "sub_category"),
    ]


def _silver_rules() -> list[rules.Rule]:
    def make(table, source, target, kind="passthrough", logic=""):
        return rules.Rule("bronze", table, source, "silver", table, target, kind, logic)

    return [
        make("orders", None, "pk_orders_silver_id", "surrogate_key", "sequential integer id"),
        make("orders", "order_id", "order_id", "dedup", "on order_id"),
        make("orders", "order_date", "order_date", "date_standardize", "parse to YYYY-MM-DD"),
        make("orders", "quantity", "quantity", "null_handling", "fill:0"),
        make("orders", "order_amount", "order_amount", "null_handling", "drop"),
        make("orders", "sales_channel", "channel", "text_normalize", "lowercase, strip"),
        make("returns", "return_id", "return_id", "dedup", "on return_id"),
        make("returns", "return_date", "return_date", "date_standardize", "parse to YYYY-MM-DD"),
        make("returns", "return_reason", "return_reason", "null_handling", "fill:unknown"),
        make("returns", "refund_amount", "refund_amount", "type_cast", "float"),
        make("products", "product_id", "product_id", "dedup", "on product_id"),
        make("products", "category", "category", "text_normalize", "uppercase"),
        make("products", "sub_category", "sub_category"),
    ]


@query(f"""WITH {_VIEWS} SELECT order_id, order_date, product_id, CAST(quantity AS BIGINT) AS quantity, order_amount,
  channel AS sales_channel, '{RUN_TS}' AS _load_timestamp, customer_id FROM o""")
def bronze_orders(spark, folder):
    """The customer id has no rule and is kept as a business key."""
    bronzes = layers.bronze({"orders": starmap.orders(spark, folder)}, _bronze_rules()[:8], run_ts=RUN_TS)
    return bronzes["orders"].withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query(f"""WITH {_VIEWS} SELECT return_id, return_date, return_reason, refund_amount, order_id FROM r""")
def id_recovery(spark, folder):
    bronzes = layers.bronze({"returns": starmap.returns(spark, folder)}, [r for r in _bronze_rules() if r.target_table == "returns"])
    return bronzes["returns"].withColumn("return_date", F.col("return_date").cast("timestamp_ntz"))


@query("SELECT 'lineitem.parquet' AS source_file, count(*) AS rows FROM lineitem")
def bronze_metadata(spark, folder):
    rule = [rules.Rule("landing", "lineitem", "l_orderkey", "bronze", "lineitem", "l_orderkey", "direct", "")]
    marks = [rules.Rule(target_table="lineitem", target_column=c, transformation_type="metadata") for c in ("_load_timestamp", "_source_file")]
    table = layers.bronze({"lineitem": scan(spark, folder, "lineitem")}, rule + marks)["lineitem"]
    name = F.regexp_extract("_source_file", "[^/]+$", 0).alias("source_file")
    return table.groupBy(name).agg(F.count("_load_timestamp").alias("rows"))


@query("SELECT l_orderkey, l_returnflag FROM lineitem")
def drop_internal_columns(spark, folder):
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.lit(RUN_TS).alias("_load_timestamp"), F.input_file_name().alias("_source_file"))
    return drop_internal(lines)


@query(f"""WITH {_VIEWS}, x AS (SELECT DISTINCT order_id, strftime(order_date, '%Y-%m-%d') AS order_date, CAST(quantity AS BIGINT) AS quantity,
  order_amount, lower(channel) AS channel, product_id, customer_id FROM o WHERE order_amount IS NOT NULL)
SELECT row_number() OVER (ORDER BY order_id, order_date, quantity, order_amount, channel, product_id, customer_id) AS pk_orders_silver_id, * FROM x""")
def silver_orders(spark, folder):
    tables = {"orders": starmap.orders(spark, folder)}
    bronzes = layers.bronze(tables, [r for r in _bronze_rules() if r.target_table == "orders"], run_ts=RUN_TS)
    silver_rules = [r for r in _silver_rules() if r.target_table == "orders"]
    return layers.silver(bronzes, silver_rules, {"orders": ["order_id"]})["orders"]


@query(f"WITH {_SCORECARD} {_SCORECARD_ROWS}")
def landing_to_gold_scorecard(spark, folder):
    """All layers, driven by rules, from the landing views to the scorecard."""
    golds = landing_to_gold(spark, starmap.views(spark, folder), _bronze_rules(), _silver_rules(), run_ts=RUN_TS)
    return _round_scorecard(golds["category_return_performance"])


@query(f"WITH {_TREND} {_TREND_ROWS}")
def landing_to_gold_trend_written(spark, folder):
    """The same with every layer written and logged, and the next one reading what was written."""
    out = scratch_path(spark, "layers")
    golds = landing_to_gold(spark, starmap.views(spark, folder), _bronze_rules(), _silver_rules(), out=out, run_ts=RUN_TS)
    return _round_trend(golds["monthly_category_trend"])


_COUNTED = "SELECT '{layer}' AS layer, '{table}' AS table_name, count(*) AS rows FROM {source}"


@query(f"WITH {_TREND}, c AS (SELECT DISTINCT category FROM s) " + " UNION ALL ".join(
    _COUNTED.format(layer=layer, table=table, source=source)
    for layer, table, source in (
        ("bronze", "orders", "o"), ("bronze", "returns", "r"), ("bronze", "products", "p"),
        ("silver", "orders", "(SELECT DISTINCT * FROM o)"), ("silver", "returns", "(SELECT DISTINCT * FROM r)"), ("silver", "products", "p"),
        ("signal", "order_line_signals", "s"), ("gold", "category_return_performance", "c"), ("gold", "monthly_category_trend", "t"),
    )
))
def layer_metrics(spark, folder):
    """Rows per written table, from the run log."""
    out = scratch_path(spark, "layers")
    landing_to_gold(spark, starmap.views(spark, folder), _bronze_rules(), _silver_rules(), out=out, run_id="run-7")
    written = runlog.read_log(spark, f"{out}/log", "run-7").where("action = 'table_written'")
    details = F.col("details")
    return written.select(F.col("agent").alias("layer"), details["table"].alias("table_name"), details["rows"].cast("bigint").alias("rows"))


# ---------------------------------------------------------------- joins

@query("""SELECT c.c_custkey, c.c_name, c.region, n.n_name, n.region AS region_nation FROM
  (SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation_id, c_mktsegment AS region FROM customer) c
  LEFT JOIN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END AS nation_id, n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation) n
  ON c.nation_id IS NOT DISTINCT FROM n.nation_id""")
def left_merge(spark, folder):
    """NULL keys match NULL keys, and an equal column name gets a suffix."""
    customers = scan(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation_id"), F.col("c_mktsegment").alias("region")
    )
    nations = scan(spark, folder, "nation").select(
        F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).alias("nation_id"), "n_name", F.col("n_regionkey").cast("string").alias("region")
    )
    return merge.merge_left(customers, nations, "nation_id", "nation_id", "_nation").drop("nation_id")


@query("""SELECT e.user_key, e.events, count(m.event_id) AS matches, CAST(round(coalesce(sum(CAST(m.value AS DECIMAL(18,4))), 0), 2) AS DOUBLE) AS value
FROM (SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS user_key, count(*) AS events FROM events GROUP BY 1) e
LEFT JOIN (SELECT event_id, value, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS user_key FROM events) m USING (user_key)
GROUP BY e.user_key, e.events""")
def left_merge_hot_key(spark, folder):
    """One key holds a third of the right rows; it is found by a sketch and salted."""
    key = F.when(F.col("user_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_key")
    events = scan(spark, folder, "events").select("event_id", "value", key)
    users = events.groupBy("user_key").agg(F.count(F.lit(1)).alias("events"))
    joined = merge.merge_left(users, events, "user_key", "user_key", hot=merge.hot_keys(events, "user_key", share=0.1))
    sums = joined.groupBy("user_key", "events").agg(F.count("event_id").alias("matches"), gold.money_sum(F.col("value")).alias("value"))
    return rounded(sums, value=2)


# ---------------------------------------------------------------- sources and sinks

@query("SELECT * FROM lineitem")
def layer_scan(spark, folder):
    """Write a layer table and read it back."""
    return sinks.write_layer(scan(spark, folder, "lineitem"), scratch_path(spark, "layer"), "run", "bronze", "lineitem")


_TYPED = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus = 'F' AS filled,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders"""


def _order_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as texts, the way a file holds them; a missing priority is the token N/A."""
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("filled"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("N/A").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
    )


@query(_TYPED)
def infer_types(spark, folder):
    return infer.infer_types(_order_texts(spark, folder))


@query(_TYPED)
def csv_scan(spark, folder):
    path = scratch_path(spark, "landing") + ".csv"
    _order_texts(spark, folder).write.csv(path, header=True, quote='"', escape='"')
    return readers.read_any(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def csv_scan_multiline(spark, folder):
    """Texts with line breaks and quotes through CSV."""
    path = scratch_path(spark, "landing") + ".csv"
    scan(spark, folder, "documents").select("doc_id", "text", "lang").write.csv(path, header=True, quote='"', escape='"')
    return readers.read_any(spark, path)


# The dots of flattened names are written as two underscores here, for tools that split names at dots.
_NESTED = """SELECT o_orderkey AS order__id, o_orderstatus AS order__state__code, o_totalprice AS order__state__total, o_custkey AS customer FROM orders"""


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    state = F.struct(F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("total"))
    return scan(spark, folder, "orders").select(F.struct(F.col("o_orderkey").alias("id"), state.alias("state")).alias("order"), F.col("o_custkey").alias("customer"))


def _without_dots(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "__") for c in df.columns])


@query(_NESTED)
def flatten_records(spark, folder):
    return _without_dots(readers.flatten(_nested(spark, folder)))


@query(_NESTED)
def json_lines_scan(spark, folder):
    path = scratch_path(spark, "landing") + ".json"
    _nested(spark, folder).write.json(path)
    return _without_dots(readers.read_json(spark, path, lines=True))


@query("""SELECT user_id, list_record.event_id, list_record.value FROM (SELECT user_id, struct_pack(event_id := event_id, value := value) AS list_record FROM events)""")
def json_envelope(spark, folder):
    """A folder of lists, of objects that wrap a list, and of JSON lines, one document a file, read back as records."""
    path = scratch_path(spark, "landing") + ".json"
    record = F.struct("user_id", "event_id", "value")
    # a thousand ids per document: the size of a document stays bounded
    part = F.floor(F.col("event_id") / 1000).alias("part")
    documents = scan(spark, folder, "events").groupBy(part).agg(F.collect_list(record).alias("records"))
    shapes = [
        F.to_json(F.struct("records")),
        F.to_json("records"),
        F.to_json(F.struct(F.col("records").alias("data"))),
    ]
    lines = F.array_join(F.transform("records", lambda r: F.to_json(r)), "\n")
    value = F.when(F.col("part") % 4 == 3, lines)
    for i, shape in enumerate(shapes):
        value = value.when(F.col("part") % 4 == i, shape)
    documents.select("part", value.alias("value")).write.partitionBy("part").text(path)
    return readers.read_any(spark, path).select("user_id", "event_id", "value")


@query("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type AS action, CAST(user_id AS VARCHAR) AS run_id
FROM events ORDER BY ts DESC LIMIT 50""")
def recent_events(spark, folder):
    log = scan(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("run_id")
    )
    return runlog.recent_events(log)


# ---------------------------------------------------------------- SQL answers

def _registered(spark: SparkSession, folder: str) -> None:
    sqlapi.register(gold.gold(_signals(spark, folder)))


@query(f"WITH {_SCORECARD} SELECT category, total_orders, total_returns FROM c WHERE total_returns > 0")
def sql_query(spark, folder):
    _registered(spark, folder)
    return sqlapi.query(spark, "SELECT category, total_orders, total_returns FROM category_return_performance WHERE total_returns > 0;")


@query(f"WITH {_TREND} SELECT category, order_month, orders FROM t ORDER BY category, order_month LIMIT 200")
def sql_records(spark, folder):
    """The first 200 records of a longer result, read back from JSON."""
    _registered(spark, folder)
    records = sqlapi.query_records(spark, "SELECT category, order_month, orders FROM monthly_category_trend ORDER BY category, order_month")
    return records.select(F.from_json("record", "category string, order_month string, orders bigint").alias("r")).select("r.*")


@query(f"""WITH {_SCORECARD} SELECT 'Return rate' AS title, 'line' AS chart_type, category AS x, round(return_rate, 6) AS y, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM c""")
def chart_dataset(spark, folder):
    _registered(spark, folder)
    data = sqlapi.chart_data(spark, "SELECT category, return_rate FROM category_return_performance", "category", "return_rate", "line", "Return rate")
    return rounded(data, y=6)


@query(f"WITH {_AT_RISK} SELECT place, category, round(risk, 2) AS projected_revenue_at_risk FROM w WHERE place <= 3")
def report_at_risk(spark, folder):
    golds = gold.gold(_signals(spark, folder))
    return rounded(sqlapi.report(spark, golds)["at_risk"], projected_revenue_at_risk=2)


@query(f"WITH {_SCORECARD} SELECT 'Orders' AS title, 'bar' AS chart_type, category AS x, CAST(total_orders AS DOUBLE) AS y, 'ok' AS status FROM c")
def question_answer(spark, folder):
    """The chart of a follow-up question."""
    golds = gold.gold(_signals(spark, folder))
    sql = "SELECT category, total_orders FROM category_return_performance ORDER BY total_orders DESC"
    return sqlapi.answer(spark, golds, sql, {"sql": sql, "x": "category", "y": "total_orders", "title": "Orders"})["chart"]


# ---------------------------------------------------------------- matching, recall, free text

_CANONICAL = ["widget", "gizmos", "Red Ring", "anvils", "high priority", "not specified", "5-low"]
_NAMES = "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT o_orderpriority AS name FROM orders)"
_INSIDE = "CASE " + " ".join(
    f"WHEN contains(lower(name), '{c.lower()}') OR contains('{c.lower()}', lower(name)) THEN '{c}'" for c in _CANONICAL
) + " END"


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    names = scan(spark, folder, "part").select(F.col("p_name").alias("name"))
    names = names.unionByName(scan(spark, folder, "orders").select(F.col("o_orderpriority").alias("name")))
    return match.fuzzy_match(names, "name", _CANONICAL)


@query()
def fuzzy_match(spark, folder):
    """Part names and order priorities against a list of canonical names."""
    return _matched(spark, folder)


@query(f"""WITH n AS ({_NAMES}), e AS (SELECT name, CASE lower(name) {" ".join(f"WHEN '{c.lower()}' THEN '{c}'" for c in _CANONICAL)} END AS exact, {_INSIDE} AS inside FROM n)
SELECT name, coalesce(exact, inside) AS match, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN inside IS NOT NULL THEN 'inside' END AS tier FROM e""")
def fuzzy_match_by_name(spark, folder):
    """The same without what similarity decides."""
    sure = F.col("tier").isin("exact", "inside")
    return _matched(spark, folder).select("name", F.when(sure, F.col("match")).alias("match"), F.when(sure, F.col("tier")).alias("tier"))


_CENTRES = "c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(e) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


@query(f"""WITH {_CENTRES} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT c.label AS query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), c.v) AS distance,
    row_number() OVER (PARTITION BY c.label ORDER BY list_distance(CAST(embedding AS DOUBLE[]), c.v), vec_id) AS rank
  FROM embeddings, c) WHERE rank <= 3""")
def topk_neighbours(spark, folder):
    """The stored vectors nearest to the centre of each label."""
    store = scan(spark, folder, "embeddings")
    parts = store.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v"))
    queries = [(row.label, row.v) for row in centres.orderBy("label").collect()]
    return rounded(recall.recall(store, queries), distance=6)


@query("""SELECT vec_id, label + 100 AS label FROM embeddings UNION ALL
SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings), label FROM embeddings""")
def memory_upsert(spark, folder):
    """Every stored row is replaced by its newest version, and as many new rows are added."""
    store = scan(spark, folder, "embeddings").select("vec_id", "label")
    top = store.agg(F.max("vec_id")).first()[0] + 1
    added = store.select((F.col("vec_id") + top).alias("vec_id"), "label", F.lit(1).alias("version"))
    older = store.select("vec_id", (F.col("label") + 50).alias("label"), F.lit(1).alias("version"))
    newer = store.select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    updates = added.unionByName(older).unionByName(newer)
    return recall.upsert(store.select("*", F.lit(0).alias("version")), updates, "vec_id", "version").drop("version")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || chr(10) || role ELSE text END AS content FROM conversations""")
def content_text(spark, folder):
    def block(kind, value):
        return F.struct(kind.alias("type"), value.alias("text"))

    extra = F.when(F.col("role") == "assistant", "text").otherwise("thinking")
    blocks = F.array(block(F.lit("thinking"), F.col("role")), block(F.lit("text"), F.col("text")), block(extra, F.col("role")))
    return scan(spark, folder, "conversations").select("conv_id", "turn", tx.content_text(blocks).alias("content"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'whole' WHEN 1 THEN 'fence' WHEN 2 THEN 'array' WHEN 3 THEN 'object' WHEN 4 THEN 'fence' END AS method,
  CASE WHEN doc_id % 6 < 5 THEN text END AS text, CASE WHEN doc_id % 6 < 5 THEN n_chars END AS n_chars FROM documents""")
def extract_json(spark, folder):
    """Each document as JSON inside prose, a fence or nothing readable, and found again."""
    record = F.to_json(F.struct("text", "n_chars"))
    style = F.col("doc_id") % 6
    content = (
        F.when(style == 0, F.concat(F.lit(" \n"), record, F.lit("\n")))
        .when(style == 1, F.concat(F.lit("Here it is:\n```json\n"), record, F.lit("\n```\nDone.")))
        .when(style == 2, F.concat(F.lit("The rows are ["), record, F.lit("] as asked.")))
        .when(style == 3, F.concat(F.lit("The row is "), record, F.lit(" as asked.")))
        .when(style == 4, F.concat(F.lit("{not json}\n```\n"), record, F.lit("```")))
        .otherwise(F.concat(F.lit("Nothing "), F.lit("{here: "), F.col("lang")))
    )
    found = scan(spark, folder, "documents").select("doc_id", style.alias("style"), tx.extract_json(content).alias("found"))
    place = F.when(F.col("found.method") == "array", "$[0]").otherwise("$")
    parsed = F.from_json(F.when(place == "$[0]", F.expr("substring(found.json, 2, length(found.json) - 2)")).otherwise(F.col("found.json")), "text string, n_chars bigint")
    return found.select("doc_id", F.col("found.method").alias("method"), parsed["text"].alias("text"), parsed["n_chars"].alias("n_chars"))
