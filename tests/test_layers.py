"""Rules, Bronze, Silver, Signal and the whole chain, on small hand-written tables."""

import pytest
from pyspark.sql import functions as F

from ebbmark.operators import layers, merge, rules
from ebbmark.operators.rules import Rule
from ebbmark.operators.signal import SIGNAL_COLUMNS, join_keys, resolve_roles, signal, signal_from_tables
from ebbmark.plans.medallion import landing_to_gold
from ebbmark.plans.sqlapi import register_layer, run_sql
from ebbmark.sources.runlog import read_log


def rule(table, source, target, kind, logic=""):
    return Rule("a", table, source, "b", table, target, kind, logic)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [("O1", "2025-01-05", "C1", "P1", 2, 100.0, "web"), ("O2", "2025-01-20", "C2", "P2", 1, 50.0, "mobile_app"),
         ("O3", "2025-02-01", "C1", "P1", 1, 80.0, "web"), ("O4", "bad date", "C3", "P9", 1, 10.0, None)],
        "order_id string, order_date string, customer_id string, product_id string, quantity int, order_amount double, channel string",
    )


@pytest.fixture
def returns(spark):
    return spark.createDataFrame(
        [("R1", "O1", "2025-01-10", "wrong_size", "90.5"), ("R2", "O3", "2025-02-11", "defective", "oops")],
        "return_id string, order_id string, return_date string, return_reason string, refund_amount string",
    )


@pytest.fixture
def products(spark):
    return spark.createDataFrame([("P1", "a1", "Apparel"), ("P2", "b1", "Books")], "product_id string, sub_category string, category string")


# ---------------------------------------------------------------- rules

def test_rules_round_trip_and_approval(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules.save_rules(spark, [rule("orders", "a", "b", "direct", 'says "x", y'), Rule(target_table="orders")], path)
    back = rules.read_rules(spark, path)
    assert back[0] == rule("orders", "a", "b", "direct", 'says "x", y')
    table = spark.read.csv(path, header=True)
    assert table.columns == ["approved", *rules.RULE_COLUMNS]
    marked = spark.createDataFrame([("False", "a"), ("true", "b"), (None, "c"), ("FALSE", "d")], "approved string, target_table string")
    assert [r.target_table for r in rules.approved(marked).collect()] == ["b", "c"]
    assert rows(rules.rules_summary(marked)) == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]


# ---------------------------------------------------------------- Bronze and Silver

def test_bronze_maps_casts_and_recovers_keys(spark, orders):
    notes = layers.LayerNotes()
    out = layers.bronze(
        {"orders": orders},
        [rule("orders", "order_date", "day", "indirect", "datetime"), rule("orders", "quantity", "q", "indirect", "float"),
         rule("orders", "channel", "q", "direct"), rule("orders", "absent", "x", "direct"), rule("orders", None, "_load_timestamp", "metadata"),
         rule("orders", None, "_other", "metadata"), rule("orders", None, "_source_file", "metadata"), rule("inventory", "a", "b", "direct")],
        run_ts="T", sources={"orders": "/landing/orders.csv"}, notes=notes,
    )
    df = out["orders"]
    assert df.columns == ["day", "q", "_load_timestamp", "_source_file", "order_id", "customer_id", "product_id"]
    assert notes.recovered == {"orders": ["order_id", "customer_id", "product_id"]} and notes.skipped == ["inventory"]
    first = df.where("order_id = 'O1'").first()
    assert (str(first.day), first.q, first._load_timestamp, first._source_file) == ("2025-01-05 00:00:00", "web", "T", "/landing/orders.csv")


def test_bronze_tolerates_table_names_that_drift(spark, orders):
    assert list(layers.bronze({"orders": orders}, [rule("order_transactions", "order_id", "order_id", "direct")])) == ["orders"]


def test_bronze_without_any_match_names_both_sides(spark, orders):
    with pytest.raises(ValueError, match="inventory.*orders"):
        layers.bronze({"orders": orders}, [rule("inventory", "a", "b", "direct")])
    assert layers.bronze({"orders": orders}, []) == {}


def test_two_targets_for_one_table_are_an_error(spark, orders):
    with pytest.raises(ValueError, match="both mean"):
        layers.bronze({"orders": orders}, [rule("orders", "a", "b", "direct"), rule("orders_all", "a", "b", "direct")])


def test_recovery_skips_surrogate_keys():
    assert rules.missing_business_keys(["pk_orders_silver_id", "order_date"], ["order_date"]) == []
    assert rules.missing_business_keys(["order_id", "order_date"], ["order_date"]) == ["order_id"]


def test_silver_dedup_keeps_the_marked_column(spark):
    df = spark.createDataFrame([("O1", "2025-01-01"), ("O2", "2025-01-02"), ("O2", "2025-01-02")], "order_id string, order_date string")
    out = layers.silver({"orders": df}, [rule("orders", None, "pk_orders_silver_id", "surrogate_key"),
                                         rule("orders", "order_id", "order_id", "dedup", "on order_id"),
                                         rule("orders", "order_date", "order_date", "date_standardize")])["orders"]
    assert out.columns == ["pk_orders_silver_id", "order_id", "order_date"]
    assert rows(out) == [(1, "O1", "2025-01-01"), (2, "O2", "2025-01-02")]


def test_silver_statistics_come_from_the_source_before_dropping(spark):
    df = spark.createDataFrame([("O1", 10.0, "a"), ("O2", 20.0, None), ("O3", None, "c")], "order_id string, amount double, day string")
    out = layers.silver({"orders": df}, [rule("orders", "amount", "amount", "null_handling", "fill:mean"),
                                         rule("orders", "day", "day", "null_handling", "Drop ")])["orders"]
    assert out.columns == ["pk_orders_silver_id", "amount", "day", "order_id"]
    assert rows(out) == [(1, 10.0, "a", "O1"), (2, 15.0, "c", "O3")]


def test_silver_recovered_keys_take_part_in_dedup(spark):
    df = spark.createDataFrame([("O1", "x"), ("O2", "x")], "order_id string, v string")
    out = layers.silver({"orders": df}, [rule("orders", "v", "v", "dedup")])["orders"]
    assert out.count() == 2


# ---------------------------------------------------------------- Signal

def test_signal_columns_and_values(spark, orders, returns, products):
    out = signal(orders, returns, products)
    assert tuple(out.columns) == SIGNAL_COLUMNS
    got = {r.order_id: r for r in out.collect()}
    o1 = got["O1"]
    assert (o1.category, o1.sub_category, o1.is_returned, o1.days_to_return, o1.revenue_erosion, o1.net_revenue, o1.order_month) == (
        "Apparel", "a1", 1, 5, 90.5, 9.5, "2025-01-01")
    assert (got["O2"].is_returned, got["O2"].days_to_return, got["O2"].revenue_erosion, got["O2"].return_reason) == (0, None, 0.0, None)
    assert (got["O3"].revenue_erosion, got["O3"].net_revenue, got["O3"].days_to_return) == (0.0, 80.0, 10)
    assert (got["O4"].category, got["O4"].order_month) == (None, None)


def test_signal_without_returns_and_products(spark, orders):
    row = signal(orders).where("order_id = 'O1'").first()
    assert (row.category, row.sub_category, row.is_returned, row.revenue_erosion, row.net_revenue) == ("unknown", "unknown", 0, 0.0, 100.0)


def test_signal_keeps_every_return_of_an_order(spark, orders, returns, products):
    more = returns.unionByName(spark.createDataFrame([("R9", "O1", "2025-01-08", "damaged", "5")], returns.schema))
    assert signal(orders, more, products).where("order_id = 'O1'").count() == 2
    one = signal(orders, more, products, collapse_returns=True).where("order_id = 'O1'").collect()
    assert [(r.revenue_erosion, r.return_reason, r.days_to_return) for r in one] == [(95.5, "damaged", 3)]


def test_signal_join_keys():
    assert join_keys(["order_id", "customer_id", "product_id"], ["customer_id", "order_id"], "order_id") == ("order_id", "order_id")
    assert join_keys(["pk_orders_silver_id", "the_order_id_text"], ["order_id"], "order_id") == ("the_order_id_text", "order_id")
    with pytest.raises(ValueError, match="Silver rules dropped"):
        join_keys(["pk_orders_silver_id"], ["order_id"], "order_id")


def test_roles_by_name(spark, orders, returns, products):
    roles = resolve_roles({"order_transactions": orders, "return_events": returns, "product_catalog": products})
    assert roles["orders"] is orders and roles["returns"] is returns and roles["products"] is products
    roles = resolve_roles({"order_returns": returns, "order_transactions": orders})
    assert roles["orders"] is orders and roles["returns"] is returns
    with pytest.raises(ValueError, match="No orders table"):
        resolve_roles({"returns": returns, "products": products})
    assert signal_from_tables({"orders": orders}).count() == 4


# ---------------------------------------------------------------- joins

def test_merge_left_matches_null_keys_and_suffixes_names(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2"), (3, "l3")], "k int, v string")
    right = spark.createDataFrame([(1, "r1"), (None, "r2"), (1, "r3")], "k int, v string")
    out = merge.merge_left(left, right, "k", "k", "_r")
    assert out.columns == ["k", "v", "v_r"]
    expected = left.toPandas().merge(right.toPandas(), on="k", how="left", suffixes=("", "_r"))
    assert rows(out) == sorted(((None if k != k else int(k), v, None if w != w else w) for k, v, w in expected.itertuples(index=False)), key=repr)
    assert merge.merge_left(left, right, "k", "k", null_safe=False).where("v = 'l2' and v_right is null").count() == 1


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("hot", [[1], [1, None, 77], [None], [5, 8]])
def test_salted_merge_gives_the_plain_result(spark, hot, null_safe):
    left = spark.range(60).select(F.when(F.col("id") % 5 != 0, F.col("id") % 9).cast("int").alias("k"), F.col("id").alias("l"))
    right = spark.range(300).select(F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 7)).cast("int").alias("k"), F.col("id").alias("r"))
    plain = merge.merge_left(left, right, "k", "k", null_safe=null_safe)
    salted = merge.merge_left(left, right, "k", "k", null_safe=null_safe, hot=hot, salts=4)
    assert rows(salted) == rows(plain)


def test_hot_keys_finds_frequent_values_and_null(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    assert merge.hot_keys(df, "k", share=0.1) == ["hot", None]
    assert merge.hot_keys(df.where("false"), "k") == []


# ---------------------------------------------------------------- whole chain

BRONZE = [rule("orders", c, c, "indirect", h) for c, h in (("order_id", "text"), ("order_date", "datetime"), ("customer_id", "text"), ("product_id", "text"), ("quantity", "integer"), ("order_amount", "float"), ("channel", "text"))] + [
    rule("orders", None, "_load_timestamp", "metadata")] + [
    rule("returns", c, c, "indirect", h) for c, h in (("return_id", "text"), ("return_date", "datetime"), ("return_reason", "text"), ("refund_amount", "float"))] + [
    rule("products", c, c, "direct") for c in ("product_id", "sub_category", "category")]
SILVER = [rule("orders", "order_id", "order_id", "dedup"), rule("orders", "order_date", "order_date", "date_standardize"), rule("orders", "order_amount", "order_amount", "null_handling", "fill:0"),
          rule("orders", "channel", "channel", "text_normalize", "lower, strip"),
          rule("returns", "return_date", "return_date", "date_standardize"), rule("returns", "refund_amount", "refund_amount", "passthrough"), rule("returns", "return_reason", "return_reason", "passthrough"),
          rule("products", "category", "category", "passthrough"), rule("products", "sub_category", "sub_category", "text_normalize", "upper")]


def check_invariants(signals, scorecard, trend):
    s = signals.collect()
    assert {r.is_returned for r in s} == {0, 1}
    assert all(r.net_revenue <= r.order_amount for r in s)
    assert all(r.days_to_return is not None and r.days_to_return >= 0 for r in s if r.is_returned)
    score, months = scorecard.collect(), trend.collect()
    assert sum(r.total_orders for r in score) == len(s) == sum(r.orders for r in months)
    assert sum(r.total_returns for r in score) == sum(r.is_returned for r in s) == sum(r.returns for r in months)
    assert all(0 <= r.return_rate <= 1 for r in score + months)
    assert [r.pk_gold_id for r in months] == list(range(1, len(months) + 1))
    assert score[-1].category is None or None not in [r.category for r in score]


def test_whole_chain_lazy(spark, orders, returns, products):
    out = landing_to_gold(spark, {"orders": orders, "returns": returns, "products": products}, BRONZE, SILVER)
    check_invariants(out["order_line_signals"], out["category_return_performance"], out["monthly_category_trend"])


def test_whole_chain_from_files_with_layers_and_log(spark, orders, returns, products, tmp_path):
    landing = tmp_path / "landing"
    orders.write.csv(str(landing / "orders.csv"), header=True)
    landing.joinpath("returns.json").write_text('{"records": [{"return_id": "R1", "order_id": "O1", "return_date": "2025-01-10", "return_reason": "wrong_size", "refund_amount": 90.5}]}')
    products.write.parquet(str(landing / "products.parquet"))
    out_dir = str(tmp_path / "out")
    paths = [str(landing / name) for name in ("orders.csv", "returns.json", "products.parquet")]
    out = landing_to_gold(spark, paths, BRONZE, SILVER, out=out_dir, run_id="r1")
    check_invariants(out["order_line_signals"], out["category_return_performance"], out["monthly_category_trend"])
    assert spark.read.parquet(out_dir + "/r1/silver/orders_silver").columns[0] == "pk_orders_silver_id"
    assert "_load_timestamp" in out["orders_bronze"].columns
    catalog = register_layer(spark, [out_dir + "/r1/gold/category_return_performance", out_dir + "/r1/gold/monthly_category_trend"])
    assert catalog["monthly_category_trend"] == out["monthly_category_trend"].columns
    assert run_sql(spark, "SELECT count(*) AS n FROM category_return_performance") == '[{"n":3}]'
    log = read_log(spark, out_dir + "/log", "r1").collect()
    written = {r.details["table"]: r.details for r in log if r.action == "table_written"}
    assert written["order_line_signals"]["rows"] == "4" and written["order_line_signals"]["return_rate"] == "0.25"
    assert written["orders"]["rows"] == "4"
    assert any(r.action == "business_keys_recovered" and r.details["table"] == "returns" for r in log)
    assert read_log(spark, out_dir + "/log", "other").count() == 0
