"""Orders, returns and products as views of a TPC-H-like star schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def line_id():
    return F.concat_ws("-", *_LINE_KEY)


def products(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").alias("cost_price"),
    )


def orders(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    lines, heads = lines or scan(spark, folder, "lineitem"), scan(spark, folder, "orders")
    return lines.join(heads, lines.l_orderkey == heads.o_orderkey).select(
        line_id().alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("order_amount"),
        F.col("o_orderpriority").alias("channel"),
    )


def returns(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    return (lines or scan(spark, folder, "lineitem")).where("l_returnflag = 'R'").select(
        F.concat(F.lit("R-"), line_id()).alias("return_id"),
        line_id().alias("order_id"),
        F.col("l_shipdate").alias("return_date"),
        F.col("l_linestatus").alias("return_reason"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("refund_amount"),
    )


def views(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    lines = scan(spark, folder, "lineitem")
    return {
        "orders": orders(spark, folder, lines),
        "returns": returns(spark, folder, lines),
        "products": products(spark, folder),
    }
