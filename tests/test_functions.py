"""Casts, dates, text clean-up, content blocks and JSON extraction."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions import casts, dates, measures, text
from ebbmark.functions.names import find_column, table_name, table_name_column


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)


def apply(df, build):
    return [row.out for row in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def cast(spark, values, hint, kind="string"):
    df = column(spark, values, kind)
    return apply(df, lambda v: casts.cast_lenient(v, df.schema["v"].dataType, hint))


def test_cast_integer(spark):
    assert cast(spark, ["1", "2", None], "integer") == [1, 2, None]
    assert cast(spark, ["12.0", " 7 ", "1e3", "1.5", "x", "9007199254740993"], "int") == [12, 7, 1000, None, None, 9007199254740993]


def test_cast_float(spark):
    assert cast(spark, ["1.5", "2.25"], "float") == [1.5, 2.25]
    # what Java reads as a number but a data file does not mean as one
    assert cast(spark, ["1d", "0x10", "NaN", "Infinity", "abc", " 2 ", ".5", "1e2"], "decimal") == [None] * 5 + [2.0, 0.5, 100.0]


def test_cast_nan_is_null(spark):
    assert cast(spark, [1.5, float("nan"), float("inf")], "double", "double") == [1.5, None, None]


def test_cast_datetime(spark):
    assert cast(spark, ["2025-01-15", "bad"], "datetime") == [datetime(2025, 1, 15), None]


def test_cast_number_to_datetime_is_nanoseconds(spark):
    assert cast(spark, [1_736_899_200_000_000_000, 1_999], "datetime", "bigint") == [datetime(2025, 1, 15), datetime(1970, 1, 1, 0, 0, 0, 1)]


def test_cast_text(spark):
    assert cast(spark, [1, None], "text", "bigint") == ["1", None]


@pytest.mark.parametrize(
    "hint, kind",
    [("integer", "integer"), ("Int64", "integer"), ("cast to float", "float"), ("decimal", "float"), ("datetime", "timestamp"),
     ("maintain as text", "text"), ("update", "text"), ("", "text"), (None, "text"), ("float64", "float"), ("to_datetime", "timestamp")],
)
def test_cast_kind_goes_by_whole_words(hint, kind):
    assert casts.cast_kind(hint) == kind


def test_standard_date_reads_mixed_formats(spark):
    values = ["01/15/2025", "2025-02-20", "25/12/2024", "2025-02-20T10:30:00", "Mar 5, 2025", "20250115", "5 January 2025", "10:30", "2025-13-01", None]
    expected = ["2025-01-15", "2025-02-20", "2024-12-25", "2025-02-20", "2025-03-05", "2025-01-15", "2025-01-05", None, None, None]
    assert apply(column(spark, values), lambda v: dates.standard_date(dates.parse_timestamp(v))) == expected


def test_standard_date_agrees_with_pandas(spark):
    rng = random.Random(3)
    days = [datetime(2020, 1, 1) + pd.Timedelta(days=rng.randrange(2000)) for _ in range(300)]
    written = [day.strftime(rng.choice(["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%b %d, %Y", "%B %d, %Y", "%Y%m%d", "%Y/%m/%d"])) for day in days]
    expected = list(pd.to_datetime(pd.Series(written), errors="coerce", format="mixed").dt.strftime("%Y-%m-%d"))
    assert apply(column(spark, written), lambda v: dates.standard_date(dates.parse_timestamp(v))) == expected


def test_days_between_rounds_down(spark):
    df = spark.createDataFrame(
        [("2025-01-01 23:00:00", "2025-01-02 01:00:00"), ("2025-01-02 01:00:00", "2025-01-01 23:00:00"), ("2025-01-01 00:00:00", "2025-01-04 00:00:00")],
        "a string, b string",
    )
    out = df.select(dates.days_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("d")).collect()
    assert [r.d for r in out] == [0, -1, 3]


def test_month_after(spark):
    assert apply(column(spark, ["2025-11-01"]), lambda v: F.concat_ws(",", *[dates.month_after(v, F.lit(i)) for i in (1, 2, 3)])) == ["2025-12-01,2026-01-01,2026-02-01"]


def test_normalize_text(spark):
    assert apply(column(spark, [" Widget A "]), lambda v: text.normalize_text(v, "lowercase, strip")) == ["widget a"]
    assert apply(column(spark, ["\t a b\n"]), lambda v: text.normalize_text(v, "trim")) == ["a b"]
    samples = ["men's non-fiction", "été à PARIS", "x1y2 z", "straße ßa", ""]
    assert apply(column(spark, samples), lambda v: text.normalize_text(v, "title case")) == [s.title() for s in samples]
    assert apply(column(spark, ["aB", None]), lambda v: text.normalize_text(v, "upper")) == ["AB", None]


def test_content_text(spark):
    blocks = [[("thinking", "no"), ("text", "[1]"), ("text", None), ("text", "end")], [], None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, v array<struct<type:string,text:string>>")
    assert apply(df, text.content_text) == ["[1]\n\nend", "", None]


def python_extract(content):
    """What a reader following the same order of places would find."""
    content = content.strip()
    places = [content]
    if content.count("```") >= 2:
        inner = content.split("```", 2)[1]
        places.append(inner.removeprefix("json").strip())
    for a, b in ("[]", "{}"):
        if a in content and b in content and content.rfind(b) > content.find(a):
            places.append(content[content.find(a): content.rfind(b) + 1])
    for place in places:
        try:
            return json.loads(place)
        except ValueError:
            continue
    return None


def test_extract_json(spark):
    samples = [
        '{"a": 1}', ' [1, 2] ', 'Sure:\n```json\n[{"x": 1}]\n```\nDone', '```\n{"y": "[]"}\n```', 'rows [1, 2] end', 'object {"k": [1, 2]} end',
        '{"a": 1} and then [1, 2]', '{"a": 1} trailing', "1 2", "plain words", "", "[1, 2", '```json\nnot json\n``` but {"z": 3}', '1] [2', '"text"', "12", "a ] b [ c",
    ]
    out = apply(column(spark, samples), text.extract_json)
    assert [None if o is None else json.loads(o.json) for o in out] == [python_extract(s) for s in samples]
    assert [out[i].method for i in (0, 2, 4, 7)] == ["whole", "fence", "array", "object"]


def test_table_names(spark):
    paths = ["/landing/Orders.csv", "file:/x/orders_bronze.parquet", "returns_silver", "/a/b/products.xlsx/"]
    assert [table_name(p) for p in paths] == ["orders", "orders", "returns", "products"]
    assert apply(column(spark, paths), table_name_column) == ["orders", "orders", "returns", "products"]


def test_find_column_prefers_the_exact_name():
    assert find_column(["sub_category", "category"], "category") == "category"
    assert find_column(["discount_amount", "order_amount"], "order_amount", "amount") == "order_amount"
    assert find_column(["id", "Total_Amount"], "order_amount", "amount") == "Total_Amount"
    assert find_column(["a"], "b") is None


def test_measures(spark):
    rates = apply(column(spark, [-0.2, 0.4, 1.7, None], "double"), measures.clip_rate)
    assert rates == [0.0, 0.4, 1.0, None]
    labels = apply(column(spark, [0.0011, -0.0011, 0.001, None], "double"), measures.direction)
    assert labels == ["rising", "falling", "flat", "flat"]
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r.x for r in df.select(measures.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 0.25]


def test_money_sum_is_exact_and_zero_for_nothing(spark):
    values = [0.1] * 1000 + [-0.3] * 10 + [1e12, None, -2.0625]
    out = column(spark, values, "double").agg(measures.money_sum(F.col("v")).alias("s")).first().s
    assert out == 1e12 + 100 - 3 - 2.0625
    assert column(spark, [None], "double").agg(measures.money_sum(F.col("v")).alias("s")).first().s == 0.0


def test_null_tokens(spark):
    out = apply(column(spark, ["NA", "n/a", "", "x", "null", "None"]), casts.blank_null_tokens)
    assert out == [None, None, None, "x", None, None]
    assert isinstance(T.StringType(), T.DataType)


def test_money_sums_keep_fine_and_huge_amounts(spark):
    from ebbmark.functions.measures import money_sum

    fine = spark.range(100_000).select(F.lit(0.00004).alias("v"))
    assert abs(fine.agg(money_sum(F.col("v"))).first()[0] - 4.0) < 1e-9
    mixed = spark.createDataFrame([(1e19,), (None,), (2.25,), (-0.00001,)], "v double")
    assert mixed.agg(money_sum(F.col("v"))).first()[0] == 1e19
    assert mixed.limit(0).agg(money_sum(F.col("v"))).first()[0] == 0.0


def test_more_date_formats(spark):
    wanted = {
        "01/15/25": "2025-01-15 00:00:00", "01/15/75": "1975-01-15 00:00:00", "01/15/2025 3:04 PM": "2025-01-15 15:04:00",
        "2025-01-15 03:04 PM": "2025-01-15 15:04:00", "15.01.2025": "2025-01-15 00:00:00", "Jan 15, 2025 10:00": "2025-01-15 10:00:00",
        "2025.01.15": "2025-01-15 00:00:00", "20250115T101112": "2025-01-15 10:11:12", "2025-01": "2025-01-01 00:00:00",
        "15-Jan-2025": "2025-01-15 00:00:00", "15-Foo-2025": None,
    }
    df = spark.createDataFrame([(k,) for k in wanted], "t string")
    assert {r.t: r.got for r in df.select("t", dates.parse_timestamp(F.col("t")).cast("string").alias("got")).collect()} == wanted


def test_found_json_keeps_its_characters(spark):
    content = 'It is {"b": 12345678901234567890123456789012345678901234567890, "a": 1.50} now'
    found = spark.createDataFrame([(content,)], "t string").select(text.extract_json(F.col("t")).alias("x")).first().x
    assert found.json == content[6:-4]
