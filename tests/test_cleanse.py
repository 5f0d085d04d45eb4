"""NULL filling, duplicates, surrogate keys."""

import random
import statistics
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal
from random import Random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbmark.operators import cleanse


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fill_mean_and_default(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "b")], "n double, t string")
    assert rows(cleanse.fill_nulls(df, {"n": "fill:mean", "t": ""})) == rows(spark.createDataFrame([(1.0, "a"), (2.0, "unknown"), (1.5, "b")]))


def test_fill_zero_mode_and_median(spark):
    df = spark.createDataFrame([(1, 5, "x", 10.0), (None, 5, "y", 2.0), (3, None, "y", None), (4, 7, None, 4.0)], "a int, b int, c string, d double")
    out = cleanse.fill_nulls(df, {"a": "zero", "b": "fill: mode", "c": "mode", "d": "median"})
    assert rows(out) == rows(spark.createDataFrame([(1, 5, "x", 10.0), (0, 5, "y", 2.0), (3, 5, "y", 4.0), (4, 7, "y", 4.0)]))


def test_fill_mode_takes_smallest_of_equals_and_unknown_for_nothing(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "t string, u string")
    assert {r.t for r in cleanse.fill_nulls(df, {"t": "mode"}).collect()} == {"a", "b"}
    assert cleanse.column_modes(df, ["t"]) == {"t": "a"}
    assert {r.u for r in cleanse.fill_nulls(df, {"u": "mode"}).collect()} == {"unknown"}


def test_fill_mean_of_whole_numbers_gives_fractions(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n bigint")
    assert [r.n for r in cleanse.fill_nulls(df, {"n": "mean"}).orderBy("n").collect()] == [1.0, 1.5, 2.0]


def test_fill_text_into_numbers_is_an_error_before_any_job(spark):
    df = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(ValueError, match="unknown"):
        cleanse.fill_nulls(df, {"n": "fill:unknown"})


def test_numeric_strategy_on_text_falls_back(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert {r.t for r in cleanse.fill_nulls(df, {"t": "mean"}).collect()} == {"a", "unknown"}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1001, 5000])
def test_median_is_exact(spark, size):
    rng = random.Random(size)
    columns = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(size)],
        "hot": [7.0 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(size)],
        "skewed": [10.0 ** rng.uniform(-12, 12) for _ in range(size)],
        "few": [float(rng.randrange(3)) for _ in range(size)],
        "huge": [rng.choice([-1.7e308, 1.6e308, 0.0]) for _ in range(size)],
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    got = cleanse.column_medians(df, list(columns))
    expected = {c: statistics.median(v) for c, v in columns.items()}
    assert got == expected


def test_median_skips_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (4.0, None)], "a double, b double")
    assert cleanse.column_medians(df, ["a", "b"]) == {"a": 2.5, "b": None}


def test_drop_copies_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("O1", None), ("O1", None), ("O2", "d"), ("O2", "e")], "k string, v string")
    assert rows(cleanse.drop_copies(df)) == [("O1", None), ("O2", "d"), ("O2", "e")]


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 2), (1, "c", 2), (2, "z", 9)], "k int, v string, at int")
    assert rows(cleanse.keep_first(df, ["k"], ["at"])) == [(1, "a", 2), (2, "z", 9)]


def test_surrogate_key_is_first_column_and_counts_from_one(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "x int")
    out = cleanse.surrogate_key(df, "pk", ["x"])
    assert out.columns == ["pk", "x"]
    assert rows(out) == [(1, 10), (2, 20), (3, 30)]


@pytest.mark.parametrize("total_order", [True, False])
def test_surrogate_key_is_dense_over_many_partitions(spark, total_order):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("y")).repartition(16)
    out = cleanse.surrogate_key(df, "pk", ["y", "x"], total_order=total_order).collect()
    ordered = sorted(out, key=lambda r: (r.y is None, r.y or 0, r.x))
    assert [r.pk for r in ordered] == list(range(1, 5001))


def test_surrogate_key_numbers_each_copy(spark):
    df = spark.range(3000).select(F.lit("same").alias("x")).repartition(8)
    out = cleanse.surrogate_key(df, "pk", ["x"])
    assert sorted(r.pk for r in out.collect()) == list(range(1, 3001))


def test_surrogate_key_spreads_a_hot_value(spark):
    df = spark.range(20000).select(F.lit(1).alias("x")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = cleanse.surrogate_key(df, "pk", ["x"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out.inputFiles()) == 8  # one file per task of the range shuffle
    assert out.agg(F.countDistinct("pk").alias("n")).first().n == 20000


def test_surrogate_key_with_several_files_per_task(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x")).repartition(4)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    out = cleanse.surrogate_key(df, "pk", ["x"], total_order=True)
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert out.where("pk != x").count() == 0 and out.count() == 1000


def test_drop_nulls_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert rows(cleanse.drop_nulls(df, ["a", "zzz"])) == [(1, None), (3, 4)]


def test_statistics_of_extreme_values(spark):
    spread = [10.0**e for e in range(-300, 301)]
    cases = [[0.0, 5e-324], [5e-324, 1e-323, 1.5e-323], spread, [-x for x in spread] + spread[:50], [1e300, *map(float, range(1001))], [-1.0, 0.0, 1.0, 1.0]]
    for case in cases:
        random.Random(1).shuffle(case)
        got = cleanse.column_medians(spark.createDataFrame([(x,) for x in case], "x double"), ["x"])["x"]
        assert got == statistics.median(case)


def test_modes_of_columns_of_different_types(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "b", None), (2, "a", None), (1, "a", None)], "i int, s string, d date")
    assert cleanse.column_modes(df, ["i", "s", "d"]) == {"i": 1, "s": "a", "d": None}


def _brute_mode(values):
    counts = Counter(v for v in values if v is not None and v == v)
    return min(counts, key=lambda v: (-counts[v], v), default=None)


@pytest.mark.parametrize("tracked", [8, 64, cleanse.TRACKED])
def test_modes_by_sketch_and_exact_counts(spark, monkeypatch, tracked):
    """Hot values, ties, values seen once, missing ones and all types; sketches that are too small fall back."""
    monkeypatch.setattr(cleanse, "TRACKED", tracked)
    dice = Random(tracked)
    day, moment = date(2024, 1, 1), datetime(2024, 1, 1)
    made = [
        (
            7 if dice.random() < 0.4 else dice.randrange(10**6),
            dice.choice("ab"),
            str(dice.randrange(10**9)),
            dice.choice([float("nan"), -0.0, 0.0, 1.5, None]),
            Decimal(dice.randrange(40)) / 100,
            day + timedelta(days=min(dice.randrange(50), dice.randrange(50))),
            moment + timedelta(hours=dice.randrange(3)),
            dice.random() < 0.5,
            None,
            b"x" * dice.randrange(3),
            dice.randrange(200),
        )
        for _ in range(3000)
    ]
    kinds = "hot long, tie string, once string, f double, dec decimal(9,2), d date, t timestamp, b boolean, none string, bin binary, flat int"
    df = spark.createDataFrame(made, kinds).repartition(5)
    got = cleanse.column_modes(df, df.columns)
    assert {c: bytes(v) if c == "bin" else v for c, v in got.items()} == {c: _brute_mode([r[i] for r in made]) for i, c in enumerate(df.columns)}
    assert str(got["f"]) == str(abs(got["f"]))


def test_modes_count_every_value_only_where_the_sketch_proves_nothing(spark, monkeypatch):
    counted = []
    plain = cleanse._counted_modes
    monkeypatch.setattr(cleanse, "_counted_modes", lambda df, values: counted.append(sorted(values)) or plain(df, values))
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, -1, id) as hot", "id as once", "id % 4 as few")
    assert cleanse.column_modes(df, ["hot", "once", "few"]) == {"hot": -1, "once": 0, "few": 0}
    assert counted == [["few", "hot"], ["once"]]


def test_modes_that_tie_are_all_named(spark, monkeypatch):
    monkeypatch.setattr(cleanse, "TRACKED", 200)
    rows = [("b",)] * 300 + [("a",)] * 300 + [(f"x{i}",) for i in range(2000)]
    Random(5).shuffle(rows)
    assert cleanse.column_modes(spark.createDataFrame(rows, "v string").repartition(9), ["v"]) == {"v": "a"}


def test_filling_of_a_rule():
    from ebbmark.operators.cleanse import Fill

    named = {"fill:mean": Fill.MEAN, " Fill: Median ": Fill.MEDIAN, "mode": Fill.MODE, "fill:0": Fill.ZERO, "ZERO": Fill.ZERO, "fill:unknown": Fill.TEXT, "": Fill.TEXT, None: Fill.TEXT, "other: mean": Fill.TEXT, "the mean": Fill.TEXT}
    assert {logic: Fill.of_rule(logic) for logic in named} == named


@pytest.mark.parametrize("brackets", [(0.0,), (0.002, 0.05)])
def test_medians_where_the_bracket_misses(spark, monkeypatch, brackets):
    """A sketch too coarse for its bracket costs another scan, never the result; a good one needs one scan for all columns."""
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1e6), rng.choice([1.0, 2.0, 3.0]), rng.lognormvariate(0, 9) if rng.random() < 0.9 else None) for _ in range(5_001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(8)
    scans, counted = [], cleanse._bracket_counts
    monkeypatch.setattr(cleanse, "BRACKETS", brackets)
    monkeypatch.setattr(cleanse, "SKETCH", 3 if brackets == (0.0,) else 2_000)
    monkeypatch.setattr(cleanse, "_bracket_counts", lambda *args: scans.append(1) or counted(*args))
    due = {c: statistics.median([r[i] for r in rows if r[i] is not None]) for i, c in enumerate("abc")}
    assert cleanse.column_medians(df, ["a", "b", "c"]) == due
    assert len(scans) == (2 if brackets == (0.0,) else 1)


def test_distinct_surrogate_key(spark):
    rng = Random(5)
    some = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), rng.choice([None, 1, 2])) for _ in range(300)]
    flat = [(f"k{i % 9000}", float(i % 9000), 1) for i in range(10000)]
    hot = [("hot", 1.0, 1)] * 3000 + flat[:2000]
    order = ["c", "a", "b"]
    for data in (some, flat, hot, []):
        df = spark.createDataFrame(data, "a string, b double, c int").repartition(5)
        due = cleanse.surrogate_key(cleanse.drop_copies(df), "k", order, total_order=True)
        for written in (False, True):
            assert repr(rows(cleanse.distinct_surrogate_key(df, "k", order, written))) == repr(rows(due))


def test_numbering_moves_the_rows_once(spark):
    df = spark.range(5000).selectExpr("cast(id % 700 as string) a", "cast(id % 3 as double) b")
    ranged = cleanse._sorted_distinct(df, ["a", "b"])
    ranged.collect()
    plan = ranged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == plan.count("Exchange rangepartitioning") == 1
    # the sizes of the files go to each task, whatever Spark takes them to be
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = cleanse.surrogate_key(df, "k", ["a", "b"])
        assert "BroadcastHashJoin" in numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
