"""SQL answers, name matching and nearest vectors."""

import difflib
import json
import random

import numpy as np
import pytest

from ebbmark.operators.match import best_match, fuzzy_match
from ebbmark.operators.similar import matching_characters, most_similar
from ebbmark.operators.recall import recall, upsert
from ebbmark.plans import sqlapi

TABLES = ["orders", "returns", "products"]


@pytest.fixture
def cards(spark):
    card = spark.createDataFrame([("a", 0.5, 0.2, 5.0, 1.0, 2.0), ("b", 0.1, 0.4, 7.0, 3.0, 4.0)],
                                 "category string, return_rate double, revenue_erosion_pct double, avg_days_to_return double, total_refunds double, gross_revenue double")
    months = [("a", f"2025-0{m}-01", 0.1 * m, 100.0 - m) for m in range(1, 5)] + [("b", f"2025-0{m}-01", 0.1, 100.0) for m in range(1, 5)]
    trend = spark.createDataFrame(months, "category string, order_month string, return_rate double, net_revenue double")
    return {"category_return_performance": card, "monthly_category_trend": trend}


def test_register_and_run(spark, cards):
    assert sqlapi.register(cards)["monthly_category_trend"] == ["category", "order_month", "return_rate", "net_revenue"]
    out = json.loads(sqlapi.run_sql(spark, "WITH x AS (SELECT * FROM category_return_performance) SELECT category FROM x ORDER BY return_rate DESC; "))
    assert out == [{"category": "a"}, {"category": "b"}]
    assert len(json.loads(sqlapi.run_sql(spark, "SELECT id -- trailing note\nFROM range(1000) -- end"))) == 200


@pytest.mark.parametrize("sql", ["SELECT * FROM not_there", "SELEC 1", "DROP VIEW monthly_category_trend", "CREATE TABLE t AS SELECT 1", "SELECT 1/0 AS x", ""])
def test_failures_and_commands_become_errors(spark, cards, sql):
    sqlapi.register(cards)
    assert list(json.loads(sqlapi.run_sql(spark, sql))) == ["error"]
    assert spark.catalog.tableExists("monthly_category_trend")


def test_chart_data(spark, cards):
    sqlapi.register(cards)
    ok = sqlapi.chart_data(spark, "SELECT category, return_rate FROM category_return_performance", "category", "return_rate", "LINE", "t").collect()
    assert sorted((r.chart_type, r.x, r.y, r.status) for r in ok) == [("line", "a", 0.5, "ok"), ("line", "b", 0.1, "ok")]
    skipped = sqlapi.chart_data(spark, "SELECT 1 AS one", "x", "y", "scatter").first()
    assert skipped.chart_type == "bar" and skipped.status == "skipped" and skipped.reason == "no column x and y"
    failed = sqlapi.chart_data(spark, "SELECT * FROM nowhere", "x", "y", None).first()
    assert failed.status == "failed" and "nowhere" in failed.reason and {r.reason for r in ok} == {None}


def test_report_and_answer(spark, cards):
    out = sqlapi.report(spark, cards)
    assert [r.category for r in out["at_risk"].collect()] == ["a"]
    assert {r.category for r in out["forecast_charts"].collect()} == {"a"}
    given = sqlapi.report(spark, cards, ["b"])
    assert [tuple(r) for r in given["at_risk"].collect()] == [(1, "b")]
    assert {r.category for r in given["forecast_charts"].collect()} == {"b"}
    answer = sqlapi.answer(spark, cards, "SELECT count(*) AS n FROM monthly_category_trend", {"sql": "SELECT 1 AS x, 2 AS y", "x": "x", "y": "y"})
    assert json.loads(answer["records"]) == [{"n": 8}] and answer["chart"].first().y == 2.0


@pytest.mark.parametrize("name, expected", [("Orders", "orders"), ("order_transactions", "orders"), ("sales_orders", "orders"), ("orderz", "orders"), (" RETURNS ", "returns"), ("", None), (None, None)])
def test_best_match_tiers(name, expected):
    assert best_match(name, TABLES) == expected


def test_best_match_gives_up(spark):
    assert best_match("inventory", TABLES, 0.6) is None
    assert best_match("orders", []) is None


def test_fuzzy_match_equals_the_single_name_rule(spark):
    rng = random.Random(1)
    candidates = ["orders", "Returns", "products", "order_items", "return", "inventory"]
    names = ["ORDERS", "ordr", "retruns", " products ", "items", "zzz", "inv", "order_item", "é"]
    names += ["".join(rng.choice("ordersturnpci_") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names + names + [None, ""]], "n string")
    for cutoff in (0.5, 0.7):
        got = {r.name: r.match for r in fuzzy_match(df, "n", candidates, cutoff).collect()}
        assert got == {n: best_match(n, candidates, cutoff) for n in names}
    tiers = {r.name: r.tier for r in fuzzy_match(df, "n", candidates).collect()}
    assert (tiers["ORDERS"], tiers["inv"], tiers["retruns"], tiers["zzz"]) == ("exact", "inside", "similar", None)
    assert fuzzy_match(df, "n", []).where("match is not null").count() == 0
    assert difflib.get_close_matches("retruns", ["returns"]) == ["returns"]


def test_recall_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(6)
    queries = [("q1", vectors[5].tolist()), ("q2", rng.normal(size=8).tolist())]
    got = recall(store, queries, 4).orderBy("query_id", "rank").collect()
    for name, query in queries:
        distances = np.sqrt(((vectors.astype(float) - np.array(query)) ** 2).sum(axis=1))
        mine = [r for r in got if r.query_id == name]
        assert [r.vec_id for r in mine] == list(np.argsort(distances)[:4])
        assert [r.distance for r in mine] == pytest.approx(sorted(distances)[:4])


def test_recall_breaks_ties_by_id_and_skips_missing_vectors(spark):
    rows = [(f"v{i:03d}", [0.0, 1.0]) for i in range(200)] + [("near", [1.0, 1.0]), ("none", None)]
    store = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(5)
    got = recall(store, [(7, [1.0, 1.0])], 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(7, 1, "near", 0.0), (7, 2, "v000", 1.0), (7, 3, "v001", 1.0)]


def test_upsert(spark):
    store = spark.createDataFrame([("a", "old", 0), ("b", "kept", 0)], "id string, doc string, at int")
    updates = spark.createDataFrame([("a", "newer", 2), ("a", "new", 1), ("c", "added", 1)], store.schema)
    assert sorted(tuple(r) for r in upsert(store, updates, "id", "at").collect()) == [("a", "newer", 2), ("b", "kept", 0), ("c", "added", 1)]


def test_matching_characters_equal_the_matching_blocks(spark):
    rng = random.Random(2)
    word = lambda most: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, most)))
    pairs = spark.createDataFrame([(word(16), word(16)) for _ in range(600)] + [("abab" * 20, "baba" * 20)], "a string, b string")
    for r in pairs.select("a", "b", matching_characters("a", "b").alias("n")).collect():
        assert r.n == sum(m.size for m in difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("cutoff", [0.0, 0.5, 0.8, 1.0])
def test_most_similar_loses_no_pair(spark, cutoff):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    candidates, names = sorted({word() for _ in range(40)}), sorted({word() for _ in range(150)})
    expected = {}
    for name in names:
        rated = [(difflib.SequenceMatcher(None, c, name).ratio(), c) for c in candidates]
        # a pair without any common character has ratio 0 and is no pair
        ratio, c = max((r for r in rated if r[0] >= cutoff and r[0] > 0), default=(None, None))
        if c is not None:
            expected[name] = c, ratio
    got = most_similar(spark.createDataFrame([(n,) for n in names], "wanted string"), candidates, cutoff).collect()
    assert {r.wanted: (r.similar, r.ratio) for r in got} == expected


def test_similar_names_need_no_python(spark):
    plan = fuzzy_match(spark.createDataFrame([("ordrs",)], "n string"), "n", TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_recall_leaves_vectors_without_distance_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [nan, 1.0]) for i in range(3, 9)] + [(1, [0.0, 1.0]), (2, [0.0, 3.0]), (9, [inf, 0.0]), (10, [1.0]), (11, []), (12, None), (13, [None, 1.0]), (14, [0.0, 1.0, 2.0])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r.query_id, r.rank, r.vec_id, r.distance) for r in recall(store, [("q", [0.0, 0.0]), ("three", [0.0, 0.0, 0.0])]).collect()]
    assert sorted(got) == [("q", 1, 1, 1.0), ("q", 2, 2, 3.0), ("three", 1, 14, 5.0**0.5)]
