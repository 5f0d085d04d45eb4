"""Signal, Gold and cleansing against plain Python on random small tables with gaps, copies and hot keys."""

import random
from datetime import datetime, timedelta

import pytest

from ebbmark.operators import cleanse, gold
from ebbmark.operators.merge import hot_keys
from ebbmark.operators.signal import signal


def some(rng, values, missing=0.1):
    return None if rng.random() < missing else rng.choice(values)


def tables(rng):
    keys = [f"O{i}" for i in range(25)] + ["HOT"] * 12
    products = [f"P{i}" for i in range(6)]
    day = datetime(2025, 1, 1)
    orders = [
        (some(rng, keys), (day + timedelta(hours=rng.randrange(4000))), some(rng, products), rng.randrange(1, 4), some(rng, [0.0, 10.25, 99.99, 1234.5678]))
        for _ in range(60)
    ]
    returns = [
        (some(rng, [f"R{i}" for i in range(99)], 0.05), some(rng, keys), some(rng, [day + timedelta(hours=h) for h in range(0, 5000, 7)]),
         some(rng, ["size", "late"]), some(rng, ["5", "7.5", "bad", "", "1e1"]))
        for _ in range(40)
    ]
    goods = [(p, f"c{i % 3}" if i else None, f"s{i}") for i, p in enumerate(products[:-1])] + [(None, "c9", "s9")]
    return orders, returns, goods


def expected_signal(orders, returns, goods):
    rows = []
    for order_id, ordered, product_id, quantity, amount in orders:
        back = [r for r in returns if r[1] == order_id] or [(None,) * 5]
        matched = [g for g in goods if g[0] == product_id] or [(None,) * 3]
        for return_id, _, returned, reason, refund in back:
            for _, category, sub in matched:
                try:
                    lost = float(refund)
                except (TypeError, ValueError):
                    lost = 0.0
                days = (returned - ordered) // timedelta(days=1) if returned else None
                rows.append((order_id, product_id, category, sub, quantity, amount, int(return_id is not None), reason, days, lost,
                             (amount or 0.0) - lost, ordered.strftime("%Y-%m-01")))
    return rows


def expected_groups(rows, key):
    groups = {}
    for row in rows:
        groups.setdefault(key(row), []).append(row)
    return groups


def as_frames(spark, orders, returns, goods):
    return (
        spark.createDataFrame(orders, "order_id string, order_date timestamp, product_id string, quantity int, order_amount double"),
        spark.createDataFrame(returns, "return_id string, order_id string, return_date timestamp, return_reason string, refund_amount string"),
        spark.createDataFrame(goods, "product_id string, category string, sub_category string"),
    )


def ordered(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signal_and_gold(spark, seed):
    data = tables(random.Random(seed))
    orders, returns, goods = as_frames(spark, *data)
    rows = expected_signal(*data)
    assert ordered(signal(orders, returns, goods).collect()) == ordered(rows)
    hot = hot_keys(returns, "order_id", share=0.1)
    assert "HOT" in hot
    salted = signal(orders, returns, goods, hot_returns=hot, hot_products=[None, "P1"])
    assert ordered(salted.collect()) == ordered(rows)

    tables_ = gold.gold(salted)
    cards = {r.category: r for r in tables_["category_return_performance"].collect()}
    for category, group in expected_groups(rows, lambda r: r[2]).items():
        card, days = cards.pop(category), [r[8] for r in group if r[8] is not None]
        total = sum(r[0] is not None for r in group)
        assert card.total_orders == total and card.total_returns == sum(r[6] for r in group)
        assert card.gross_revenue == pytest.approx(sum(r[5] or 0 for r in group), abs=1e-6)
        assert card.total_refunds == pytest.approx(sum(r[9] for r in group), abs=1e-6)
        assert card.net_revenue == pytest.approx(sum(r[10] for r in group), abs=1e-6)
        assert card.avg_days_to_return == (pytest.approx(sum(days) / len(days)) if days else None)
        assert card.return_rate == (pytest.approx(card.total_returns / total) if total else None)
    assert not cards
    trend = {(r.category, r.order_month): r for r in tables_["monthly_category_trend"].collect()}
    groups = expected_groups(rows, lambda r: (r[2], r[11]))
    assert set(trend) == set(groups)
    assert all(trend[k].returns == sum(r[6] for r in g) for k, g in groups.items())
    keys = sorted(groups, key=lambda k: (k[0] is None, k[0] or "", k[1]))
    assert [trend[k].pk_gold_id for k in keys] == list(range(1, len(keys) + 1))


def test_large_gold_is_numbered_alike(spark):
    orders, returns, goods = as_frames(spark, *tables(random.Random(4)))
    rows = signal(orders, returns, goods)
    assert ordered(gold.monthly_trend(rows, large=True).collect()) == ordered(gold.monthly_trend(rows).collect())
    assert ordered(gold.category_performance(rows, large=True).collect()) == ordered(gold.category_performance(rows).collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_keep_first_and_copies(spark, seed):
    rng = random.Random(seed)
    rows = [(some(rng, ["a", "hot", "hot", "hot"]), some(rng, [1, 2, 3]), some(rng, ["x", "y"])) for _ in range(80)]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(4)
    assert ordered(cleanse.drop_copies(df).collect()) == ordered(set(rows))

    def rank(row):  # NULLs first
        return [(v is not None, v) if v is not None else (False, 0) for v in row[1:]]

    first = [min(group, key=rank) for group in expected_groups(rows, lambda r: r[0]).values()]
    assert ordered(cleanse.keep_first(df, ["k"], ["at"]).collect()) == ordered(first)
