"""Signal: one row per order line with what its return did to revenue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.functions import measures
from ebbmark.functions.casts import to_number, to_timestamp
from ebbmark.functions.dates import days_between, month_start
from ebbmark.functions.names import col, dtype_of, find_column, is_business_key, pick
from ebbmark.operators.match import best_match
from ebbmark.operators.merge import merge_left

# The Signal columns in order, and the names by which a table's role is known.
SIGNAL_COLUMNS = (
    "order_id", "product_id", "category", "sub_category", "quantity", "order_amount",
    "is_returned", "return_reason", "days_to_return", "revenue_erosion", "net_revenue", "order_month",
)
ROLE_NAMES = {"orders": ("orders", "order"), "returns": ("returns", "return"), "products": ("products", "product")}
ROLE_CUTOFF = 0.4


def join_keys(left: list[str], right: list[str], keyword: str) -> tuple[str, str]:
    """The key column of each side: a business key both share, else the column the keyword means."""
    shared = [c for c in left if c in right and is_business_key(c)]
    if shared:
        best = next((c for c in shared if keyword in c.lower()), shared[0])
        return best, best
    a, b = find_column(left, keyword), find_column(right, keyword)
    if a and b:
        return a, b
    without = " and ".join(f"the {side} table ({', '.join(names)})" for side, names, found in (("left", left, a), ("right", right, b)) if not found)
    raise ValueError(f"'{keyword}' names no column of {without}, and the tables share no business key")


def resolve_roles(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Which table plays which role, by name. A table serves one role, the one it fits best:
    equal names claim their table first, then names that contain the role, then similar ones."""
    def equal(word: str, names: list[str]) -> str | None:
        return next((n for n in names if n.lower() == word), None)

    def containing(word: str, names: list[str]) -> str | None:
        return next((n for n in names if word in n.lower()), None)

    def similar(word: str, names: list[str]) -> str | None:
        return best_match(word, names, ROLE_CUTOFF)

    free = list(tables)
    roles: dict[str, DataFrame] = {}
    for look in (equal, containing, similar):
        for spelling in (0, 1):
            for role, words in ROLE_NAMES.items():
                name = None if role in roles else look(words[spelling], free)
                if name:
                    roles[role] = tables[name]
                    free.remove(name)
    if "orders" not in roles:
        raise ValueError(f"No orders table among {list(tables)}")
    return roles


def signal_from_tables(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    return signal(**resolve_roles(tables), **options)


def signal(
    orders: DataFrame,
    returns: DataFrame | None = None,
    products: DataFrame | None = None,
    collapse_returns: bool = False,
    hot_returns: list | None = None,
    hot_products: list | None = None,
) -> DataFrame:
    """Join order lines with their returns and products and derive the twelve Signal columns.

    Several returns of one order give several rows, each with the full order amount;
    ``collapse_returns`` combines them to one per order before the join instead. ``hot_returns``
    and ``hot_products`` name join keys that fill a large share of those tables.
    """
    lines = _prefixed(orders, "o_")
    if returns is not None:
        left, right = join_keys(orders.columns, returns.columns, "order_id")
        r = _prefixed(_needed_returns(returns, right), "r_")
        if collapse_returns:
            r = _one_return_per_order(r, f"r_{right}")
        lines = merge_left(lines, r, f"o_{left}", f"r_{right}", hot=hot_returns)
    if products is not None:
        left, right = join_keys(orders.columns, products.columns, "product_id")
        p = _prefixed(_needed_products(products, right), "p_")
        lines = merge_left(lines, p, f"o_{left}", f"p_{right}", hot=hot_products)

    def value(table: DataFrame | None, prefix: str, *words: str) -> Column | None:
        name = find_column(table.columns, *words) if table is not None else None
        return col(prefix + name) if name else None

    def number(table: DataFrame | None, prefix: str, *words: str) -> Column | None:
        name = find_column(table.columns, *words) if table is not None else None
        return to_number(col(prefix + name), dtype_of(table, name)) if name else None

    def moment(table: DataFrame | None, prefix: str, *words: str) -> Column | None:
        name = find_column(table.columns, *words) if table is not None else None
        return to_timestamp(col(prefix + name), dtype_of(table, name)) if name else None

    if products is not None:
        category = value(products, "p_", "category")
        sub_category = value(products, "p_", "sub_category", "subcategory")
    else:
        category, sub_category = value(orders, "o_", "category"), None
        category = category if category is not None else value(returns, "r_", "category")
    amount = number(orders, "o_", "order_amount", "amount")
    refund = number(returns, "r_", "refund_amount", "refund")
    refund = refund if refund is not None else F.lit(0.0)
    return_id = value(returns, "r_", "return_id")
    ordered, returned = moment(orders, "o_", "order_date"), moment(returns, "r_", "return_date")

    def known(found: Column | None, default: Column) -> Column:
        return found if found is not None else default

    missing = F.lit(None)
    columns = {
        "order_id": known(value(orders, "o_", "order_id"), missing.cast("string")),
        "product_id": known(value(orders, "o_", "product_id"), missing.cast("string")),
        "category": known(category, F.lit("unknown")),
        "sub_category": known(sub_category, F.lit("unknown")),
        "quantity": known(value(orders, "o_", "quantity"), missing.cast("bigint")),
        "order_amount": known(amount, missing.cast("double")),
        "is_returned": measures.is_returned(return_id) if return_id is not None else F.lit(0),
        "return_reason": known(value(returns, "r_", "reason"), missing.cast("string")),
        "days_to_return": days_between(ordered, returned)
        if ordered is not None and returned is not None
        else missing.cast("bigint"),
        "revenue_erosion": measures.revenue_erosion(refund),
        "net_revenue": measures.net_revenue(known(amount, missing.cast("double")), refund),
        "order_month": month_start(ordered) if ordered is not None else missing.cast("string"),
    }
    return lines.select(*[columns[name].alias(name) for name in SIGNAL_COLUMNS])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Names per source table, so that equal names of two tables stay apart in the join."""
    return pick(df, {c: prefix + c for c in df.columns})


def _needed_returns(returns: DataFrame, key: str) -> DataFrame:
    words = (("return_id",), ("return_date",), ("refund_amount", "refund"), ("reason",), ("category",))
    return _needed(returns, key, words)


def _needed_products(products: DataFrame, key: str) -> DataFrame:
    return _needed(products, key, (("category",), ("sub_category", "subcategory")))


def _needed(df: DataFrame, key: str, words: tuple[tuple[str, ...], ...]) -> DataFrame:
    wanted = [key, *[find_column(df.columns, *w) for w in words]]
    return pick(df, [c for c in dict.fromkeys(wanted) if c])


def _one_return_per_order(returns: DataFrame, key: str) -> DataFrame:
    """Refunds summed, other columns of the earliest return; combined before the shuffle."""
    refund = find_column(returns.columns, "refund_amount", "refund")
    date = find_column(returns.columns, "return_date")
    others = [c for c in returns.columns if c not in (key, refund)]
    first = F.min(F.struct(*[col(c) for c in sorted(others, key=lambda c: c != date)])).alias("_first")
    sums = [measures.money_sum(to_number(col(refund), dtype_of(returns, refund))).alias(refund)] if refund else []
    combined = returns.groupBy(col(key)).agg(*([first] if others else []), *sums)
    return combined.select(
        col(key), *[F.col("_first").getField(c).alias(c) for c in others], *([col(refund)] if refund else [])
    )
