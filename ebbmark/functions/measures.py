"""Arithmetic shared by the feature, scorecard and forecast operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The slope per month beyond which a return rate counts as rising or falling.
DIRECTION_THRESHOLD = 0.001
# Money counts in ten-thousandths of a unit.
MONEY_PARTS = 10_000


def money_parts(value: Column, name: str) -> list[Column]:
    """Three sums that together are the sum of ``value``: whole units, ten-thousandths, and what is finer.

    A sum of doubles depends on the order in which tasks finish. Units and parts are whole numbers, so for
    amounts of up to four decimals a retried task cannot change a report; the noise of the third sum lies far
    below any rounding. What a double cannot tell from zero there counts as zero, and values beyond whole
    numbers' range go to the third sum as they are.
    """
    whole = F.abs(value) < 2.0**52
    units = F.when(whole, F.floor(value))
    parts = F.when(whole, F.floor((value - units) * MONEY_PARTS + 0.5))
    finer = value - units - parts.cast("double") / MONEY_PARTS
    rest = F.when(~whole, value).when(F.abs(finer) > F.abs(value) * 2.0**-50, finer).otherwise(F.lit(0.0))
    return [F.sum(units).alias(f"{name}_units"), F.sum(parts).alias(f"{name}_parts"), F.sum(rest).alias(f"{name}_rest")]


def money_total(units: Column, parts: Column, rest: Column) -> Column:
    """The three sums as one double, 0 where there were no values."""
    exact = F.coalesce(units, F.lit(0)).cast("decimal(20,0)") + F.coalesce(parts, F.lit(0)).cast("decimal(20,0)") * F.lit(Decimal("0.0001"))
    return exact.cast("double") + F.coalesce(rest, F.lit(0.0))


def money_sum(value: Column) -> Column:
    return money_total(*money_parts(value, "sum"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def clip_rate(value: Column) -> Column:
    # greatest() skips NULLs, which would turn an unknown rate into 0.
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def direction(slope: Column) -> Column:
    return (
        F.when(slope > DIRECTION_THRESHOLD, "rising")
        .when(slope < -DIRECTION_THRESHOLD, "falling")
        .otherwise("flat")
    )


def is_returned(return_id: Column) -> Column:
    return return_id.isNotNull().cast("int")


def revenue_erosion(refund: Column) -> Column:
    return F.coalesce(refund, F.lit(0.0))


def net_revenue(amount: Column, refund: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0)) - revenue_erosion(refund)
