"""Left joins that keep every match, NULL keys included, and stand hot keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.functions.names import col, pick

SALTS = 32


def merge_left(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    suffix: str = "_right",
    null_safe: bool = True,
    hot: list | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """All rows of ``left`` with all their matches in ``right``.

    Equal names get ``suffix`` on the right; keys of one name appear once. NULL keys match each
    other unless ``null_safe`` is off. Neither side is forced to be broadcast: Spark does so by
    size, and adaptive execution splits a hot key of the left side.

    A hot key of the *right* side cannot be split by a left join. Keys named in ``hot`` (see
    :func:`hot_keys`) are salted: their right rows spread over ``salts`` groups, and each left row
    with such a key visits all groups.
    """
    shared_key = left_key == right_key
    names = {c: c + suffix if c in left.columns and not (shared_key and c == right_key) else c for c in right.columns}
    # Names of their own for both keys, so that nothing below can be ambiguous.
    if shared_key:
        names[right_key] = "_right_key"
        right = pick(right, names)
    else:
        right = pick(right, names).withColumn("_right_key", col(names[right_key]))
    kept = [c for c in right.columns if c != "_right_key"]
    left_rows = left.withColumn("_left_key", col(left_key))

    def same(a: str, b: str):
        return F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)

    condition = same("_left_key", "_right_key")
    if not hot:
        joined = left_rows.join(right, condition, "left")
        return pick(joined, [*left.columns, *kept])

    def is_hot(key: str):
        listed = [value for value in hot if value is not None]
        test = F.col(key).isin(*listed) if listed else F.lit(False)
        test = F.coalesce(test, F.lit(False))
        return test | F.col(key).isNull() if None in hot and null_safe else test

    # Any spread of the copies is right, as every left row with the key visits all groups; the
    # spread must only be the same if a task is run again, hence a hash of the row's own values.
    others = [col(c) for c in kept if right.schema[c].dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(salts)).cast("int")
    right = right.select("*", F.when(is_hot("_right_key"), spread).otherwise(F.lit(0)).alias("_right_salt"), F.lit(True).alias("_matched"))
    # Only a key that does occur on the right may drop its visits without a match (below). One row
    # per listed key at most, so the broadcast is bounded by the list.
    present = right.where(is_hot("_right_key")).select(F.col("_right_key").alias("_hot_key")).distinct()
    present = present.select("_hot_key", F.lit(True).alias("_hot"))
    left_rows = left_rows.join(F.broadcast(present), same("_left_key", "_hot_key"), "left")
    visits = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left_rows = left_rows.select("*", F.explode(visits).alias("_left_salt"))
    joined = left_rows.join(right, condition & (F.col("_left_salt") == F.col("_right_salt")), "left")
    joined = joined.where(F.col("_hot").isNull() | F.col("_matched"))
    return pick(joined, [*left.columns, *kept])


def hot_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Keys that may fill at least ``share`` of the rows: one scan of one column, no shuffle.

    A frequency sketch of fixed size finds them; it names up to 1/``share`` keys, more cannot qualify. A key named
    here without need costs a little, so the estimate need not be exact. NULL counts as a key.
    """
    most = math.ceil(1 / share)
    found = df.select(col(key).alias("k")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("k").isNull()).alias("nulls"),
        F.expr(f"approx_top_k(k, {most}, {10 * most})").alias("top"),
    ).first()
    if not found.rows:
        return []
    least = max(2, found.rows * share)
    keys = [entry["item"] for entry in found.top or [] if entry["item"] is not None and entry["count"] >= least]
    if found.nulls >= least:
        keys.append(None)
    return keys
