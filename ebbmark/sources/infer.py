"""Type inference for text columns, in one distributed pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions.casts import blank_null_tokens, to_number
from ebbmark.functions.names import col

_WHOLE = r"^\s*[+-]?\d+\s*$"
_TRUTH = r"^(?i)(true|false)$"
_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"


def infer_types(df: DataFrame, timestamps: bool = False) -> DataFrame:
    """Turn each text column into the narrowest of bigint, double, boolean and string that fits
    all of its values; missing-value tokens become NULL. Date-like text stays text unless
    ``timestamps`` is set, which reads full ISO date-times as timestamps.

    One aggregate over the data decides all columns; only four flags per column reach the driver.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    text = {name: blank_null_tokens(col(name)) for name in names}
    checks = []
    for i, name in enumerate(names):
        value = text[name]
        tests = {
            "int": value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(),
            "num": to_number(value, T.StringType()).isNotNull(),
            "bool": value.rlike(_TRUTH),
            "time": value.rlike(_STAMP) & value.try_cast("timestamp").isNotNull(),
        }
        checks += [F.every(value.isNull() | test).alias(f"{kind}_{i}") for kind, test in tests.items()]
        checks.append(F.count(value).alias(f"seen_{i}"))
    flags = df.agg(*checks).first().asDict()

    def typed(i: int, name: str):
        value = text[name]
        if not flags[f"seen_{i}"]:
            return F.lit(None).cast("double")
        if flags[f"int_{i}"]:
            return value.try_cast("bigint")
        if flags[f"num_{i}"]:
            return to_number(value, T.StringType())
        if flags[f"bool_{i}"]:
            return F.lower(value).try_cast("boolean")
        if timestamps and flags[f"time_{i}"]:
            return value.try_cast("timestamp")
        return value

    place = {name: i for i, name in enumerate(names)}
    return df.select(*[typed(place[n], n).alias(n) if n in place else col(n) for n in df.columns])
