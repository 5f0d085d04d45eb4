"""Lenient casts: what cannot be read becomes NULL, and NaN is the same as NULL.

The session runs in ANSI mode, where a bad plain cast raises; every cast here is a ``try_`` form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions.dates import floor_div, parse_timestamp

# Texts that a CSV reader takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words that name a target type in a cast hint.
TEXT_WORDS = r"\b(text|string|str|varchar|char)\b"
INTEGER_WORDS = r"\b(u?int(eger)?s?(8|16|32|64)?|bigint|smallint|tinyint|long)\b"
FLOAT_WORDS = r"\b(float(32|64)?s?|double|decimal|numeric|number|real)\b"
TIME_WORDS = r"\b(date(time)?(64)?s?|timestamp|time)\b"

# A plain decimal number; keeps out Java's "1d", "0x1p3", "NaN" and "Infinity".
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_LARGEST = 1.7976931348623157e308


def blank_null_tokens(text: Column) -> Column:
    return F.when(~text.isin(*NULL_TOKENS), text)


def finite(value: Column) -> Column:
    """A double, or NULL where it is NaN or infinite."""
    # Two mentions in the condition let Spark compute a costly value once for all mentions.
    return F.when(value.between(-_LARGEST, _LARGEST), value)


def to_number(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return finite(F.when(value.rlike(_NUMBER), value.try_cast("double")))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(value.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def to_integer(value: Column, dtype: T.DataType) -> Column:
    """Whole numbers only: ``"12"``, ``"12.0"`` and ``"1e3"`` are read, ``"1.5"`` is NULL."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    number = to_number(value, dtype)
    whole = number.try_cast("bigint")
    # A text is read again as bigint, as a double does not hold every one.
    exact = F.coalesce(value.try_cast("bigint"), whole) if isinstance(dtype, T.StringType) else whole
    return F.when(whole == number, exact)


def to_timestamp(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return parse_timestamp(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.timestamp_micros(floor_div(to_integer(value, dtype), 1000))  # nanoseconds since 1970
    return F.lit(None).cast("timestamp")


def cast_kind(hint: str | None) -> str:
    """``integer``, ``float``, ``timestamp`` or ``text`` for a free-text hint, by whole words."""
    words = (hint or "").lower().replace("_", " ")
    if re.search(TEXT_WORDS, words):
        return "text"
    if re.search(INTEGER_WORDS, words):
        return "integer"
    if re.search(FLOAT_WORDS, words):
        return "float"
    if re.search(TIME_WORDS, words):
        return "timestamp"
    return "text"


def cast_lenient(value: Column, dtype: T.DataType, hint: str | None) -> Column:
    kind = cast_kind(hint)
    if kind == "integer":
        return to_integer(value, dtype)
    if kind == "float":
        return to_number(value, dtype)
    if kind == "timestamp":
        return to_timestamp(value, dtype)
    return to_text(value, dtype)


def to_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
