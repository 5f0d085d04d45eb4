"""Column-name helpers used while a plan is being built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYER_SUFFIXES = ("_bronze", "_silver")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column called exactly ``name``, even when the name holds dots or back-ticks."""
    return F.col(quoted(name))


def pick(df: DataFrame, names: Iterable[str] | Mapping[str, str]) -> DataFrame:
    """Select columns by exact name; a mapping also renames (old name to new)."""
    pairs = names.items() if isinstance(names, Mapping) else [(name, name) for name in names]
    return df.selectExpr(*[quoted(a) if a == b else f"{quoted(a)} AS {quoted(b)}" for a, b in pairs])


def is_business_key(name: str) -> bool:
    return name.endswith("_id") and not name.startswith("pk_")


def find_column(columns: list[str], *keywords: str) -> str | None:
    """The column a keyword means: an exact name if there is one, else the first that contains one."""
    lowered = {name.lower(): name for name in reversed(columns)}
    for keyword in keywords:
        if keyword in lowered:
            return lowered[keyword]
    return next((name for name in columns if any(word in name.lower() for word in keywords)), None)


def table_name(path: str) -> str:
    """``/landing/Orders_bronze.parquet`` -> ``orders``."""
    stem = re.sub(r"\.[^./]*$", "", path.rstrip("/").rsplit("/", 1)[-1]).lower()
    for suffix in LAYER_SUFFIXES:
        stem = stem.replace(suffix, "")
    return stem


def table_name_column(path: Column) -> Column:
    """The same rule as :func:`table_name` on a column of paths."""
    stem = F.lower(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?/*$", 1))
    for suffix in LAYER_SUFFIXES:
        stem = F.replace(stem, F.lit(suffix), F.lit(""))
    return stem


def dtype_of(df: DataFrame, name: str):
    return df.schema[name].dataType


def internal_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name.startswith("_")]


def drop_internal(df: DataFrame) -> DataFrame:
    """Drop the bookkeeping columns an ingestion added (their names start with ``_``)."""
    return df.drop(*[col(name) for name in internal_columns(df)])
