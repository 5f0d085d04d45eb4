"""Bronze and Silver: rules turned into one projection per table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions.casts import cast_lenient, to_text, to_timestamp
from ebbmark.functions.dates import standard_date
from ebbmark.functions.names import col, dtype_of
from ebbmark.functions.text import normalize_text
from ebbmark.operators.cleanse import Fill, distinct_surrogate_key, drop_nulls, fill_columns, surrogate_key
from ebbmark.operators.rules import Rule, missing_business_keys, rules_by_table


@dataclass
class LayerNotes:
    """What a layer run has to report besides its tables."""

    skipped: list[str] = field(default_factory=list)
    recovered: dict[str, list[str]] = field(default_factory=dict)


def bronze(
    tables: Mapping[str, DataFrame],
    rules: list[Rule],
    run_ts: str | None = None,
    sources: Mapping[str, str] | None = None,
    notes: LayerNotes | None = None,
) -> dict[str, DataFrame]:
    """Typed copies of the landing tables, one projection each.

    ``sources`` names the path a table was read from; without it the scan reports the file per row.
    """
    run_ts = run_ts or datetime.now(timezone.utc).isoformat()
    notes = notes if notes is not None else LayerNotes()
    matched, notes.skipped = rules_by_table(rules, list(tables))
    result = {}
    for name, table_rules in matched.items():
        df = tables[name]
        source = F.lit(sources[name]) if sources and name in sources else F.input_file_name()
        result[name] = _bronze_table(df, name, table_rules, run_ts, source, notes)
    return result


def _bronze_table(df: DataFrame, name: str, rules: list[Rule], run_ts: str, source: Column, notes: LayerNotes) -> DataFrame:
    metadata = {"_load_timestamp": F.lit(run_ts), "_source_file": source}
    out: dict[str, Column] = {}
    for rule in rules:
        if rule.kind == "metadata":
            if rule.target_column in metadata:
                out[rule.target_column] = metadata[rule.target_column]
        elif rule.source_column in df.columns:
            value = col(rule.source_column)
            if rule.kind == "indirect":
                value = cast_lenient(value, dtype_of(df, rule.source_column), rule.transformation_logic)
            out[rule.target_column] = value
    return _project(df, out, name, notes)


def _project(df: DataFrame, out: dict[str, Column], name: str, notes: LayerNotes) -> DataFrame:
    """One select: the mapped columns, then the business keys no rule kept."""
    lost = missing_business_keys(df.columns, out)
    if lost:
        notes.recovered[name] = lost
    return df.select(*[value.alias(target) for target, value in out.items()], *[col(c) for c in lost])


def silver(
    tables: Mapping[str, DataFrame],
    rules: list[Rule],
    order_by: Mapping[str, list[str]] | None = None,
    notes: LayerNotes | None = None,
    written: bool = False,
) -> dict[str, DataFrame]:
    """Cleansed tables: project, drop incomplete rows, drop copies, number the rows.

    ``order_by`` declares, per table, the columns that order the surrogate key (a distributed table
    has no row order of its own); by default the business keys, then all other columns. ``written``
    says that ``tables`` are scans, so that scanning them again costs no shuffle.
    """
    notes = notes if notes is not None else LayerNotes()
    matched, notes.skipped = rules_by_table(rules, list(tables))
    return {
        name: _silver_table(tables[name], name, table_rules, (order_by or {}).get(name), notes, written)
        for name, table_rules in matched.items()
    }


def _silver_table(df: DataFrame, name: str, rules: list[Rule], order_by: list[str] | None, notes: LayerNotes, written: bool) -> DataFrame:
    key = f"pk_{name}_silver_id"
    usable = [r for r in rules if r.source_column in df.columns]
    filling = [r for r in usable if r.kind == "null_handling" and not _drops(r)]
    fills = dict(zip(filling, fill_columns(df, [(r.source_column, Fill.of_rule(r.transformation_logic)) for r in filling])))
    out: dict[str, Column] = {}
    complete: list[str] = []
    for rule in rules:
        if rule.kind == "surrogate_key":
            key = rule.target_column or key
        elif rule in usable:
            out[rule.target_column] = _silver_value(df, rule, fills)
            if _drops(rule):
                complete.append(rule.target_column)
    result = _project(df, out, name, notes)
    if complete:
        result = drop_nulls(result, complete)
    order = _key_order(result, order_by)
    if any(rule.kind == "dedup" for rule in rules):
        return distinct_surrogate_key(result, key, order, written)
    return surrogate_key(result, key, order)


def _drops(rule: Rule) -> bool:
    return rule.kind == "null_handling" and (rule.transformation_logic or "").strip().lower() == "drop"


def _silver_value(df: DataFrame, rule: Rule, fills: dict[Rule, Column]) -> Column:
    value, dtype = col(rule.source_column), dtype_of(df, rule.source_column)
    if rule.kind == "type_cast":
        return cast_lenient(value, dtype, rule.transformation_logic)
    if rule.kind == "date_standardize":
        return standard_date(to_timestamp(value, dtype))
    if rule.kind == "text_normalize":
        return normalize_text(to_text(value, dtype), rule.transformation_logic)
    return fills.get(rule, value)


def _key_order(df: DataFrame, declared: list[str] | None) -> list[str]:
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = declared or [c for c in sortable if c.endswith("_id")]
    return first + [c for c in sortable if c not in first]
