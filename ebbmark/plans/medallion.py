"""Landing to Gold as one chain."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.functions.names import table_name
from ebbmark.operators.gold import gold
from ebbmark.operators.layers import LayerNotes, bronze, silver
from ebbmark.operators.merge import hot_keys
from ebbmark.operators.rules import Rule
from ebbmark.operators.signal import join_keys, resolve_roles, signal
from ebbmark.sources.readers import file_format, read_any
from ebbmark.sources.runlog import log_events, observe_rows
from ebbmark.sources.sinks import write_layer

SIGNAL_TABLE = "order_line_signals"


def read_landing(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables and their paths by the name each file stands for."""
    sources: dict[str, str] = {}
    for path in paths:
        if (other := sources.setdefault(table_name(path), path)) != path:
            raise ValueError(f"{other} and {path} would both be the table '{table_name(path)}'")
    return {name: read_any(spark, path) for name, path in sources.items()}, sources


def landing_to_gold(
    spark: SparkSession,
    inputs: list[str] | Mapping[str, DataFrame],
    bronze_rules: list[Rule],
    silver_rules: list[Rule],
    order_by: Mapping[str, list[str]] | None = None,
    out: str | None = None,
    run_id: str = "run",
    run_ts: str | None = None,
) -> dict[str, DataFrame]:
    """Run every layer and return Signal and both Gold tables (with ``out``, all layer tables).

    ``inputs`` are landing files or DataFrames by table name. With ``out`` each layer is written
    below ``out/run_id`` and the next layer reads what was written; the run log goes to
    ``out/log``. Without it the layers stay lazy up to the staged keys and month sums
    and the search for hot keys.
    """
    if isinstance(inputs, Mapping):
        tables, sources = dict(inputs), None
    else:
        tables, sources = read_landing(spark, inputs)
    run = _Run(spark, out, run_id)

    notes = LayerNotes()
    bronzes = bronze(tables, bronze_rules, run_ts, sources, notes)
    formats = {name: file_format(sources[name]) if sources else "table" for name in bronzes}
    bronzes = run.keep(bronzes, "bronze", notes, formats)
    notes = LayerNotes()
    silvers = run.keep(silver(bronzes, silver_rules, order_by, notes, written=bool(out)), "silver", notes)

    roles = resolve_roles(silvers)
    hot = {}
    for role, keyword in (("returns", "order_id"), ("products", "product_id")):
        if role in roles:
            _, key = join_keys(roles["orders"].columns, roles[role].columns, keyword)
            hot[f"hot_{role}"] = hot_keys(roles[role], key)
    signals = {SIGNAL_TABLE: signal(**roles, **hot)}
    signals = run.keep(signals, "signal", return_rate=F.round(F.avg("is_returned"), 4))[SIGNAL_TABLE]
    golds = run.keep(gold(signals), "gold")

    result = {SIGNAL_TABLE: signals, **golds}
    if out:
        result.update({f"{name}_bronze": df for name, df in bronzes.items()})
        result.update({f"{name}_silver": df for name, df in silvers.items()})
    return result


class _Run:
    """Writes layer tables and their log rows, or passes tables through when nothing is kept."""

    def __init__(self, spark: SparkSession, out: str | None, run_id: str):
        self.spark, self.out, self.run_id = spark, out, run_id

    def keep(self, tables: dict[str, DataFrame], layer: str, notes: LayerNotes | None = None,
             formats: Mapping[str, str] | None = None, **metrics) -> dict[str, DataFrame]:
        """Write the tables of one layer, log what was written and return the scans of it."""
        if not self.out:
            return tables
        events = []
        if notes:
            events += [(layer, "table_skipped", {"target_table": name}) for name in notes.skipped]
            events += [
                (layer, "business_keys_recovered", {"table": name, "columns": ",".join(columns)})
                for name, columns in notes.recovered.items()
            ]
        written = {}
        for name, df in tables.items():
            observed, seen = observe_rows(df, f"{layer}-{name}", **metrics)
            written[name] = write_layer(observed, self.out, self.run_id, layer, name)
            source = {"source_format": formats[name]} if formats else {}
            events.append((layer, "table_written", {"table": name, **seen.get, **source}))
        log_events(self.spark, os.path.join(self.out, "log"), self.run_id, events)
        return written
