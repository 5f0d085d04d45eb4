"""Layer, profile and report sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The most records a query result hands back, and the layers whose tables have a suffix.
RECORD_LIMIT = 200
SUFFIXED_LAYERS = ("bronze", "silver")


def layer_path(root: str, run_id: str, layer: str, table: str) -> str:
    """Bronze and Silver tables carry their layer in the name, Signal and Gold tables do not."""
    return os.path.join(root, run_id, layer, f"{table}_{layer}" if layer in SUFFIXED_LAYERS else table)


def write_layer(df: DataFrame, root: str, run_id: str, layer: str, table: str) -> DataFrame:
    """Overwrite one table of one layer of one run and return the scan of what was written."""
    path = layer_path(root, run_id, layer, table)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, NULL fields included, in the column ``record``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def records(df: DataFrame, limit: int = RECORD_LIMIT) -> DataFrame:
    """The first ``limit`` rows as JSON records; the cap is the feature (a result preview)."""
    return record_json(df.limit(limit))


def write_profile(profile: DataFrame, root: str, run_id: str, generated_at: str) -> str:
    path = os.path.join(root, "profiles", run_id)
    stamped = profile.select(F.lit(run_id).alias("run_id"), F.lit(generated_at).alias("generated_at"), "*")
    stamped.write.mode("overwrite").json(path)
    return path


def write_report(forecast: DataFrame, analysis: dict[str, str], root: str, run_id: str) -> str:
    """The answer texts and the per-category forecast of a run, as two JSON data sets."""
    path = os.path.join(root, "reports", run_id)
    spark: SparkSession = forecast.sparkSession
    forecast.write.mode("overwrite").json(os.path.join(path, "forecast"))
    rows = [(key, value) for key, value in analysis.items()]
    spark.createDataFrame(rows, "item string, content string").write.mode("overwrite").json(os.path.join(path, "analysis"))
    return path
