"""Run log: an append-only JSON data set with one folder per run."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "timestamp string, agent string, action string, details map<string,string>, run_id string"


def log_event(spark: SparkSession, log_dir: str, run_id: str, agent: str, action: str, **details) -> None:
    log_events(spark, log_dir, run_id, [(agent, action, details)])


def log_events(spark: SparkSession, log_dir: str, run_id: str, events: list[tuple[str, str, dict]]) -> None:
    """Append (agent, action, details) events, all with the time of writing, as one small file."""
    now = datetime.now(timezone.utc).isoformat()
    rows = [
        (now, agent, action, {k: None if v is None else str(v) for k, v in details.items()}, run_id)
        for agent, action, details in events
    ]
    if rows:
        spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").partitionBy("run_id").json(log_dir)


def read_log(spark: SparkSession, log_dir: str, run_id: str) -> DataFrame:
    """The events of one run (only its folder is read); no events for a run never logged."""
    try:
        log = spark.read.schema(LOG_SCHEMA).json(log_dir)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], LOG_SCHEMA)
    return log.where(F.col("run_id") == run_id)


def recent_events(log: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events, newest first."""
    return log.orderBy(F.desc("timestamp")).limit(n)


def observe_rows(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """Attach a row count and further aggregates that are computed by the job that writes ``df``."""
    seen = Observation(name)
    extra = [column.alias(key) for key, column in metrics.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra), seen
