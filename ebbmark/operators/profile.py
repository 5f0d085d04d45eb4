"""Column profile and layer preview."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions.casts import to_text
from ebbmark.functions.names import col
from ebbmark.sources.sinks import record_json

# Fixed value: sample rows per table.
SAMPLE_ROWS = 3


def _present(field: T.StructField) -> Column:
    """The value, NULL where it is NaN."""
    value = col(field.name)
    return F.when(~F.isnan(value), value) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else value


def profile(df: DataFrame, dataset: str, fmt: str = "parquet", approximate: bool = False) -> DataFrame:
    """One row per column: type, NULLs, distinct values and, for numbers, range and mean.

    Counts and ranges of all columns come from one aggregate. Exact distinct counts come from a
    second pass that first removes equal (column, value) pairs, before and after one shuffle;
    ``approximate`` puts sketches into the first pass instead.
    """
    stats = []
    for field in df.schema:
        value = _present(field)
        number = None
        if isinstance(field.dataType, T.BooleanType):
            number = value.cast("int").cast("double")
        elif isinstance(field.dataType, T.NumericType):
            number = value.cast("double")
        missing = F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count(F.lit(1)) - F.count(value)).alias("null_count"),
                (F.approx_count_distinct(to_text(value, field.dataType)) if approximate else F.lit(None).cast("bigint")).alias("sketched"),
                (F.min(number) if number is not None else missing).alias("min"),
                (F.max(number) if number is not None else missing).alias("max"),
                (F.avg(number) if number is not None else missing).alias("mean"),
            )
        )
    columns = df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))
    if approximate:
        counted = columns.select("*", F.col("sketched").alias("unique_count"))
    else:
        counted = columns.join(distinct_counts(df), "column", "left")
    return counted.select(
        F.lit(dataset).alias("dataset"),
        F.lit(fmt).alias("format"),
        "row_count",
        "column",
        "dtype",
        "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("row_count")), 2).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")],
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct non-NULL values per column.

    The hash of a single number, date or time is one-to-one, so for those the hash is counted
    in place of the value: eight bytes to shuffle and no text to build. Long texts are told apart
    by SHA-256.
    """
    narrow = [f for f in df.schema if _hashes_one_to_one(f.dataType)]
    wide = [f for f in df.schema if f not in narrow]
    parts = []
    if narrow:
        hashed = [F.when(_present(f).isNotNull(), F.xxhash64(_present(f))).alias(f.name) for f in narrow]
        parts.append(_count_distinct(df.select(*hashed)))
    if wide:
        parts.append(_count_distinct(df.select(*[_short(to_text(col(f.name), f.dataType)).alias(f.name) for f in wide])))
    return reduce(DataFrame.unionByName, parts)


def _count_distinct(values: DataFrame) -> DataFrame:
    """Pairs of column position and value are made distinct; a position groups faster than a name."""
    cells = [F.struct(F.lit(i).alias("at"), col(c).alias("value")) for i, c in enumerate(values.columns)]
    pairs = values.select(F.inline(F.array(*cells))).where("value is not null")
    counts = pairs.groupBy("at").agg(F.countDistinct("value").alias("unique_count"))
    return counts.select(F.get(F.lit(values.columns), F.col("at")).alias("column"), "unique_count")


def _hashes_one_to_one(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _short(text: Column) -> Column:
    """A digest of fixed width: every text travels as one, so no text can be taken for the digest of another."""
    return F.sha2(text, 256)


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first few rows as JSON, for a preview."""
    return record_json(df.limit(n))


def layer_preview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: columns, types, number of rows and sample rows as JSON."""
    def one(name: str, df: DataFrame) -> DataFrame:
        samples = sample_rows(df).agg(F.collect_list("record").alias("sample")).select(F.lit(name).alias("table"), "sample")
        rows = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        return rows.join(samples, "table").select(
            "table",
            F.lit(df.columns).alias("columns"),
            F.lit([f.dataType.simpleString() for f in df.schema]).alias("dtypes"),
            "row_count",
            "sample",
        )

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def column_catalog(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Columns per table without internal ones; read from schemas, no job."""
    return {name: [c for c in df.columns if not c.startswith("_")] for name, df in tables.items()}
