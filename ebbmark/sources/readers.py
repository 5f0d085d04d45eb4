"""Landing and layer scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbmark.functions.names import col
from ebbmark.sources import json_blocks
from ebbmark.sources.csv_blocks import read_spanning
from ebbmark.sources.infer import infer_types
from ebbmark.sources.workbook import read_excel

# The file suffixes read, and the envelope fields looked for, in this order.
FORMATS = (".csv", ".json", ".xlsx", ".parquet")
ENVELOPE_FIELDS = ("data", "records", "items")


def file_format(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[name.rfind("."):].lower().lstrip(".") if "." in name else ""


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a landing file (or folder of files) by its suffix or the given format."""
    fmt = (fmt or file_format(path)).lower().lstrip(".")
    readers = {"csv": read_csv, "json": read_json, "xlsx": read_excel, "parquet": read_parquet}
    if fmt not in readers:
        raise ValueError(f"{path}: nothing reads '{fmt}'; known suffixes are {' '.join(FORMATS)}")
    return readers[fmt](spark, path)


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """CSV with a header; types are inferred, date-like text stays text.

    A file is split over many tasks, also where records span lines. ``multiline=None`` finds out whether any
    does: a record that spans lines leaves a line with an odd number of quotes.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    if multiline:
        return infer_types(read_spanning(spark, path))
    return infer_types(spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"'))


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON records: top-level lists, objects that wrap a list, single objects, or JSON lines.

    Each file of a folder is read by its own shape; columns that a shape lacks are NULL, and a column whose
    types do not go together becomes text. ``lines`` says that all files are JSON lines and saves the look at
    them. Lists, also wrapped ones, are read by many tasks a file; an object without such a list is one record.
    """
    if lines:
        return flatten(spark.read.json(path, mode="FAILFAST"))
    found = json_blocks.shapes(spark, path)
    by_line = _files_of_lines(spark, [file for file, shape in found.items() if shape.values != 1])
    rest = {file: shape for file, shape in found.items() if file not in by_line}
    lists = {file: shape for file, shape in rest.items() if shape.values == 1 and shape.first == "["}
    several = {file: shape for file, shape in rest.items() if shape.values > 1}
    objects = {file: shape for file, shape in rest.items() if file not in lists and file not in several}
    parts = []
    if by_line:
        parts.append(spark.read.json(by_line, mode="FAILFAST"))
    if lists:
        parts.append(json_blocks.read_records(spark, lists, 1))
    if several:
        parts.append(json_blocks.read_records(spark, several, 0))
    if objects:
        wrapped, single = json_blocks.read_wrapped(spark, objects, ENVELOPE_FIELDS)
        parts += wrapped
        if single:
            parts.append(spark.read.json(single, multiLine=True, mode="FAILFAST"))
    if not parts:  # nothing but blank files
        return spark.read.json(path, multiLine=True, mode="FAILFAST")
    return _stacked([flatten(part) for part in parts])


def _files_of_lines(spark: SparkSession, files: list[str]) -> list[str]:
    """Those of ``files`` that hold more than one line, each of them JSON by itself. Only file names reach the driver."""
    if not files:
        return []
    text = spark.read.text(files).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").isNotNull().alias("whole"))
    counts = text.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("wholes"))
    return [r.file for r in counts.where("n > 1 and n = wholes").orderBy("file").collect()]


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of ``parts``, columns by name."""
    kinds: dict[str, set[T.DataType]] = {}
    for part in parts:
        for field in part.schema:
            kinds.setdefault(field.name, set()).add(field.dataType)
    mixed = {name for name, found in kinds.items() if len(found) > 1 and not all(isinstance(k, T.NumericType) for k in found)}

    def plain(part: DataFrame) -> DataFrame:
        def text(field: T.StructField) -> Column:
            nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
            return (F.to_json(col(field.name)) if nested else col(field.name).cast("string")).alias(field.name)

        return part.select(*[text(field) if field.name in mixed else col(field.name) for field in part.schema])

    stacked, *others = [plain(part) for part in parts] if mixed else parts
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns ``a.b``; lists stay as they are."""

    def leaves(field: T.StructField, path: Column, name: str) -> list[Column]:
        if isinstance(field.dataType, T.StructType):
            return [
                leaf
                for child in field.dataType
                for leaf in leaves(child, path.getField(child.name), f"{name}.{child.name}")
            ]
        return [path.alias(name)]

    return df.select(*[leaf for field in df.schema for leaf in leaves(field, col(field.name), field.name)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
