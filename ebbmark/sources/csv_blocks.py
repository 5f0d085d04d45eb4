"""CSV records that span lines, read by many tasks a file."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# From behind an opening quote to the closing one; two quotes stand for one.
_QUOTED = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies within quotes, if its begin does or does not.

    Only a quote at the begin of a field opens; what stands between a closing quote and the next comma does not matter.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _QUOTED.match(line, at if inside else at + 1)
            if closed is None:
                return True
            at, inside = closed.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The blocks that a task reads, each with its lines."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        block = ahead[:2]

        def lines() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == block:
                line, ahead = ahead[2], next(rows, None)
                yield line

        own = lines()
        yield block, own
        for _ in own:
            pass


def _starts_inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The blocks that begin within quotes.

    Each task follows its blocks for both cases at once. A block either ends alike in both, keeps the case or turns it, so the case
    before a block is that of the last block that decides it, turned once for each block since that turns it. The driver
    gets one entry a block at most, of which it already holds the list to plan the scan.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _blocks(batches):
            outer, inner = False, True
            for line in own:
                outer, inner = ends_inside(line, outer), ends_inside(line, inner)
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), "outer": [outer], "inner": [inner]})

    ends = lines.mapInArrow(follow, "file string, start long, outer boolean, inner boolean")
    order = W.partitionBy("file").orderBy("start")
    turned = F.sum((F.col("outer") & ~F.col("inner")).cast("long")).over(order)
    decided = F.when(F.col("outer") == F.col("inner"), F.struct(F.col("outer").cast("long").alias("case"), F.col("turned")))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    steps = ends.withColumn("turned", turned).withColumn("last", F.last(decided, ignorenulls=True).over(before)).withColumn("turns", F.coalesce(F.max("turned").over(before), F.lit(0)))
    case = (F.coalesce("last.case", F.lit(0)) + F.col("turns") - F.coalesce("last.turned", F.lit(0))) % 2
    return {(r.file, r.start) for r in steps.where(case == 1).select("file", "start").collect()}


_PIECE = "file string, start long, place int, first boolean, opens boolean, closes boolean, text string"


def _records(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """``file, first, text`` of every record; ``first`` marks the first one of a file."""
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            types = {"file": pa.string(), "start": pa.int64(), "place": pa.int32(), "first": pa.bool_(), "opens": pa.bool_(), "closes": pa.bool_(), "text": pa.string()}
            batch = pa.RecordBatch.from_pydict({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(types.items())})
            out.clear()
            return batch

        for (file, start), own in _blocks(batches):
            within = (file, start) in shared.value
            begun, held, first = not within, [], start == 0
            for line in own:
                after = ends_inside(line, within)
                if not within and not held and not line.strip():
                    continue
                held.append(line)
                if not after:
                    out.append((file, start, 0 if not begun else 1, first, begun, True, "\n".join(held)))
                    held, begun, first = [], True, False
                    if len(out) >= 1000:
                        yield packed()
                within = after
            if held:
                out.append((file, start, 2 if begun else 0, first, begun, False, "\n".join(held)))
        if out:
            yield packed()

    pieces = lines.mapInArrow(cut, _PIECE)
    whole = pieces.where("opens and closes").select("file", "first", "text")
    # a record over several blocks: its begin and what follows it up to the next begin; at most two pieces a block
    parts = pieces.where("not (opens and closes)")
    number = F.sum(F.col("opens").cast("long")).over(W.partitionBy("file").orderBy("start", "place"))
    parts = parts.withColumn("number", number).groupBy("file", "number")
    pieces_of = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = parts.agg(F.bool_or("first").alias("first"), F.array_join(F.transform(pieces_of, lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("file", "first", "text"))


def _names(header: str) -> list[str]:
    """Column names as the CSV reader gives them: by place where a name is missing, with the place where it repeats."""
    cells = next(csv.reader([header], strict=False), [])
    lowered = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_spanning(spark: SparkSession, path: str) -> DataFrame:
    """The text columns of CSV files with a header whose records may span lines.

    A first pass finds which blocks of the files begin within quotes, a second one cuts each block into records and joins the
    few that cross blocks; the built-in parser splits the records. Blank lines are no records; a quote that is never closed holds the
    rest of its file but for its last line break. No file, or files without a record, give an error as for any CSV without columns.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    records = _records(lines, _starts_inside(lines))
    # where a record ends with a carriage return, so do its inner lines
    plain = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")
    records = records.withColumn("text", F.when(F.col("text").endswith("\r"), plain).otherwise(F.col("text")))
    header = records.where("first").orderBy("file").select("text").first()
    if header is None:
        return spark.read.csv(path, header=True)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in _names(header.text)])
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = records.where(~F.col("first")).select(F.from_csv("text", F.lit(schema.toDDL()), options).alias("r"))
    return parsed.select("r.*")
