"""JSON documents read by many tasks: records of a top-level list, of a wrapped list, or one behind the other.

A file is read in pieces that end at ``}``, so Spark splits it wherever its line breaks are. A first pass follows strings and brackets
of each block for both cases (it begins within a string or not); windows over the blocks of a file put the cases together. So each
block knows how deep it begins, and a second pass cuts the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbmark.session import scratch_path

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_NO_BRACKET = re.compile(r"[^][{}]+")
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
# a whole string, an opening quote without an end, or a bracket
_MARKS = re.compile(r'"(?:[^"\\]++|\\.)*+"|["{}\[\]]', re.DOTALL)
_KEY = re.compile(r'"((?:[^"\\]++|\\.)*+)"\s*+:\s*+\Z', re.DOTALL)


@dataclass
class Shape:
    """What the blocks of one file hold."""

    first: str = ""  # its first character that is not blank
    values: int = 0  # lists and objects that stand at the top
    #: begin of a block -> whether it begins within a string, and its depth
    blocks: dict[int, tuple[bool, int]] = field(default_factory=dict)
    #: begin of the block whose last piece has no ``}`` behind it
    unclosed: int | None = None


def _pieces(spark: SparkSession, files: str | list[str]) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.text(files, lineSep="}").select(*place, F.col("_metadata.file_size").alias("size"), "value")


class _Case:
    """Depth of a block that begins within a string or not: its end, its lowest place and how often a closing bracket reaches it."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.depth, self.low, self.lows = inside, 0, 0, 0

    def follow(self, parts: list[str]) -> None:
        """``parts`` lie between the quotes of a piece that ends at a closing bracket."""
        brackets = _NO_BRACKET.sub("", "".join(parts[1 if self.inside else 0 :: 2]))
        self.inside ^= len(parts) % 2 == 0
        if not self.inside:
            brackets += "}"
        for c in brackets:
            if c in "[{":
                self.depth += 1
                continue
            self.depth -= 1
            if self.depth < self.low:
                self.low, self.lows = self.depth, 0
            self.lows += self.depth == self.low


_STATE = "file string, start long, size long, bytes long, first string, odd boolean, " + ", ".join(f"depth{i} long, low{i} long, lows{i} long" for i in (0, 1))


def shapes(spark: SparkSession, path: str | list[str]) -> dict[str, Shape]:
    """The shape of every file that is not blank. The driver gets one entry a block, of which it holds the list to plan the scan."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for file, start, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = found.setdefault((file, start, size), [0, "", _Case(False), _Case(True)])
                state[0] += (len(text) if text.isascii() else len(text.encode())) + 1
                state[1] = state[1] or text.lstrip("\ufeff \t\r\n")[:1]
                parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
                state[2].follow(parts)
                state[3].follow(parts)
        rows = [(*block, n, first, a.inside, a.depth, a.low, a.lows, b.depth, b.low, b.lows) for block, (n, first, a, b) in found.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 6]
        names = [c.split()[0] for c in _STATE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    order = W.partitionBy("file").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    blocks = _pieces(spark, path).mapInArrow(follow, _STATE)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0)) % 2 == 1)
    for name in ("depth", "low", "lows"):
        blocks = blocks.withColumn(name, F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0")))
    blocks = blocks.withColumn("from", F.coalesce(F.sum("depth").over(before), F.lit(0)))
    found: dict[str, Shape] = {}
    ends: dict[str, tuple] = {}
    for r in blocks.orderBy("file", "start").collect():
        shape = found.setdefault(r.file, Shape())
        shape.first = shape.first or r.first
        shape.blocks[r.start] = (r.inside, r["from"])
        shape.values += r.lows if r["from"] + r.low == 0 else 0
        taken = ends.get(r.file, (0, 0, 0, 0))[1] + r.bytes
        ends[r.file] = (r.start, taken, r["from"] + r.depth, r.size)
    for file, (start, taken, depth, size) in ends.items():
        shape = found[file]
        # the last piece may end without a bracket; the reader leaves out a byte order mark of three bytes
        closed = size - taken in (0, 3)
        if not closed:
            shape.unclosed = start
        if shape.first in ("[", "{") and depth != (0 if closed else -1):
            raise ValueError(f"{file}: the JSON document ends {depth + (not closed)} levels deep")
    return {file: shape for file, shape in found.items() if shape.first}


class _Cutter:
    """The parts of one block at one depth: records, and what stands between them."""

    def __init__(self, inside: bool, depth: int, level: int) -> None:
        self.inside, self.depth, self.level = inside, depth, level
        self.held: list[str] = []
        #: whether the record that is being read began in this block
        self.begun = depth <= level and not inside

    def cut(self, text: str) -> list[tuple[str | None, bool, str | None]]:
        """What ends in ``text``, in order: records (whether they began in this block, and what was read of them), and marks of lists.

        A mark holds the key of a list that opens one level above the records, or nothing where a list or object closes there. At
        the level itself, what stands between two records is taken as a record unless it is a comma or blank, so that
        nothing is lost and the parser sees what is no JSON.
        """
        out: list[tuple[str | None, bool, str | None]] = []
        at = begin = 0
        if self.inside:
            end = _STRING_END.match(text)
            if end is None:
                self.held.append(text)
                return out
            at, self.inside = end.end(), False

        def between(to: int) -> None:
            self.held.append(text[begin:to])
            if self.rest():
                out.append((None, True, "".join(self.held)))
            self.held.clear()

        for mark in _MARKS.finditer(text, at):
            c = mark.group()
            if c == '"':
                self.inside = True
                break
            if c in ("[", "{"):
                if self.depth == self.level:
                    between(mark.start())
                    begin, self.begun = mark.start(), True
                elif self.depth == self.level - 1:
                    key = _KEY.search("".join(self.held) + text[begin : mark.start()])
                    out.append((key[1] if key and c == "[" else "", True, None))
                    self.held.clear()
                    begin = mark.end()
                self.depth += 1
            elif c in ("]", "}"):
                self.depth -= 1
                if self.depth == self.level:
                    self.held.append(text[begin : mark.end()])
                    out.append((None, self.begun, "".join(self.held)))
                    self.held.clear()
                    begin, self.begun = mark.end(), True
                elif self.depth == self.level - 1:
                    between(mark.start())
                    out.append(("", True, None))
                    begin = mark.end()
        self.held.append(text[begin:])
        return out

    def rest(self) -> str:
        return "".join(self.held).strip(", \t\r\n\ufeff")


_CUT = "file string, start long, place long, list string, opens boolean, closes boolean, text string"


def _cut(spark: SparkSession, found: dict[str, Shape], level: int) -> DataFrame:
    """Marks (``list`` is not null) and records, or parts of records that cross blocks, in the order of ``start, place``."""
    states = {(file, start): (*state, shape.unclosed == start) for file, shape in found.items() for start, state in shape.blocks.items()}
    shared = spark.sparkContext.broadcast(states)
    names = [c.split()[0] for c in _CUT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        ahead, block, place = next(rows, None), None, 0

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return batch

        while ahead is not None:
            file, start, _, text = ahead
            if block != (file, start):
                block, place = (file, start), 0
                inside, depth, unclosed = shared.value.get(block, (False, 0, False))
                cutter = _Cutter(inside, depth, level)
            ahead = next(rows, None)
            last = ahead is None or ahead[:2] != block
            for key, began, record in cutter.cut(text if last and unclosed else text + "}"):
                place += 1
                out.append((file, start, place, key, began, True, record))
            if last and (cutter.inside or cutter.depth > level or (cutter.depth == level and cutter.rest())):
                out.append((file, start, place + 1, None, cutter.begun, False, "".join(cutter.held)))
            if len(out) >= 1000:
                yield packed()
        if out:
            yield packed()

    return _pieces(spark, list(found)).mapInArrow(cut, _CUT)


def _whole(parts: DataFrame) -> DataFrame:
    """``text`` of the records; those that cross blocks are put together, from at most two parts a block."""
    crossing = parts.where("not (opens and closes)")
    number = F.sum(F.col("opens").cast("long")).over(W.partitionBy("file").orderBy("start", "place"))
    pieces_of = F.array_sort(F.collect_list(F.struct("start", "place", "text")))
    joined = crossing.withColumn("number", number).groupBy("file", "number").agg(F.array_join(F.transform(pieces_of, lambda p: p["text"]), "").alias("text"))
    return parts.where("opens and closes").select("text").unionByName(joined.select("text"))


def _parsed(texts: DataFrame) -> DataFrame:
    """The records as columns. No JSON text holds the separator, so records stay as they were written, with their line breaks."""
    path = scratch_path(texts.sparkSession, "json-records")
    texts.write.text(path, lineSep="\x1e")
    return texts.sparkSession.read.json(path, lineSep="\x1e", mode="FAILFAST")


def read_records(spark: SparkSession, found: dict[str, Shape], level: int) -> DataFrame:
    """The records of files that hold one list (level 1) or one value behind the other (level 0)."""
    return _parsed(_whole(_cut(spark, found, level).where("list is null")))


def read_wrapped(spark: SparkSession, found: dict[str, Shape], names: tuple[str, ...]) -> tuple[list[DataFrame], list[str]]:
    """The records inside the first of the lists ``names`` of each object, by name, and the files that have none of them.

    The rest of such an object is not read. Of lists with one name the last counts, as for any JSON object.
    """
    path = scratch_path(spark, "json-parts")
    _cut(spark, found, 2).write.parquet(path)
    parts = spark.read.schema(_CUT).parquet(path)
    place = F.struct("start", "place")
    marks = parts.where("list is not null").select("file", "list", place.alias("begin"), F.lead(place).over(W.partitionBy("file").orderBy("start", "place")).alias("end"))
    wanted = marks.where(F.col("list").isin(*names)).withColumn("turn", F.array_position(F.array(*map(F.lit, names)), F.col("list")))
    zones = wanted.groupBy("file").agg(F.max_by(F.struct("list", "begin", "end"), F.struct(-F.col("turn"), "begin")).alias("zone")).select("file", "zone.*")
    held = {r.file: r.list for r in zones.select("file", "list").collect()}
    inner = parts.where("list is null").join(zones.withColumnRenamed("list", "name"), "file").where((place > F.col("begin")) & (place < F.col("end")))
    return [_parsed(_whole(inner.where(F.col("name") == name))) for name in names if name in held.values()], [f for f in found if f not in held]
