"""Substring dedup: lines, paragraphs and their sentences are hashed, and only the earliest occurrence of each stays."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, whole_texts
from ebbmark.session import stage

#: Units with fewer words and fewer characters are too short to be a copied passage; they count with their neighbours.
LEAST_WORDS, LEAST_CHARS = 5, 30
#: A sentence ends behind closing punctuation and the space after it, or behind closing punctuation of full width.
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")

Piece = tuple[int, int, str]


def _piece(text: str, start: int, end: int) -> Piece:
    """A stretch and its form: lower case, one space between words."""
    return start, end, " ".join(text[start:end].lower().split())


def _sentences(text: str, start: int, end: int) -> list[Piece]:
    found, at = [], start
    for m in _SENTENCE_END.finditer(text, start, end):
        found.append(_piece(text, at, m.start()))
        at = m.end()
    found.append(_piece(text, at, end))
    return [p for p in found if p[2]]


def _short(form: str) -> bool:
    return len(form) < LEAST_CHARS and form.count(" ") + 1 < LEAST_WORDS


def _completed(row: list[Piece]) -> list[Piece]:
    """Each piece; in place of a short one, it with as many followers as it needs, at the end with those before it."""
    found = []
    for i, piece in enumerate(row):
        if not _short(piece[2]):
            found.append(piece)
            continue
        start, end, form = piece
        for _, end, more in row[i + 1 :]:
            form = f"{form} {more}"
            if not _short(form):
                break
        else:
            for start, _, more in reversed(row[:i]):
                form = f"{more} {form}"
                if not _short(form):
                    break
        found.append((start, end, form))
    return found


def units(text: str) -> dict[tuple[int, int], str]:
    """Start and end of a text's units, with their forms.

    Units are its lines and their sentences, its paragraphs between blank lines and their sentences. What is too short
    goes with its neighbours of the same kind; a text too short for any unit is one as a whole.
    """
    lines, paragraphs, sentences, at, gap = [], [], [], 0, True
    for line in text.split("\n"):
        piece = _piece(text, at, at + len(line))
        at += len(line) + 1
        if not piece[2]:
            gap = True
            continue
        lines.append(piece)
        if gap:
            paragraphs.append([])
        paragraphs[-1].append(piece)
        gap = False
    found = {}
    for held in paragraphs:
        start, end = held[0][0], held[-1][1]
        whole = start, end, held[0][2] if len(held) == 1 else " ".join(p[2] for p in held)
        if not _short(whole[2]):
            found[start, end] = whole[2]
        own = _sentences(text, start, end)
        sentences += own
        if len(held) > 1:
            for line in held:
                parts = _sentences(text, line[0], line[1])
                if len(parts) > 1:
                    found.update(((a, b), form) for a, b, form in parts if not _short(form))
    for row in (lines, sentences):
        found.update(((start, end), form) for start, end, form in _completed(row))
    return found


_PLACE = ("doc_id", "t", "start", "end")


def _units_of(texts: DataFrame, kind: str) -> DataFrame:
    import xxhash

    def rows(c: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], [], []]
        for doc, t, text in zip(*c, strict=True):
            held = units(text)
            n = len(held)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(form.encode()) for form in held.values()), np.int64)
            for column, x in zip(out, ([doc] * n, [t] * n, [a for a, _ in held], [b for _, b in held], digests[::2].tolist(), digests[1::2].tolist()), strict=True):
                column += x
        return out

    return map_texts(texts, rows, f"doc_id {kind}, t long, start long, end long, d1 long, d2 long")


def _maximal(df: DataFrame, kind: str) -> DataFrame:
    """Of the ranges of each document those that lie in no other one; a batch is judged as a whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ranges = lists.flatten()
            sizes = np.diff(np.asarray(lists.offsets))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            start, end = (ranges.field(x).to_numpy() for x in ("start", "end"))
            order = np.lexsort((-end, start, owner))
            owner, end = owner[order], end[order]
            # a range lies in an earlier one of its document exactly if that reaches as far
            reach = owner * (int(end.max(initial=0)) + 1) + end
            keep = np.ones(len(order), bool)
            keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
            keep |= np.concatenate([[True], owner[1:] != owner[:-1]])[: len(order)]
            kept = ranges.take(pa.array(order[keep]))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept).cast(arrow.field(2).type)], schema=arrow)

    return df.mapInArrow(run, df.schema)


def ranges_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, ranges`` of the documents that repeat units of earlier ones: ``t`` is a digest of the text, ``ranges`` the
    structs of ``repeated_units``. Rows of equal id and text are one document.

    Units are found once and written. A hot unit shrinks to its first place before the shuffle; the places are written
    before the join with them, so that adaptive execution can split the unit's rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = whole_texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = stage(_units_of(texts, kind), "text-units")
    place = F.struct(*_PLACE)
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    first = stage(first.select("d1", "d2", "first"), "first-units")
    later = found.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    one = F.struct("start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("first.end").alias("kept_end"))
    # the ranges of one document: bounded by its text, however often it is in the table
    return _maximal(later.groupBy("doc_id", "t").agg(F.collect_set(one).alias("ranges")), kind)


def repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, kept_doc_id, kept_start, kept_end`` of every unit that repeats an earlier one and lies in no
    other such unit of its text.

    Units are lines, paragraphs between blank lines, and the sentences of both, of at least five words or 30
    characters, equal in lower case with single spaces; so a paragraph wrapped at other columns is the same. A
    shorter line or sentence makes a unit with its neighbours, a shorter text is one as a whole. A repeat that begins or ends
    inside a sentence of a longer line is not found. Earlier means a smaller id, then text digest, then offset; offsets are code points of the
    original text, end exclusive. Whole texts count, however long. Null and empty texts have no units; equal rows are one place, so a
    repeated row adds nothing; null ids rank first; an empty table gives no rows; no other column is read.
    """
    return ranges_of(docs, id_col=id_col, text_col=text_col).select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.*")


def cut_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text without the given ranges; a line that loses all it held goes with its line break."""
    kept, marks, size, at = [], [], 0, 0
    for start, end in sorted(ranges):
        if start > at:
            kept.append(text[at:start])
            size += start - at
        at = max(at, end)
        marks.append(size)
    kept.append(text[at:])
    left, lines, begin, mark = "".join(kept), [], 0, 0
    for line in left.split("\n"):
        end = begin + len(line)
        cut = False
        while mark < len(marks) and marks[mark] <= end:
            cut |= marks[mark] >= begin
            mark += 1
        if not cut or line.strip():
            lines.append(line)
        begin = end + 1
    return "\n".join(lines)


def _cut(text: Column, ranges: Column) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_ranges(t, list(zip(s.tolist(), e.tolist(), strict=True))) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    return cut(text, ranges["start"], ranges["end"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated units cut from the texts; all rows and columns stay, whatever their names, and a null text stays null.

    Nulls, repeated rows, very long texts and empty tables are treated as in ``repeated_units``. A row loses the units of its
    own text only, should other rows have its id.
    """
    text = docs[text_col].cast("string")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("of"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))
    cuts = ranges_of(docs, id_col=id_col, text_col=text_col)
    joined = held.join(cuts, held["of"].eqNullSafe(cuts["doc_id"]) & (held["digest"] == cuts["t"]), "left")
    own = F.col("row").getField(text_col)
    new = F.when(F.col("ranges").isNull(), own).otherwise(_cut(own.cast("string"), F.col("ranges")))
    return joined.select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return repeated_units(docs)
