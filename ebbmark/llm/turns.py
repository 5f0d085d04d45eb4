"""Conversation repair: a lightest derivation over the rows of a conversation, found with Knuth's agenda."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.session import stage

# Prices of the edits; a kept or reroled row that is cut off costs more.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Initials that may follow each other in a conversation, as the report counts them.
LEGAL_PAIRS = ("su", "ua", "au")
#: What the last kept row leaves open: nothing yet, a system row, a user row, an assistant row.
STATES = "-sua"
#: The next user or assistant row, by state, and the roles that edits give.
_NEXT, _ROLE = {"-": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
#: States in which a conversation may end, and the item that says so.
CLOSED, GOAL = "-a", "goal"
#: Rows whose repairs are derived at a time; longer conversations are put together from such stretches.
STRETCH = 2048
#: Row signatures whose derivations a task remembers at a time.
REMEMBERED = 50_000

BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"


def edits_of(initial: str, fault: str, state: str) -> Iterator[tuple[int, str, str]]:
    """Cost, edit and next state of each way to use a row behind ``state``."""
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT_OFF if fault == TRUNCATED else 0
    following = _NEXT[state]
    if initial == following or (initial == "s" and state == "-"):
        yield KEEP + extra, "K", initial
    yield REROLE + extra, "R", following


def lightest(edges: Callable[[object], Iterator[tuple[int, str, object]]], start: object, goal: object = None) -> dict[object, tuple[int, str]]:
    """Least (cost, audit) of the items derivable from ``start``, up to the goal; of all of them without a goal.

    A deduction adds a cost and an edit to the value of an item. Knuth's agenda pops items by value, which needs superior
    functions: a further edit never makes a value smaller, and a smaller value stays smaller under the same
    edit. The second holds because of two derivations of an item with equal costs, neither audit begins the other: the
    shorter one would lack insertions only, and these cost.
    """
    agenda, order, final = [(0, "", 0, start)], 1, {}
    while agenda:
        cost, audit, _, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        if goal is not None and item == goal:
            break
        for more, edit, head in edges(item):
            if head not in final:
                heapq.heappush(agenda, (cost + more, audit + edit, order, head))
                order += 1
    return final


def derived(signs: str, start: str, whole: bool) -> dict[str, tuple[int, str]]:
    """Least (cost, audit) of a stretch of rows behind state ``start``, by the state that it ends in.

    ``signs`` holds two characters a row, its role's initial and its fault; items are (rows used, state). A whole
    conversation has a goal item, and its agenda ends when that finalises.
    """
    n = len(signs) // 2

    def edges(item: tuple[int, str]) -> Iterator[tuple[int, str, object]]:
        used, state = item
        if whole and used == n and state in CLOSED:
            yield 0, "", (n, GOAL)
        yield INSERT, "I", (used, _NEXT[state])
        if used < n:
            for cost, edit, following in edits_of(signs[2 * used], signs[2 * used + 1], state):
                yield cost, edit, (used + 1, following)

    if whole:
        return {GOAL: lightest(edges, (0, start), (n, GOAL))[n, GOAL]}
    return {state: value for (used, state), value in lightest(edges, (0, start)).items() if used == n}


def joined(left: dict[str, dict], right: dict[str, dict]) -> dict[str, dict]:
    """Two neighbouring stretches as one: deductions with two antecedents, of which each result keeps the lightest."""
    out: dict[str, dict] = {}
    for start, ends in left.items():
        best = out.setdefault(start, {})
        for middle, (cost, audit) in ends.items():
            for end, (more, edits) in right.get(middle, {}).items():
                value = (cost + more, audit + edits)
                if end not in best or value < best[end]:
                    best[end] = value
    return out


def rows_after(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows."""
    state = "-"
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        state = _NEXT[state] if edit == "R" else role[0]
        yield _ROLE[state] if edit == "R" else role, text


def _clean(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(
        rows[conv_col].alias("conv_id"),
        rows[turn_col].cast("long").alias("turn"),
        F.coalesce(rows[role_col].cast("string"), blank).alias("role"),
        F.coalesce(rows[text_col].cast("string"), blank).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with some rows damaged, by a checksum of conversation and turn; a null there is one space."""
    rows = _clean(conversations, "conv_id", "turn", "role", "text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """With two digests of role and text, which also order the rows of one turn and role."""
    return rows.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit("second"), "role", "text")})


ORDER = ("turn", "role", "d1", "d2")


def _signs(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones as one row with their number: ``conv_id, turn, role, d1, d2, fault, n, later``.

    ``later`` says that an earlier turn has the same role and text. Equal rows are counted before they move, and the turns
    in which a row occurs more than once are few, so no frequent text gathers anywhere.
    """
    solid = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    fault = F.when(solid == "", BLANK).when(~solid.isin(".", "!", "?"), TRUNCATED).otherwise("-")
    light = _in_order(rows).select("conv_id", *ORDER, fault.alias("fault")).groupBy("conv_id", *ORDER, "fault").agg(F.count(F.lit(1)).alias("n"))
    light = stage(light, "turn-signs")
    again = light.groupBy(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("turns"))
    again = stage(again.where("turns > 1").drop("turns"), "turns-again")
    same = light["conv_id"].eqNullSafe(again["c"]) & (light["d1"] == again["e1"]) & (light["d2"] == again["e2"])
    return light.join(again, same, "left").select("conv_id", *ORDER, "fault", "n", F.coalesce(F.struct("turn") > F.col("earliest"), F.lit(False)).alias("later"))


@dataclass
class Report:
    """What a stretch of rows of one conversation tells about it."""

    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    signs: list[str] = field(default_factory=list)

    def add(self, initial: str, fault: str, turn: int | None) -> None:
        if self.signs:
            self.illegal += self.last + initial not in LEGAL_PAIRS
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self.signs.append(initial + fault)


REPORTED = ("blank", "duplicate", "truncated", "illegal")
PART = "first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, repairs string"


def _streamed(df: DataFrame, schema: str, run: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``run`` over the rows of each task, one after the other; it yields the output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], schema=arrow)
            held.clear()
            return out

        for row in run(row for batch in found for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            held.append(row)
            if len(held) >= 1000:
                yield packed()
        if held:
            yield packed()

    return df.mapInArrow(batches, schema)


def _parts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The stretches of sorted rows of one task, with their repairs behind each state that may come before them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    known: dict[tuple[str, str, bool], str] = {}
    report, conv, begun, at_start, fresh = Report(), None, False, True, True

    def part(ended: bool) -> tuple:
        # rows of the conversation may stand in the task before, in the task behind, or in the stretch before
        starts = "-" if fresh and not at_start else STATES
        signs, whole = "".join(report.signs), fresh and ended and not at_start
        if len(known) > REMEMBERED:
            known.clear()
        if (signs, starts, whole) not in known:
            known[signs, starts, whole] = json.dumps({s: derived(signs, s, whole) for s in starts})
        r = report
        return (conv, number, r.first, r.last, r.low, r.high, r.turns, r.blank, r.duplicate, r.truncated, r.illegal, known[signs, starts, whole])

    for now, turn, role, _, _, fault, n, later in rows:
        if begun and now != conv:
            yield part(True)
            number += 1
            report, at_start, fresh = Report(), False, True
        conv, begun = now, True
        for copy in range(n):
            if len(report.signs) >= STRETCH:
                yield part(False)
                number += 1
                report, fresh = Report(), False
            report.add(role[:1] or " ", DUPLICATE if fault != BLANK and (later or copy) else fault, turn)
    if begun:
        yield part(False)


def _whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The reports and repairs of whole conversations from their stretches, which are joined pairwise like the digits of a counter."""
    conv, begun, total, stack = None, False, Report(), []

    def ready() -> tuple:
        repairs = stack.pop()[1]
        while stack:
            repairs = joined(stack.pop()[1], repairs)
        cost, audit = min(tuple(v) for end, v in repairs["-"].items() if end in (*CLOSED, GOAL))
        gaps = 0 if total.low is None else total.high - total.low + 1 - total.turns
        return (conv, gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost, audit)

    for now, _, first, last, low, high, turns, *counts, repairs in rows:
        if begun and now != conv:
            yield ready()
            total = Report()
        elif begun:
            total.illegal += total.last + first not in LEGAL_PAIRS
        conv, begun = now, True
        total.last = last
        if low is not None:
            total.turns += turns - (low == total.high)
            total.low, total.high = low if total.low is None else total.low, high
        for name, n in zip(REPORTED, counts, strict=True):
            setattr(total, name, getattr(total, name) + n)
        entry = (1, {s: {e: tuple(v) for e, v in ends.items()} for s, ends in json.loads(repairs).items()})
        while stack and stack[-1][0] == entry[0]:
            entry = (2 * entry[0], joined(stack.pop()[1], entry[1]))
        stack.append(entry)
    if begun:
        yield ready()


FINAL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs_of(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``FINAL`` of each conversation of ``rows(conv_id, turn, role, text)``, written."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", *ORDER)
    sorted_rows = _signs(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = stage(_streamed(sorted_rows, f"conv_id {kind}, seq long, {PART}", _parts), "turn-stretches")
    whole = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return stage(_streamed(whole, f"conv_id {kind}, {FINAL}", _whole), "turn-repairs")


def _replayed(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's repairs, then its rows in order; one task streams a conversation, as its digest is a chain."""
    kind = rows.schema["conv_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    values = [f.name for f in repairs.schema if f.name != "conv_id"]
    first = repairs.select("conv_id", F.lit(0).alias("of"), none("long").alias("turn"), none("string").alias("role"), none("long").alias("d1"), none("long").alias("d2"), none("string").alias("text"), *values)
    then = _in_order(rows).select(F.col("conv_id").cast(kind), F.lit(1).alias("of"), *ORDER, "text", *(none(repairs.schema[v].dataType).alias(v) for v in values))
    both = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "of", *ORDER)
    return both.select("conv_id", "of", "turn", "role", "text", *values)


def repaired(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows: ``conv_id, position, role, text``, positions from 0.

    Rows are taken by turn, nulls first, then by role and a digest; a null role or text is one space. Blank rows
    and repeats of a row go, the rest is kept, given another role, deleted or completed by empty rows so that roles
    read system at most once, then user and assistant in turn. A row of an empty role can only be deleted or given another. Conversations
    without a row left give none; an empty table gives no rows; other columns are not read.
    """
    rows = _clean(conversations, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def replay(found: Iterator[tuple]) -> Iterator[tuple]:
        for conv, edits, own in _conversations(found):
            for i, (role, text) in enumerate(rows_after(edits[-1], own)):
                yield conv, i, role, text

    return _streamed(_replayed(rows, repairs_of(rows)), f"conv_id {kind}, position long, role string, text string", replay)


def _conversations(found: Iterator[tuple]) -> Iterator[tuple[object, tuple, Iterator[tuple[str, str]]]]:
    """Each conversation with its repairs and a stream of its rows, from what ``_replayed`` gives."""
    ahead = next(found, None)
    while ahead is not None:
        conv, values = ahead[0], ahead[5:]
        ahead = next(found, None)

        def own() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[1] == 1:
                row, ahead = ahead, next(found, None)
                yield row[3], row[4]

        rows = own()
        yield conv, values, rows
        for _ in rows:  # what the reader left
            pass


def repair_report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``every``: the counts, cost and audit of its repair and a digest of the repaired rows.

    ``rows`` are ``conv_id, turn, role, text`` without null roles or texts. A null conversation is one like any other;
    ``gaps`` leave null turns out; a conversation of ``every`` without rows has zeros and empty texts. Equal rows are
    counted, not moved; stretches of a long conversation are repaired in several tasks and joined. Its digest is a
    chain over its rows, so one task streams them, and holds one row and the audit at a time.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = repairs_of(rows)
    ids = every.select(F.col("conv_id").alias("c")).distinct()
    values = [f.name for f in found.schema if f.name != "conv_id"]
    filled = [F.coalesce(F.col(v), F.lit("" if v == "audit" else 0)).alias(v) for v in values]
    full = ids.join(found, ids["c"].eqNullSafe(found["conv_id"]), "left").select(F.col("c").alias("conv_id"), *filled)

    def digests(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, report, own in _conversations(stream):
            digest, between = hashlib.sha256(), b""
            for role, text in rows_after(report[-1], own):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield (conv, *report, digest.hexdigest())

    return _streamed(_replayed(rows, full), f"conv_id {kind}, {FINAL}, repaired_sha256 string", digests)


def op12(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return repair_report(damaged(conversations), conversations)
