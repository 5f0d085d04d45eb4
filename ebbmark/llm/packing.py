"""Best-fit packing: each part goes to the fullest bin that has room and holds neither its source nor its cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.session import stage

#: Words in a bin.
CAPACITY = 2048
#: Rows that one task packs, on average; the number of tasks grows with the table.
SHARD_ROWS = 2000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each part, parts given in the order of packing.

    Bins are ordered by what room is left. The search starts at the first bin with enough room, the tightest,
    and goes on to its successors until one holds neither the part's source nor its cluster; else a new bin
    opens. Equal rooms prefer the older bin. A null source conflicts with nothing.
    """
    bits: dict[tuple, int] = {}
    rooms: list[tuple[int, int]] = []
    held: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        mask = 0
        for key in (("source", source), ("cluster", cluster)):
            if key[1] is not None:
                mask |= 1 << bits.setdefault(key, len(bits))
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and held[rooms[at][1]] & mask:
            at += 1
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(held)
            held.append(0)
        placed.append((number, capacity - room))
        held[number] |= mask
        if room > size:
            insort(rooms, (room - size, number))
    return placed


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``doc_id, part, first_word, n_words, bin, bin_offset``: every word of every row, in bins of ``capacity`` words.

    A text is cut into parts of ``capacity`` words; full parts fill a bin each, the rest of each text is packed:
    longest first, in shards dealt by row number, so that no key decides where a row goes. In a bin no two rows
    share a source or a cluster (texts that are equal in lower case). Rows without words get one row without
    a bin. Null texts count as empty, a null source conflicts with nothing, repeated rows are packed each, an
    empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("doc_id"),
        F.when(docs[source_col].isNotNull(), F.xxhash64(docs[source_col])).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.xxhash64(F.lower(text)).alias("cluster"),
    )
    rows = stage(rows, "parts")
    full = rows.where(F.col("words") >= capacity).select(
        "row", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("words") / capacity) - 1)).alias("part")
    )
    full = full.select(
        "doc_id",
        "part",
        (F.col("part") * capacity).alias("first_word"),
        F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("full"), "row", "part").alias("bin"),
        F.lit(0).cast("long").alias("bin_offset"),
    )
    none = rows.where("words = 0").select(
        "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("part", "first_word", "n_words")), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_offset")
    )
    shards = max(1, -(-rows.count() // shard_rows))
    rest = rows.withColumns({"part": F.floor(F.col("words") / capacity), "n_words": F.col("words") % capacity}).where("n_words > 0")
    rest = rest.select("row", "doc_id", "source", "cluster", "part", "n_words", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def pack_shard(part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_words", "descending"), ("row", "ascending")])
        placed = best_fit(*(part[c].to_pylist() for c in ("n_words", "source", "cluster")), capacity)
        shard = part["shard"][0].as_py()
        numbers = part["part"].to_pylist()
        columns = {
            "doc_id": part["doc_id"],
            "part": part["part"],
            "first_word": pa.array([n * capacity for n in numbers], pa.int64()),
            "n_words": part["n_words"],
            "bin": pa.array([f"{shard}-{number}" for number, _ in placed]),
            "bin_offset": pa.array([offset for _, offset in placed], pa.int64()),
        }
        return pa.table(columns)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, part long, first_word long, n_words long, bin string, bin_offset long"
    packed = rest.groupBy("shard").applyInArrow(pack_shard, schema)
    return packed.unionByName(full).unionByName(none)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs)
