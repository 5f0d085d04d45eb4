"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbmark.llm.common import Scratch

#: Neighbours of a node in the graph, and how many nodes that name it are looked at as well.
DEGREE, REVERSE = 32, 24
#: First graph: so many orders of the nodes in each of two turns, each by the nearest of so many sampled centres, cut into blocks.
ORDERS, CENTRES, BLOCK = 8, 64, 1024
#: The descent ends with the round that changes a smaller share of the edges.
FEW_CHANGED = 0.01
#: Search: nodes kept per query, and nodes expanded per query and round.
BEAM, EXPAND = 128, 64
#: Nodes from all over the graph where each search begins as well.
ENTRIES = 64
NEAREST = 20

_NODES = "node long, vector array<float>"
_EDGES = "node long, other long, score float"


def usable(vector: str) -> str:
    """SQL: a vector that is not null, has only finite components, and not only zeros."""
    return f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vector}, x -> x <> 0)"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def _best(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` best-scored rows per node; each task first keeps its own best."""
    order = Window.partitionBy("node").orderBy(F.desc("score"), "other")
    return df.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).drop("at")


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _better_pairs(ids: np.ndarray, scores: np.ndarray, floors: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a square score matrix its best others above the row's floor, ``DEGREE`` at most.

    With ``fresh``, only pairs with a fresh member: the others have met before.
    """
    np.fill_diagonal(scores, -np.inf)
    if fresh is not None:
        scores[np.ix_(~fresh, ~fresh)] = -np.inf
    most = min(DEGREE, len(ids) - 1)
    if most < 1:
        return ids[:0], ids[:0], scores[0, :0]
    best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    found = np.take_along_axis(scores, best, 1)
    row, column = np.nonzero(found > floors[:, None])
    return ids[row], ids[best[row, column]], found[row, column]


def _with_floors(nodes: DataFrame, graph: DataFrame | None) -> DataFrame:
    """The nodes, each with the score that a new neighbour must beat."""
    least = F.lit(float("-inf")).cast("float")
    if graph is None:
        return nodes.withColumn("floor", least)
    full = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= DEGREE, F.min("score")).alias("floor"))
    return nodes.join(full, "node", "left").withColumn("floor", F.coalesce("floor", least))


def _merged(found: DataFrame, graph: DataFrame | None) -> DataFrame:
    both = found if graph is None else found.unionByName(graph)
    return _best(both.groupBy("node", "other").agg(F.max("score").alias("score")), DEGREE)


def _first_graph(nodes: DataFrame, turn: int, tasks: int) -> DataFrame:
    """Neighbours within blocks of nodes that share a nearest centre, in the order of their score with it.

    ``nodes`` have floors. The centres of all orders of a turn are a bounded sample; the orders are one range
    partition, so a crowded centre spreads over tasks.
    """
    sample = [r.vector for r in nodes.orderBy(F.xxhash64(F.lit(turn), "node"), "node").limit(ORDERS * CENTRES).select("vector").collect()]
    if not sample:
        return nodes.sparkSession.createDataFrame([], _EDGES)
    centres = [np.array(sample[i::ORDERS], np.float32) for i in range(ORDERS) if sample[i::ORDERS]]
    placed_kind = _NODES + ", floor float, order int, centre int, near float"
    placed_schema, edge_schema = _arrow(placed_kind), _arrow(_EDGES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for order, group in enumerate(centres):
                scores = x @ group.T
                nearest = scores.argmax(1)
                yield _rows(placed_schema, *batch.columns, np.full(len(x), order, np.int32), nearest.astype(np.int32), scores[np.arange(len(x)), nearest])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def joined(parts):
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            ids, x = rows.column(0).to_numpy(), _matrix(rows.column(1))
            ids, at = np.unique(ids, return_index=True)  # where two orders meet, a node may stand twice
            x = x[at]
            return _rows(edge_schema, *_better_pairs(ids, x @ x.T, rows.column(2).to_numpy()[at]))

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, BLOCK - size)
                held.append(part)
                size += len(part)
                at += len(part)
                if size == BLOCK:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    placed = nodes.select("node", "vector", "floor").mapInArrow(place, placed_kind)
    ordered = placed.repartitionByRange(tasks, "order", "centre", "near", "node").sortWithinPartitions("order", "centre", "near", "node")
    return ordered.select("node", "vector", "floor").mapInArrow(blocks, _EDGES)


def _descend(nodes: DataFrame, around: DataFrame, tasks: int) -> DataFrame:
    """Edges that beat the floors, from comparing the nodes of each list ``around`` (node, other, fresh).

    Only lists with a fresh member are read, and only pairs with one compared.
    """
    active = around.where("fresh").select("node").distinct()
    listed = around.join(active, "node", "left_semi").withColumnRenamed("node", "centre")
    lists = listed.join(nodes.withColumnRenamed("node", "other"), "other").select("centre", "other", "vector", "floor", "fresh")
    edge_schema = _arrow(_EDGES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(rows: pa.RecordBatch) -> pa.RecordBatch:
            centre, ids, x = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _matrix(rows.column(2))
            floors, fresh = rows.column(3).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.append(centre[1:] != centre[:-1], True)) + 1
            out, start = [], 0
            for end in ends:
                out.append(_better_pairs(ids[start:end], x[start:end] @ x[start:end].T, floors[start:end], fresh[start:end]))
                start = end
            return _rows(edge_schema, *(np.concatenate(c) for c in zip(*out, strict=True)))

        for batch in batches:
            rows = pa.Table.from_batches([*(rest.to_batches() if rest is not None else ()), batch]).combine_chunks().to_batches()
            if not rows:
                continue
            centre = rows[0].column(0).to_numpy()
            last = int(np.searchsorted(centre, centre[-1]))  # the last list may go on
            if last:
                yield groups(rows[0].slice(0, last))
            rest = pa.Table.from_batches([rows[0].slice(last)])
        if rest is not None and len(rest):
            yield groups(rest.combine_chunks().to_batches()[0])

    return lists.repartition(tasks, "centre").sortWithinPartitions("centre").mapInArrow(compare, _EDGES)


def _named(graph: DataFrame) -> DataFrame:
    """For each node the best of the nodes that name it: a bounded list, also of a node that very many name."""
    return _best(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score"), REVERSE)


def neighbour_graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, other, score``: about the ``DEGREE`` nearest others of each of the distinct vectors ``nodes``.

    Around each node stand its neighbours, the best of the nodes that name it, and itself; nodes that share
    such a list are compared, and each keeps its best. This goes on until a round changes few edges.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph = scratch.stage(_merged(_first_graph(_with_floors(nodes, None), 0, tasks), None), "graph-0")
    graph = scratch.stage(_merged(_first_graph(scratch.stage(_with_floors(nodes, graph), "floors"), 1, tasks), graph), "graph-1")
    scratch.drop("graph-0")
    before, turn = None, 1
    while True:
        itself = nodes.select("node", F.col("node").alias("other"))
        around = graph.select("node", "other").union(_named(graph).select("node", "other")).union(itself).distinct()
        if before is None:
            around = around.withColumn("fresh", F.lit(True))
        else:
            met = before.select("node", "other").withColumn("met", F.lit(True))
            around = around.join(met, ["node", "other"], "left").select("node", "other", F.col("met").isNull().alias("fresh"))
        turn += 1
        around = scratch.stage(around, f"around-{turn % 2}")
        floors = scratch.stage(_with_floors(nodes, graph), "floors")
        newer = scratch.stage(_merged(_descend(floors, around, tasks), graph), f"graph-{turn % 2}")
        changed = newer.join(graph.select("node", "other"), ["node", "other"], "left_anti").count()
        few = changed <= FEW_CHANGED * newer.count()
        graph, before = newer, around
        if few:
            return graph


def nearest(vectors: DataFrame, queries: str, *, most: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``most`` best inner products found for each row that meets ``queries``.

    Every row is a candidate but the query's own. Equal vectors are one node of the graph, and each stands for
    its smallest ids, as many as a result can need. Inner products become distances by one more component,
    which gives every vector the length of the longest, so the graph suits vectors of any length. A search
    begins at the query's own node and at nodes sampled from all, and expands the best nodes found, along edges of
    both directions, until all of the best are expanded. So a closed group of near copies does not hold it, and a
    query has fewer than ``most`` rows only if there are fewer candidates. Rows whose vector is null, zero or holds null or non-finite components take no part, nor do
    null ids; ties go to smaller ids; equal rows count each; an empty table gives no rows. All vectors have one
    length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("vector")).where(f"id is not null and {usable('vector')}")
    alike = Window.partitionBy("vector").orderBy("id")
    members = rows.withColumns({"at": F.row_number().over(alike), "node": F.first("id").over(alike.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    scratch = Scratch(spark)
    members = scratch.stage(members.where(F.col("at") <= most + 1).select("node", "id", "at", "vector"), "members")
    originals = members.where("at = 1").select("node", "vector")
    square = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    longest = originals.agg(F.max(square)).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    extra = F.sqrt(F.greatest(F.lit(longest) - square, F.lit(0.0))).cast("float")
    nodes = scratch.stage(originals.select("node", F.concat("vector", F.array(extra)).alias("vector")).repartition("node"), "nodes")
    graph = neighbour_graph(nodes, scratch)
    links = scratch.stage(graph.select("node", "other").union(_named(graph).select("node", "other")).distinct(), "links")
    lists = scratch.stage(links.groupBy("node").agg(F.collect_list("other").alias("others")), "lists")
    for label in ("graph-0", "graph-1", "around-0", "around-1", "floors", "links"):
        scratch.drop(label)

    asked = rows.where(queries).select(F.col("id").alias("query_id"), "vector")
    asked = asked.join(originals, "vector").select("query_id", "node")
    asking = scratch.stage(asked.select(F.col("node").alias("query")).distinct().join(originals.withColumnRenamed("node", "query"), "query"), "queries")
    beam = asking.select("query", F.col("query").alias("node"), F.lit(float("inf")).cast("float").alias("score"), F.lit(False).alias("seen"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    kept, turn = max(BEAM, 2 * most), 0
    # a node is scored once per query, also if it does not stay among the best
    met = scratch.stage(beam.select("query", "node"), "met")
    both = _arrow("query long, node long, score float, seen boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, q = (_matrix(batch.column(i)).astype(np.float64) for i in (2, 3))
            yield _rows(both, batch.column(0), batch.column(1), np.einsum("ij,ij->i", v, q).astype(np.float32), np.zeros(len(batch), bool))

    # so many entries fill a result by themselves
    entries = nodes.select("node").orderBy(F.xxhash64(F.lit("entry"), "node"), "node").limit(max(ENTRIES, most + 1))
    entries = scratch.stage(asking.select("query").crossJoin(F.broadcast(entries)), "entries")
    while True:
        fresh = beam.where("not seen").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= EXPAND).select("query", "node")
        fresh = scratch.stage(fresh, "fresh")
        if fresh.limit(1).count() == 0:
            break
        reached = fresh.join(lists, "node").select("query", F.explode("others").alias("node"))
        reached = (reached if turn else reached.unionByName(entries)).distinct()
        reached = scratch.stage(reached.join(met, ["query", "node"], "left_anti"), "reached")
        met = scratch.stage(met.unionByName(reached), "met")
        scored = reached.join(originals.withColumnRenamed("vector", "v"), "node").join(asking.withColumnRenamed("vector", "q"), "query")
        scored = scored.select("query", "node", "v", "q").mapInArrow(score, "query long, node long, score float, seen boolean")
        marked = beam.join(fresh.withColumn("now", F.lit(True)), ["query", "node"], "left")
        marked = marked.select("query", "node", "score", (F.col("seen") | F.coalesce("now", F.lit(False))).alias("seen"))
        ranked = marked.unionByName(scored).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= kept)
        turn += 1
        beam = scratch.stage(ranked.drop("turn"), f"beam-{turn % 2}")

    own = asked.join(asking, F.col("node") == F.col("query")).select("query_id", "query", F.col("vector").alias("q"))
    expanded = beam.select("query", "node").join(members.select("node", "id", F.col("vector").alias("v")), "node")
    exact = expanded.join(asking.withColumnRenamed("vector", "q"), "query").select("query", "id", product.alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    exact = exact.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most + 1).drop("turn")
    answers = own.select("query_id", "query").join(exact, "query").where("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op9(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, "id % 20 = 0")
