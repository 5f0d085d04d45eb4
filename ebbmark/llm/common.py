"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ebbmark.session import scratch_path

#: Rows in one Arrow batch: a batch of the longest documents still fits a Python worker.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, a null text as the empty one; no other column of ``docs`` can clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def map_texts(df: DataFrame, rows: Callable[[list[list]], list[list]], schema: str, finish: Callable[[], list[list]] | None = None) -> DataFrame:
    """Apply ``rows`` to the columns of each Arrow batch, as Python lists; it returns the output columns.

    ``finish`` gives the columns of a last batch of each task, from what ``rows`` has gathered in it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def packed(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(rows([c.to_pylist() for c in batch.columns]))
        if finish is not None:
            yield packed(finish())

    return df.mapInArrow(run, schema)


def digest(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text; together they stand for it as a grouping key."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


class Scratch:
    """The written tables of one operator run, by label. A table that a newer one replaces is deleted.

    A table is replaced only once the newer one is written, so a lost executor can still read what it needs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return the scan of it; frames that read the label's table of before are void."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        """Delete the table of ``label``, if there is one, and let Spark free the shuffles that nothing reads any more."""
        if old := self.paths.pop(label, None):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges(a, b)`` can reach: ``node, component``.

    Alternates large-star and small-star steps until no edge changes. Hubs are safe: a node's smallest
    neighbour is a partial minimum, and the join with it is an equi-join that adaptive execution splits.
    Each step is a written table, so a lost executor costs one step. No edges give no rows.
    """
    kind = edges.schema["a"].dataType
    pairs = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").cast(kind).alias("u"), F.least("a", "b").cast(kind).alias("v"))
        .distinct()
    )
    scratch = Scratch(edges.sparkSession)

    def written(table: DataFrame, label: str) -> tuple[DataFrame, dict]:
        """The staged pairs, and the count and sum of their hashes, which the job that writes them takes along."""
        seen = Observation(f"{label}-pairs")
        found = F.count(F.lit(1)).alias("pairs"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
        return scratch.stage(table.observe(seen, *found), label), seen.get

    pairs, now = written(pairs, "edges")
    before = None
    while True:
        if not now["pairs"] or now == before:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.stage(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
