"""Nearest stored vectors for a few query vectors, and the upsert that keeps the store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbmark.functions.names import col

# Fixed value: results per query.
RESULTS = 3


def recall(
    store: DataFrame,
    queries: list[tuple[object, list[float]]],
    n_results: int = RESULTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``n_results`` nearest stored rows of each query vector by Euclidean distance, nearest first.

    The store is scanned once, by id and vector only. Each batch of it is reduced to its own nearest
    rows where it is read, so a task sends a few rows per query to the final ranking; ties go to the
    smaller id. Array arithmetic does this several times faster than an expression per element.
    Stored vectors that are null, of another length than the query, or hold a null or a value that is not
    finite have no distance and take no part.
    """
    id_type = store.schema[id_column].dataType.simpleString()
    names = store.sparkSession.createDataFrame(
        [(place, name) for place, (name, _) in enumerate(queries)], ["_query", "query_id"]
    )
    vectors = [np.asarray(vector, dtype=float) for _, vector in queries]

    def nearest_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for place, vector in enumerate(vectors):
                own = lengths == len(vector)
                if not own.any():
                    continue
                ids, stored = batch["id"].to_numpy()[own], np.stack(batch["v"].to_numpy()[own]).astype(float)
                with np.errstate(invalid="ignore", over="ignore"):
                    distances = np.sqrt(((stored - vector) ** 2).sum(axis=1))
                near = _nearest(ids, distances, n_results)
                yield pd.DataFrame({"_query": place, "id": ids[near], "distance": distances[near]})

    known = store.select(col(id_column).alias("id"), col(vector_column).alias("v")).where("v is not null")
    near = known.mapInPandas(nearest_of_batches, f"_query bigint, id {id_type}, distance double")
    order = W.partitionBy("_query").orderBy("distance", "id")
    ranked = near.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n_results)
    return ranked.join(names, "_query").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias(id_column), "distance"
    )


def _nearest(ids: np.ndarray, distances: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest finite distances, the smaller id first where they tie."""
    places = np.flatnonzero(np.isfinite(distances))
    if len(places) > n:
        places = places[distances[places] <= np.partition(distances[places], n - 1)[n - 1]]
    return places[np.lexsort((ids[places], distances[places]))][:n]


def upsert(store: DataFrame, updates: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One row per id: an update replaces the stored row; among updates the highest version wins.

    The maximum of a struct combines before the shuffle, so an id with very many versions is no
    hot spot.
    """
    names = store.columns
    both = store.select("*", F.lit(0).alias("_new")).unionByName(updates.select("*", F.lit(1).alias("_new")))
    rank = F.struct("_new", *([col(version).alias("_version")] if version else []), *[col(c) for c in names if c != key])
    last = both.groupBy(col(key)).agg(F.max(rank).alias("_last"))
    return last.select(*[col(c) if c == key else F.col("_last").getField(c).alias(c) for c in names])
