"""Importance resampling: documents are drawn by how much likelier their word runs are in a target collection."""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, whole_texts
from ebbmark.session import stage

#: Production parameters: buckets of the hashed features, longest run of words, share drawn in hundredths, least words, seed.
BUCKETS, RUN, SHARE, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Rank error of the quantile sketch as one part of so many, and the half widths of the brackets around the cutoff, in such errors.
ACCURACY, WIDTHS = 10_000, (2, 8, 64, 1024)

# Bytes of a word are the digits, the letters a to z and all bytes of other characters.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A to Z only) as UTF-8."""
    return text.encode().translate(_FOLDED).split()


def buckets_of(words: list[bytes], run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``run`` consecutive words, repeats included.

    The checksum of a longer run continues that of the run without its last word.
    """
    ends = list(map(zlib.crc32, words))
    found = [ends]
    spaced = list(map(bytes.__add__, repeat(b" "), words))
    for length in range(1, run):
        ends = list(map(zlib.crc32, spaced[length:], ends))
        found.append(ends)
    return np.array([x for part in found for x in part], np.int64) % buckets


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts. Each task adds up its own array; the driver gets one row per bucket."""
    state: dict[str, np.ndarray] = {}

    def rows(c: list[list]) -> list[list]:
        total = state.setdefault("n", np.zeros(buckets, np.int64))
        for text in c[0]:
            total += np.bincount(buckets_of(words_of(text), run, buckets), minlength=buckets)
        return [[], []]

    def finish() -> list[list]:
        total = state.pop("n", np.zeros(buckets, np.int64))
        held = np.flatnonzero(total)
        return [held.tolist(), total[held].tolist()]

    summed = map_texts(texts.select("text"), rows, "bucket int, n long", finish).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source, rounded down."""
    buckets = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * float(source.sum() + buckets) / ((s + 1) * float(target.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths from a digest of the seed and the id; a null id is read as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of every row, written; ``row`` is unique.

    Two passes over the texts: one counts, one scores each document with the array of gains, which has a fixed size.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = whole_texts(docs, id_col, text_col)
    aims = target.select(F.coalesce(target[target_col].cast("string"), F.lit("")).alias("text"))
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(texts, run, buckets), bucket_counts(aims, run, buckets)))

    def rows(c: list[list]) -> list[list]:
        out: list[list] = [c[0], [], [], []]
        for text in c[1]:
            words = words_of(text)
            held = buckets_of(words, run, buckets)
            for column, x in zip(out[1:], (len(words), len(held), int(gain.value[held].sum())), strict=True):
                column.append(x)
        return out

    weighed = map_texts(texts, rows, f"doc_id {kind}, n_words long, n_features long, weight long")
    weighed = weighed.select(F.monotonically_increasing_id().alias("row"), "*", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score"))
    return stage(weighed, "resample-scores")


def numbered(df: DataFrame, label: str, *order: Column) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` sorted over all tasks and written with ``part`` and ``at``, its place in the part; and the parts' sizes in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", place)
    parts = parts.withColumn("part", F.shiftrightunsigned("place", 33)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place")
    parts = stage(parts, label)
    return parts, sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())


def cutoff(eligible: DataFrame, wanted: int, marks: list[tuple[int, int]]) -> tuple[int, int | None, int]:
    """Score, id and row of the last document drawn, of ``wanted`` by falling score and rising id (null ids last).

    ``marks`` are brackets of scores, each wider than the one before, the last one holding all. The counts outside
    a bracket are exact: the first one that holds the cutoff is sorted, nothing else is.
    """
    for low, high in marks:
        outside = eligible.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if outside.above < wanted <= outside.reached:
            break
    inside, sizes = numbered(eligible.where(F.col("score").between(low, high)).select("score", "doc_id", "row"), "resample-bracket", *_order())
    left = wanted - outside.above - 1
    for part, size in sizes:
        if left < size:
            last = inside.where((F.col("part") == part) & (F.col("at") == left)).first()
            return last.score, last.doc_id, last.row
        left -= size
    raise AssertionError("the bracket holds the cutoff")


def _order() -> tuple[Column, ...]:
    return F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()


def resampled(
    docs: DataFrame,
    target: DataFrame,
    *,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null for rows not drawn.

    Of the N rows with ``least_words`` words, the ``share * N // 100`` of the highest scores are drawn, ties to the
    smaller id. Null, empty and wordless texts have no features and weight 0; whole texts count, of any length;
    repeated rows are drawn each on its own; null ids come last in ties; an empty table gives no rows, an empty
    target leaves only the smoothed shares. No other column is read, so none can clash.

    A quantile sketch names brackets for the cutoff, exact counts outside prove the first that fits, and only its rows
    are sorted to find the cutoff. Ranks come from a range sort of the drawn rows and the sizes of its parts.
    """
    rows = scored(docs, target, id_col=id_col, text_col=text_col, target_col=target_col, run=run, buckets=buckets, seed=seed)
    eligible = rows.where(F.col("n_words") >= least_words)
    at = 1 - share / 100
    shares = [min(1.0, max(0.0, at + side * w / ACCURACY)) for w in WIDTHS for side in (-1, 1)]
    seen = eligible.agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.percentile_approx("score", shares, ACCURACY).alias("marks")
    ).first()
    wanted = share * seen.n // 100
    out = ("doc_id", "n_features", "weight", "score")
    if wanted == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    score, doc, row = cutoff(eligible, wanted, [*zip(seen.marks[::2], seen.marks[1::2], strict=True), (seen.low, seen.high)])
    last, kind = F.lit(doc).cast(docs.schema[id_col].dataType), F.col("doc_id")
    before = kind.eqNullSafe(last) & (F.col("row") <= row)
    earlier = kind.isNotNull() if doc is None else F.coalesce(kind < last, F.lit(False))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & (before | earlier)))
    ranked, sizes = numbered(rows.where(drawn), "resample-drawn", *_order())
    starts, passed = {}, 1
    for part, size in sizes:
        starts[part] = passed
        passed += size
    # one entry per part of the sort
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.col("part")]
    return rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*out, (start + F.col("at")).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all columns. Rows that share an id are drawn if any of them is."""
    name = settings.get("id_col", "doc_id")
    ids = resampled(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(ids, docs[name].eqNullSafe(ids["drawn"]), "left_semi")


def op13(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark)
