"""Token counts through a digest cache: only texts that the cache does not hold are encoded."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, whole_texts
from ebbmark.session import scratch_path, stage

#: Words whose count a task remembers at a time, and the most characters of such a word: together they bound the memory.
KNOWN_WORDS, LONGEST_KNOWN = 400_000, 48

CACHE_SCHEMA = "tokenizer string, d1 long, d2 long, n_bytes long, n_tokens long"


class PieceCounter:
    """Tokens of a text as the sentencepiece library counts them.

    No piece of the model has a space mark behind another character, so no merge crosses from a word into the
    spaces before the next one: the count of a text is the sum over its parts (spaces and the word behind
    them). The library encodes each distinct part once; a full memory is emptied, which changes no count.
    """

    def __init__(self, model: str) -> None:
        self.model = model
        self._library = None
        self._known: dict[str, int] = {}

    def __getstate__(self):
        return {"model": self.model, "_library": None, "_known": {}}

    @property
    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=self.model)
            pieces = (self._library.id_to_piece(i) for i in range(self._library.get_piece_size()))
            self._whole = any("▁" in p.lstrip("▁") for p in pieces)
        return self._library

    def count(self, texts: list[str]) -> list[int]:
        library, known = self.library, self._known
        if self._whole:  # a model whose pieces cross words
            return [len(ids) for ids in library.encode(texts, num_threads=1)]
        found = []
        for text in texts:
            if not text:
                found.append(0)
                continue
            text = text.replace("▁", " ")  # to the library a space mark is a space
            # it puts one space mark before a text; a lone closing space is its own mark
            if text[0] == " " or text[-1] == " " or "  " in text:
                parts = [p[1:] for p in re.findall(" +[^ ]*", " " + text)]
            else:
                parts = text.split(" ")
            new = [p for p in set(parts) if p not in known]
            if new:
                if len(known) + len(new) > KNOWN_WORDS:
                    known.clear()
                    new = list(set(parts))
                known.update(zip(new, map(len, library.encode(new, num_threads=1)), strict=True))
                known[""] = 1
            found.append(sum(map(known.__getitem__, parts)))
            for p in new:
                if len(p) > LONGEST_KNOWN:
                    del known[p]
        return found


def count_tokens(
    docs: DataFrame, cache: DataFrame | None, model: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Counts per row (``doc_id, n_bytes, n_tokens``) and the rows to append to the cache (``CACHE_SCHEMA``).

    A text is known by two 64-bit digests, its length in bytes and the tokenizer's version. The content is not
    normalised beyond null to empty, as any change could change the count. A null text counts as empty,
    which has no tokens; repeated rows and equal ids each get a row; an empty table gives no rows; a null id is
    kept. Copies are found by their digests before any text moves, so a hot text is one row after the
    map-side minimum, and it is encoded once.
    """
    texts = whole_texts(docs, id_col, text_col)
    rows = texts.select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = stage(rows, "digests")
    held = None
    wanted = rows.groupBy("d1", "d2", "n_bytes").agg(F.min("doc_id").alias("of"))
    if cache is not None:
        held = cache.where(F.col("tokenizer") == tokenizer).groupBy("d1", "d2", "n_bytes").agg(F.min("n_tokens").alias("n_tokens"))
        wanted = wanted.join(held, ["d1", "d2", "n_bytes"], "left_anti")
    counter = PieceCounter(model)
    keyed = texts.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("e1"), F.xxhash64(F.lit("second"), "text").alias("e2"), "text")
    misses = keyed.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), "left_semi")
    counted = map_texts(
        misses.select("e1", "e2", F.octet_length("text").cast("long").alias("n_bytes"), "text"),
        lambda c: [c[0], c[1], c[2], counter.count(c[3])],
        "d1 long, d2 long, n_bytes long, n_tokens long",
    )
    # one id may stand in several equal rows
    new = counted.groupBy("d1", "d2", "n_bytes").agg(F.min("n_tokens").alias("n_tokens"))
    new = stage(new.select(F.lit(tokenizer).alias("tokenizer"), "d1", "d2", "n_bytes", "n_tokens"), "new-counts")
    counts = new.drop("tokenizer")
    if held is not None:
        counts = counts.unionByName(held)
    return rows.join(counts, ["d1", "d2", "n_bytes"]).select("doc_id", "n_bytes", "n_tokens"), new


def cached_counts(
    docs: DataFrame, cache_dir: str, model: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``count_tokens`` against the Parquet table ``cache_dir``; what was encoded is appended to it."""
    spark = docs.sparkSession
    cache = None
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    counts, new = count_tokens(docs, cache, model, tokenizer, id_col=id_col, text_col=text_col)
    counts = stage(counts, "counts")  # computed before the cache it reads grows
    new.write.mode("append").parquet(cache_dir)
    return counts


#: Production parameters of the query.
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Tokens of every document and whether they pass the limit. The cache starts empty for each call."""
    import public_tokenizers

    counts = cached_counts(docs, scratch_path(spark, "token-cache"), public_tokenizers.path(MODEL), f"{MODEL}:1")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
