"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbmark.llm import language, line_dedup, ngram_join, nn_descent, packing, pieces, pii, quality, resample, token_cache, toxicity, turns, urls
from ebbmark.llm.common import small_batches, table


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return operator(spark, *(table(spark, sf_dir, name) for name in names))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _over(quality.op1, "documents", "labels"),
    "op2_sentencepiece": _over(pieces.op2, "documents"),
    "op3_pii": _over(pii.op3, "documents"),
    "op4_ngram_jaccard": _over(ngram_join.op4, "documents"),
    "op5_toxicity": _over(toxicity.op5, "documents", "labels"),
    "op6_substring_dedup": _over(line_dedup.op6, "documents"),
    "op7_url_filters": _over(urls.op7, "pages"),
    "op8_best_fit_packing": _over(packing.op8, "documents"),
    "op9_nn_descent": _over(nn_descent.op9, "embeddings"),
    "op10_token_counts": _over(token_cache.op10, "documents"),
    "op11_language_id": _over(language.op11, "documents"),
    "op12_conversation_repair": _over(turns.op12, "conversations"),
    "op13_importance_resampling": _over(resample.op13, "documents", "benchmark"),
}

ORACLE: dict[str, str] = {"op7_url_filters": urls.OP7_SQL}
