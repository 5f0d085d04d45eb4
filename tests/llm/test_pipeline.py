"""The stages of the corpus pipeline, one after the other."""

import corpus_pipeline
from ebbmark.llm import common
from ebbmark.session import stage

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_left(spark):
    docs = common.table(spark, DATA, "documents")
    columns, kinds, ids = docs.columns, docs.dtypes, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, DATA), name)
        rows = docs.collect()
        assert docs.columns == columns and docs.dtypes == kinds
        assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= ids
        if name in ("substring_dedup", "personal_data"):
            assert {r.doc_id for r in rows} == ids and all(r.n_chars == len(r.text) for r in rows)
        ids = {r.doc_id for r in rows}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == ids
