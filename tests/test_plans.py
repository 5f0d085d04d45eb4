"""Plans: what must not appear in them at scale, and the registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from ebbmark.operators import cleanse, gold, merge, profile
from ebbmark.operators.signal import signal
from ebbmark.plans import starmap
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signal_joins_without_cartesian_product_or_python(spark):
    text = plan(signal(**starmap.views(spark, SF)))
    assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_null_safe_join_without_broadcast_is_a_sort_merge_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(signal(**starmap.views(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") == 3 and "NestedLoop" not in text


def test_scorecard_reads_only_needed_columns_and_filters_in_the_scan(spark):
    text = plan(gold.category_performance(signal(**starmap.views(spark, SF))))
    assert "EqualTo(l_returnflag,R)" in text
    for unused in ("l_tax", "p_name", "p_retailprice", "o_custkey", "o_orderpriority", "l_linestatus"):
        assert unused not in text


def test_scorecard_combines_before_the_shuffle(spark):
    assert "partial_sum" in plan(gold.category_performance(signal(**starmap.views(spark, SF))))


def test_surrogate_key_sorts_in_ranges(spark):
    lines = starmap.scan(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    text = plan(cleanse.surrogate_key(lines, "pk", lines.columns, total_order=True))
    window = text[text.index("Window"):]
    # the only single-task step works on one row per written file
    assert "HashAggregate(keys=[_file" in window and "l_orderkey" not in window


def test_keep_first_uses_no_window(spark):
    text = plan(cleanse.keep_first(starmap.scan(spark, SF, "lineitem"), ["l_orderkey"], ["l_shipdate"]))
    assert "Window" not in text and "partial_min" in text


def test_profile_counts_distinct_pairs_before_the_shuffle(spark):
    text = plan(profile.distinct_counts(starmap.scan(spark, SF, "part").select("p_partkey", "p_size")))
    # read from the scan up: pairs combine, travel, combine again, and only their number travels on
    steps = [text.rindex(s) for s in ("keys=[at", "Exchange hashpartitioning(at", "partial_count(distinct")]
    assert steps[0] > steps[1] > steps[2]


def test_salted_join_broadcasts_only_the_listed_keys(spark):
    lines = starmap.scan(spark, SF, "lineitem").select("l_partkey", "l_tax")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(merge.merge_left(lines, lines, "l_partkey", "l_partkey", hot=[1]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastExchange") == 1 and "SortMergeJoin" in text


def test_entry(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_its_sql(spark, name):
    query = entry.queries()[name]
    if name not in entry.oracle_sql():
        assert query(spark, SF).count() > 0
        return
    assert compare(spark, connect(SF), query, entry.oracle_sql()[name], SF) is None
