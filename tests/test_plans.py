"""What plans must and mustn't hold."""

import re

import pytest

from carillon.plans import registry

STREAMS = {"stream_buckets", "stream_hopping", "stream_sessions", "stream_queue", "stream_player"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - STREAMS))
def test_no_cross_joins(spark, data, name):
    p = plan(registry.queries()[name](spark, data))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", p), p


def test_filters_and_columns_reach_the_scan(spark, data):
    p = plan(registry.queries()["catalog_point_lookup"](spark, data))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_orderkey,7\)", p)
    assert "l_comment" not in p and re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>", p)
    assert re.search(r"ReadSchema: struct<c_acctbal|ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int>", plan(registry.queries()["catalog_albums_page"](spark, data)))


def test_top_k_is_bounded(spark, data):
    assert "TakeOrderedAndProject" in plan(registry.queries()["sim_topk"](spark, data))
    assert plan(registry.queries()["sim_group_topk"](spark, data)).count("WindowGroupLimit") == 2
    assert plan(registry.queries()["catalog_variants_top16"](spark, data)).count("WindowGroupLimit") == 2


def test_scans_without_shuffle(spark, data):
    for name in ("text_display", "hash_digests", "sim_support", "audio_scalars"):
        p = plan(registry.queries()[name](spark, data))
        assert "Exchange" not in p and "*(1)" in p


def test_partial_aggregates_come_before_the_shuffle(spark, data):
    for name in ("wave_buckets", "catalog_artists_page", "sim_pool"):
        assert "partial_" in plan(registry.queries()[name](spark, data))
