"""Physical plans are the ones that were meant."""

import pytest

from quillstone import catalog, plans  # noqa: F401


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "keep_last_n_runs", "conversation_tail", "per_entity_topk"])
def test_topk_is_cut_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(spark, sf, name)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_row_at_a_time_python_and_no_cross_product(spark, sf, name):
    if name.startswith("usage_stream") or name == "dedup_stream":
        pytest.skip("the query runs a stream first")
    p = plan(spark, sf, name)
    assert "BatchEvalPython" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize(("name", "columns"), [("library_stats", "struct<lang:string,source:string,n_chars:bigint>"), ("tombstone_filter", "struct<doc_id:bigint>"), ("orphans_anti", "struct<c_custkey:bigint>")])
def test_scans_read_what_is_used(spark, sf, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, sf, name).replace(", ", ",") or columns in plan(spark, sf, name)


def test_filters_reach_the_scan(spark, sf):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan(spark, sf, "delete_cascade")


def test_chunks_need_no_shuffle(spark, sf):
    assert "Exchange" not in plan(spark, sf, "chunk_build_fixed") and "Exchange" not in plan(spark, sf, "entity_scores")
