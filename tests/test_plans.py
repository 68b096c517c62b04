"""Plans are what they should be: filters and columns reach the scan, no Python where functions do, no product of tables."""

import pytest

from quillmill import plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.queries()[name](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


def test_filters_reach_the_scan(spark):
    text = plan(spark, "vector_topk_filtered")
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in text and "TakeOrderedAndProject" in text


def test_unused_columns_are_not_read(spark):
    assert "embedding" not in plan(spark, "scroll_page").split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["bm25_topk", "quality_scores", "near_duplicates", "sessionize_gap_size", "source_ranking", "cost_summary_grouping_sets", "semantic_duplicates"])
def test_no_python_and_no_product(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "InArrow" not in text and "CartesianProduct" not in text


def test_top_k_keeps_k_rows_a_task(spark):
    assert "TakeOrderedAndProject(limit=10" in plan(spark, "bm25_topk")
