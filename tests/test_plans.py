"""Plan-shape regression tests: the scale properties of the design, checked
on the final adaptive plans of key queries (sf0.001)."""
import pytest

from lexiflow.plans.audit import final_plan_text, plan_shape
from lexiflow.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
KEY = ["frequent_terms", "dictionary_multiword", "search_by_group", "search_kwic", "term_positions",
       "sim_correlation", "sim_on_grouped", "comparison_terms", "top_features_by_group", "token_context",
       "frequent_lemmas", "dfm_trim", "weight_tfidf"]


@pytest.mark.parametrize("name", KEY)
def test_single_pass_no_cross_join(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    shape = plan_shape(df)
    plan = final_plan_text(df)
    assert shape["tokenize"] <= 1, shape
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_frequent_terms_shape(spark):
    df = QUERIES["frequent_terms"](spark, SF)
    df.collect()
    plan = final_plan_text(df)
    # the dfm is built inside the rows: the only hash exchange is by term
    assert plan.count("Exchange hashpartitioning(term") == 1
    assert "hashpartitioning(doc_id" not in plan
    assert "TakeOrderedAndProject" in plan


def test_row_local_search_has_no_shuffle(spark):
    for name in ("search_and_or_not", "search_kwic", "kwic_word", "search_highlight"):
        df = QUERIES[name](spark, SF)
        df.collect()
        assert plan_shape(df)["shuffles"] == 0, name
