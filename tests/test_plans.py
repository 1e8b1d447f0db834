"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry_module.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gn_graph_nodes", "ge_graph_edges", "gs_graph_sizes", "f17_session_fingerprint", "w2_with_next", "k4_session_arrays"])
def test_one_shuffle_serves_windows_and_groups(spark, name):
    assert len(re.findall("Exchange hashpartitioning", plan(spark, name))) == 1


@pytest.mark.parametrize("name", ["gr_graph_records"])
def test_a_stored_run_is_grouped_without_moving_it(spark, name):
    text = plan(spark, name)
    assert "Exchange hashpartitioning" not in text and "Window" not in text and text.count("Bucketed: true") >= 2


def test_scored_edges_stay_where_they_are(spark):
    """The model is broadcast, the stored edges are scored and grouped by session in place; only nodes move."""
    text = plan(spark, "m5_session_component_scores")
    assert "BroadcastHashJoin [src" in text and not re.search(r"Exchange hashpartitioning\((src|dst)", text)
    edges = text[text.index("structure"):]
    assert len(re.findall("Exchange hashpartitioning", text)) <= 2 and edges


def test_matching_a_small_catalog_moves_no_lines(spark):
    text = plan(spark, "j5_match_templates")
    # Exchanges: the four packed catalog sides and the spreading of the rendered lines.
    assert text.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["s17_subsample", "t3_template_catalog"])
def test_first_k_is_cut_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "a1_session_lengths")
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from weftlog.plans import views as V
    from weftlog.sources.logs import cap_lines

    df = cap_lines(V.v_events(spark, SF), 100).select("line_no")
    assert "LessThanOrEqual(event_id,100)" in df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_cut_once(spark):
    """The counts are stored; the frequencies and the norms read them, and the small vocabulary is broadcast."""
    text = plan(spark, "b1_tfidf")
    assert "Exchange hashpartitioning" not in text and "split(" not in text and "Bucketed: true" in text


def test_sliding_windows_repeat_panes_not_events(spark):
    text = plan(spark, "k3_window_totals_sliding")
    below = text[text.index("Generate"):]
    assert "HashAggregate" in below and below.index("HashAggregate") < below.index("FileScan")
