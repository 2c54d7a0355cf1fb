import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NO_SIDE_EFFECTS = ["d2_split_label_counts", "p9_weak_labels", "p3_route_labels", "p2_constant_label", "j1_avoid_benchmark",
                   "j2_avoid_normalized", "u1_concat_fresh_index", "d6_quota_rounds", "j6_range_join", "a13_overlapping_report",
                   "a14_sif_pool", "j9_centroid_cosine", "j9_probe_pairs", "d4_upsample_classes", "j3_attach_translations",
                   "j5_error_table", "f14_zip_replies", "l2_first_k_per_group", "j10_generation_requests", "u4_replicate_group"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NO_SIDE_EFFECTS)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(E.queries()["s4_group_union"](spark, SF))
    assert "PushedFilters: [In(lang, [en,fr])" in plan
    plan = _plan(E.queries()["p2_constant_label"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint>" in plan and "documents" not in plan


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["l2_first_k_per_group"](spark, SF))
    assert "WindowGroupLimit" in plan
