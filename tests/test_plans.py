"""Physical-plan regressions: pushdown, pruning, top-k limits, no Python
or shuffle in the decode, bounded broadcasts."""

import contextlib
import io

import pytest

import __spark_entry__ as E


def _plan(spark, sf, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, sf).explain("formatted")
    return buf.getvalue()


def test_column_pruning_on_driver_tables(spark, sf):
    p = _plan(spark, sf, "user_month_spend")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in p


def test_month_filter_reaches_scan(spark, sf):
    p = _plan(spark, sf, "leaderboard")
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in p and "LessThan(ts,2024-02-01T00:00)" in p
    assert "TakeOrderedAndProject" in p


def test_month_partition_pruning(spark, sf):
    p = _plan(spark, sf, "usage_month_scan")
    assert "PartitionFilters: [isnotnull(month" in p and "= 2000-06)" in p


def test_top_k_per_model_limits_before_shuffle(spark, sf):
    assert "WindowGroupLimit" in _plan(spark, sf, "model_leaderboard")


@pytest.mark.parametrize("name", ["decode_records", "token_extract", "identity_label"])
def test_decode_is_map_only_and_jvm_side(spark, sf, name):
    p = _plan(spark, sf, name)
    assert "Exchange" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_top_n_with_others_has_no_join(spark, sf):
    plan = _plan(spark, sf, "top_users_others")
    assert "Join" not in plan and "TakeOrderedAndProject" in plan


def test_heatmap_is_one_scan(spark, sf):
    plan = _plan(spark, sf, "user_model_heatmap")
    assert plan.split("\n\n")[0].count("Scan parquet") == 1 and "TakeOrderedAndProject" in plan
