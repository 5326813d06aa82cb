"""What the physical plans must look like at any scale."""

from __future__ import annotations

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidewatch.operators import events, peaks, report, rolling, series, topk
from tidewatch.params import EventParams, PeakParams
from tidewatch.plans import inputs
from tidewatch.plans.catalog import QUERIES
from tidewatch.sinks import files
from tidewatch.sources import calendar, signals

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("live_")))
def test_no_pairs_of_everything(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_sums_shuffle_after_a_partial_sum(spark):
    plan = plan_of(inputs.type_series(spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_signal_and_windows_share_one_shuffle_by_topic(spark):
    found = peaks.detect_peaks(inputs.type_series(spark, FOLDER), PeakParams(24, 3.0))
    spikes = events.find_spikes(found, inputs.january_events(spark), EventParams())
    # One by topic and hour for the sums, one by topic for the series, one of the few dates; none for the windows.
    assert plan_of(spikes).count("Exchange hashpartitioning") == 3
    assert plan_of(spikes).count("Exchange hashpartitioning(event_ts") == 1
    assert "BroadcastHashJoin" in plan_of(spikes)


def test_rolling_windows_share_one_sort(spark):
    plan = plan_of(rolling.moving_std(inputs.type_series(spark, FOLDER), 24))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 1


def test_capped_spikes_are_cut_before_the_shuffle(spark):
    # Spark leaves the cut out where it knows that there are no more rows than the limit.
    summary = spark.range(1000).select(
        F.timestamp_seconds("id").alias("event_ts"),
        F.col("id").cast("double").alias("total_views"),
        F.col("id").cast("string").alias("topic"),
    )
    plan = plan_of(report.top_spikes(summary))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_pages_need_no_full_sort(spark):
    hours = spark.range(1000).select(
        F.col("id").cast("string").alias("title"), F.current_timestamp().alias("ts"), F.col("id").alias("views")
    )
    assert "TakeOrderedAndProject" in plan_of(topk.top_pages(hours))
    assert "rangepartitioning" not in plan_of(topk.top_pages(hours))


def test_stored_signals_are_read_by_day(spark, tmp_path):
    found = peaks.detect_peaks(inputs.type_series(spark, FOLDER), PeakParams(24, 3.0))
    files.write_signals(found, str(tmp_path / "s"))
    stored = signals.read_signals(spark, str(tmp_path / "s"))
    dates = calendar.known_event_dates(spark, ["2024-01-10"])
    points = events.window_points(stored, dates)
    assert "dynamicpruning" in plan_of(points)
    direct = events.window_points(found, dates)
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, direct.collect()))
    one_topic = plan_of(files.topic_chart(stored, "view"))
    assert "EqualTo(topic,view)" in one_topic


def test_lines_are_filtered_before_the_shuffle(spark):
    from tidewatch.operators import cleaning

    plan = plan_of(series.topic_hours(cleaning.topic_points(inputs.document_lines(spark, FOLDER))))
    assert plan.index("Exchange hashpartitioning") < plan.index("Filter")


def test_filled_series_are_packed_once(spark):
    hours = inputs.user_series(spark, FOLDER)
    for peaking_only in (False, True):
        found = peaks.detect_peaks(hours, PeakParams(24, 3.0), peaking_only, densify=True)
        plan = plan_of(found)
        # One partial and one final aggregate make up one packing.
        assert plan.count("collect_list(") == 2 and plan.count("Exchange hashpartitioning") == 2
    long = peaks.detect_peaks(series.densify(hours), PeakParams(24, 3.0))
    direct = peaks.detect_peaks(hours, PeakParams(24, 3.0), densify=True)
    assert long.exceptAll(direct).count() == direct.exceptAll(long).count() == 0 and direct.count() > 1_000
