from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.operators import events
from tidewatch.params import EventParams
from tidewatch.sources import calendar
from tidewatch.sources.signals import BUCKET_NAMES

EVENT = datetime(2016, 2, 9, 6)  # midnight in Chicago


@pytest.fixture
def signals(spark):
    def make(topic, peak_at=(), hours=range(-60, 90), views=lambda h: 10.0):
        rows = [(topic, EVENT + timedelta(hours=h), float(views(h)), float(h in peak_at)) for h in hours]
        return spark.createDataFrame(rows, "topic string, ts timestamp, views double, signal double")

    return make


def known(spark, *dates):
    return calendar.known_event_dates(spark, list(dates))


def test_bounds_are_inclusive_on_both_sides(spark, signals):
    row = events.event_windows(
        events.window_points(signals("t", views=lambda h: h), known(spark, "2016-02-09"))
    ).first()
    starts = (-48, -24, 0, 24, 48)
    assert [getattr(row, b) for b in BUCKET_NAMES] == [
        [float(h) for h in range(s, s + 25)] for s in starts
    ]
    assert row.points == 125
    assert row.total_views == sum(sum(range(s, s + 25)) for s in starts)
    assert not row.has_peak


def test_half_open_buckets(spark, signals):
    params = EventParams(closed="left")
    row = events.event_windows(
        events.window_points(signals("t"), known(spark, "2016-02-09"), params)
    ).first()
    assert [len(getattr(row, b)) for b in BUCKET_NAMES] == [24] * 5


def test_empty_buckets_are_empty_arrays(spark, signals):
    row = events.event_windows(
        events.window_points(signals("t", hours=[5]), known(spark, "2016-02-09"))
    ).first()
    assert [getattr(row, b) for b in BUCKET_NAMES] == [[], [], [10.0], [], []]


def test_spikes_need_a_peak_and_enough_views(spark, signals):
    frame = (
        signals("quiet")
        .union(signals("loud", peak_at={3}))
        .union(signals("small", peak_at={3}, views=lambda h: 1.0))
        .union(signals("late", peak_at={80}))
        .union(signals("edge", peak_at={72}))
    )
    found = events.find_spikes(frame, known(spark, "2016-02-09"), EventParams(views_threshold=10.0))
    assert sorted(r.topic for r in found.collect()) == ["edge", "loud"]
    none = events.find_spikes(frame, known(spark, "2016-07-01"), EventParams(views_threshold=0.0))
    assert none.count() == 0


def test_daylight_saving_day(spark):
    """The buckets are counted in hours from local midnight, also across the clock change."""
    rows = events.event_buckets(known(spark, "2016-03-13")).select(
        "bucket", F.unix_millis("lo").alias("lo"), F.unix_millis("hi").alias("hi")
    )
    spans = {r.bucket: (r.lo, r.hi) for r in rows.collect()}
    start = 1457848800000  # 2016-03-13 06:00 UTC
    assert spans == {i: (start + h * 3600000, start + (h + 24) * 3600000) for i, h in enumerate((-48, -24, 0, 24, 48))}


def test_overlapping_events_and_large_calendars(spark, signals):
    """The same rows with and without a broadcast of the calendar."""
    frame = signals("a", peak_at={1, 30}).union(signals("b", peak_at={-50}))
    dates = known(spark, "2016-02-08", "2016-02-09", "2016-02-10")

    def rows():
        return sorted(map(tuple, events.find_spikes(frame, dates, EventParams(1.0)).collect()))

    small = rows()
    # Both peaks of "a" lie in all three windows, the one of "b" only in that of the 8th.
    assert [r[0] for r in small] == ["a", "a", "a", "b"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(events.find_spikes(frame, dates, EventParams(1.0)))
        assert rows() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_crowded_day_is_no_one_tasks_work(spark, no_broadcast):
    """All topics on the days of one event, the calendar not broadcast: every task gets its share."""
    rows = spark.range(40 * 400).selectExpr(
        "concat('t', id % 400) AS topic", "timestampadd(HOUR, cast(id div 400 AS int), timestamp'2016-02-09 06:00:00') AS ts",
        "1.0D AS views", "double(id % 7 = 0) AS signal",
    )
    dates = known(spark, "2016-02-09")
    plain, salted = (events.window_points(rows, dates, EventParams(), salts) for salts in (1, events.salts_for(dates)))
    assert events.salts_for(dates) == events.SALTS and plan_of(salted).count("SortMergeJoin") == 1

    def shares(points):
        sizes = [r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / (sum(sizes) / 8), len(sizes)

    assert shares(plain)[1] <= 3 and shares(plain)[0] > 2
    assert shares(salted)[1] == 8 and shares(salted)[0] < 2
    assert salted.exceptAll(plain).count() == plain.exceptAll(salted).count() == 0
    spikes = [sorted(map(tuple, events.find_spikes(rows, dates, EventParams(0.5), s).collect())) for s in (1, 64)]
    assert spikes[0] == spikes[1] and len(spikes[0]) == 400


def test_a_small_calendar_is_not_dealt_out(spark):
    assert events.salts_for(known(spark, "2016-02-09")) == 1


def test_a_repeated_date_is_one_event(spark, signals):
    once = events.event_windows(events.window_points(signals("t"), known(spark, "2016-02-09"))).collect()
    twice = events.event_windows(events.window_points(signals("t"), known(spark, "2016-02-09", "2016-02-09"))).collect()
    assert once == twice


def test_event_dates_may_be_short_and_have_text_after_them(spark):
    lines = spark.createDataFrame([("2016-2-9",), (" 2016-02-10 Tuesday",), ("2016-02-111",), ("soon",)], "value string")
    found = calendar.event_times(lines).collect()
    assert sorted(str(r.event_date) for r in found) == ["2016-02-09", "2016-02-10"]


def test_unreadable_event_dates_are_counted(spark):
    lines = spark.createDataFrame([("2016-02-09",), ("2016-02-30",), ("soon",), ("",), (None,), ("2016-3-1 x",)], "value string")
    dropped = Observation("dates")
    assert calendar.event_times(lines, dropped=dropped).count() == 2
    assert dropped.get == {"unreadable": 4}
