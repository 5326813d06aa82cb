from __future__ import annotations

from datetime import datetime

import pytest

from tidewatch.operators import report
from tidewatch.sources.signals import SPIKE_SCHEMA, with_event_time

DAY = 86_400_000
FIRST = 1454997600000  # 2016-02-09 in Chicago


@pytest.fixture
def summary(spark):
    def make(rows):
        spikes = [(t, FIRST + d * DAY, [], [float(v)], [], [1.0, 2.0], []) for t, d, v in rows]
        return report.summarise_spikes(with_event_time(spark.createDataFrame(spikes, SPIKE_SCHEMA)))

    return make


@pytest.fixture
def dates(spark):
    rows = [
        (datetime(2016, 2, 9, 6), "open primary", "democrats", "Iowa", 0),
        (datetime(2016, 2, 9, 6), "caucus", "democrats", "Guam", 1),
        (datetime(2016, 2, 10, 6), "caucus", "republicans", "Ohio", 2),
        (datetime(2016, 2, 11, 6), "debate", "presidential", "Utah", 3),
        (datetime(2016, 2, 12, 6), "caucus", "republicans", "Ohio", 5),
        (datetime(2016, 2, 12, 6), "caucus", "democrats", "Ohio", 4),
    ]
    return spark.createDataFrame(
        rows, "event_ts timestamp, type string, party string, location string, position long"
    )


def test_summary(summary):
    row = summary([("donald_trump", 0, 5)]).first()
    assert row.topic == "Donald Trump"
    assert row.views == [5.0, 1.0, 2.0] and row.total_views == 8.0
    assert row.offsets == [0, 1, 1, 3]


def test_ranking(summary):
    rows = report.rank_spikes(summary([("b", 1, 9), ("a", 0, 1), ("c", 0, 7), ("d", 0, 7)])).collect()
    assert [r.topic for r in rows] == ["C", "D", "A", "B"]


@pytest.mark.parametrize("spikes, shown", [(4, 4), (5, 5), (6, 2)])
def test_cap_applies_only_above_the_limit(summary, spikes, shown):
    rows = [(f"t{i}", 0, i) for i in range(spikes)] + [("other", 1, 1)]
    kept = report.top_spikes(summary(rows), crowded=5, shown=2).collect()
    assert sorted(r.total_views for r in kept if r.topic != "Other") == [
        i + 3.0 for i in range(spikes - shown, spikes)
    ]
    assert sum(r.topic == "Other" for r in kept) == 1


def test_calendar_dates(dates):
    rows = report.calendar_dates(dates).orderBy("event_ts").collect()
    assert [r.party_class for r in rows] == ["democrats", "republicans", "mixed", "mixed"]
    assert rows[0].tooltip == "democrats open primary in Iowa<br>democrats caucus in Guam<br>"
    assert rows[3].tooltip == "democrats caucus in Ohio<br>republicans caucus in Ohio<br>"
    assert rows[3].parties == ["democrats", "republicans"]


def test_bubbles(summary, dates):
    # The largest event, by count and by views, is not in the calendar.
    spikes = summary([("a", 0, 7), ("b", 0, 7), ("c", 1, 17), *[(f"x{i}", 9, 7) for i in range(4)]])
    rows = report.event_bubbles(dates, spikes).orderBy("event_ts").collect()
    assert [(r.spikes, r.views) for r in rows] == [(2, 20.0), (1, 20.0), (0, 0.0), (0, 0.0)]
    assert [r.y for r in rows] == pytest.approx([5 + 2 / 4 * 60, 5 + 1 / 4 * 60, 5, 5])
    assert [r.z for r in rows] == pytest.approx([5 + 20 / 40 * 15, 5 + 20 / 40 * 15, 5, 5])


def test_bubbles_without_spikes(summary, dates):
    rows = report.event_bubbles(dates, summary([("a", 0, 1)]).limit(0)).collect()
    assert [(r.spikes, r.views, r.y, r.z) for r in rows] == [(0, 0.0, 5.0, 5.0)] * 4


def test_blank_fields_stay_in_the_text_and_make_a_date_mixed(spark):
    from tidewatch.operators import report

    rows = spark.createDataFrame(
        [(0, "debate", None, "Ohio"), (1, "debate", "democrats", None)],
        "position long, type string, party string, location string",
    )
    row = report.calendar_dates(rows.selectExpr("timestamp'2016-02-09' AS event_ts", "*")).first()
    assert row.tooltip == " debate in Ohio<br>democrats debate in <br>"
    assert row.party_class == "mixed" and row.parties == ["", "democrats"]
