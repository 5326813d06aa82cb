from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidewatch.operators import polls

FIRST = datetime(2016, 2, 1, 6)


def at(day: int) -> datetime:
    return FIRST + timedelta(days=day)


@pytest.fixture
def entries(spark):
    rows = [("A", at(d), [("X", f"{d}.5"), ("Y", "n/a")]) for d in (0, 2, 3, 7, 8, 9)]
    rows += [("B", at(d), [("Z", "1")]) for d in (1, 4)]
    return spark.createDataFrame(
        rows, "poll string, entry_ts timestamp, candidate array<struct<name string, value string>>"
    )


def events(spark, *days):
    return spark.createDataFrame([(at(d),) for d in days], "event_ts timestamp")


def days(rows):
    return sorted((r.poll, (r.entry_ts - FIRST).days) for r in rows)


def test_neighbourhood_is_clamped(spark, entries):
    rows = polls.poll_neighbourhood(entries, events(spark, 3)).collect()
    assert days(rows) == [("A", d) for d in (0, 2, 3, 7, 8)]
    assert days(polls.poll_neighbourhood(entries, events(spark, 0)).collect()) == [
        ("A", d) for d in (0, 2, 3)
    ]
    assert days(polls.poll_neighbourhood(entries, events(spark, 9)).collect()) == [
        ("A", d) for d in (7, 8, 9)
    ]


def test_polls_without_the_date_are_skipped(spark, entries):
    assert polls.poll_neighbourhood(entries, events(spark, 5)).count() == 0
    assert days(polls.poll_neighbourhood(entries, events(spark, 4)).collect()) == [("B", 1), ("B", 4)]


def test_repeated_calendar_dates_count_once(spark, entries):
    assert polls.poll_neighbourhood(entries, events(spark, 4, 4)).count() == 2


def test_midpoints(spark, entries):
    near = polls.poll_neighbourhood(entries, events(spark, 0))
    rows = polls.entry_midpoints(near).orderBy("midpoint_ms").collect()
    first = 1454306400000
    assert [r.midpoint_ms - first for r in rows] == [86_400_000, 216_000_000]


def test_candidate_series(spark, entries):
    near = polls.poll_neighbourhood(entries, events(spark, 0))
    rows = {r.name: [p.value for p in r.points] for r in polls.candidate_series(near).collect()}
    assert rows == {"X": [0.5, 2.5, 3.5], "Y": [None, None, None]}


def test_several_entries_on_one_date_match_once(spark, entries):
    more = entries.union(spark.createDataFrame([("A", at(3), [("X", "9")])], entries.schema))
    rows = polls.poll_neighbourhood(more, events(spark, 3)).collect()
    assert days(rows) == [("A", d) for d in (0, 2, 3, 3, 7)]
    assert sorted(r.entry_no for r in rows) == [1, 2, 3, 4, 5]
