from __future__ import annotations

import gzip
import json
from datetime import datetime

import pytest
from conftest import hour, naive
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, peaks, series
from tidewatch.params import EventParams, PeakParams
from tidewatch.sinks import files
from tidewatch.sources import calendar, charts, pageviews, polls, signals

LINES = """en Donald_Trump 10 0
en.m donald_trump 5 0
es Donald_Trump 2 0
fr Donald_Trump 100 0
en short
en Bad_Count x 0
en Nan_Count NaN 0
en Endless Infinity 0
en Endless -Infinity 0
en Empty_Count  0
en  7 0
en Comma,_Inc. 3 0
en Main_Page 12000000 0
enm Old_English 1 0
"""


@pytest.fixture
def dump(tmp_path):
    with gzip.open(tmp_path / "pageviews-20160201-000000.gz", "wt") as out:
        out.write(LINES)
    with gzip.open(tmp_path / "pageviews-20160201-010000.gz", "wt") as out:
        out.write("en Donald_Trump 1 0\n")
    return str(tmp_path)


def test_topic_hours_of_files(spark, dump):
    raw = pageviews.read_lines(spark, f"{dump}/*.gz")
    rows = series.topic_hours(cleaning.topic_points(raw)).collect()
    assert {(r.topic, r.ts): r.views for r in rows} == {
        ("donald_trump", naive(0)): 17.0,
        ("donald_trump", naive(1)): 1.0,
        ("", naive(0)): 7.0,
        ("comma,_inc.", naive(0)): 3.0,
        ("main_page", naive(0)): 12000000.0,
        ("old_english", naive(0)): 1.0,
    }


def test_other_languages(spark, dump):
    raw = pageviews.read_lines(spark, f"{dump}/*.gz")
    assert [r.views for r in cleaning.topic_points(raw, ["fr"]).collect()] == [100.0]


def test_a_file_without_an_hour_fails(spark, tmp_path):
    (tmp_path / "pageviews.txt").write_text("en A 1 0\n")
    with pytest.raises(Exception, match="no hour in file name"):
        cleaning.topic_points(pageviews.read_lines(spark, str(tmp_path))).collect()


def test_damaged_file(spark, tmp_path):
    packed = gzip.compress("".join(f"en Topic_{i} {i} 0\n" for i in range(20000)).encode())
    (tmp_path / "pageviews-20160201-000000.gz").write_bytes(packed[: len(packed) // 2])
    with pytest.raises(Exception):
        pageviews.read_lines(spark, str(tmp_path)).count()
    assert pageviews.read_lines(spark, str(tmp_path), skip_corrupt=True).count() >= 0


def test_keyword_points_count_malformed_rows(spark, tmp_path):
    (tmp_path / "pageviews-20160201-000000").write_text(
        "xx Trump_Tower 3 0\nen Trump_Tower 4 0\nen trump_tower 5 0\nen Clinton_Trump 1 0\n"
        "en Trump_Bad x 0\nen Other 9 0\n"
    )
    raw = pageviews.read_hour_range(spark, str(tmp_path), datetime(2016, 2, 1), datetime(2016, 2, 1))
    dropped = Observation("dropped")
    rows = series.page_hours(cleaning.keyword_points(raw, dropped=dropped)).collect()
    assert {r.title: r.views for r in rows} == {"Trump_Tower": 7, "trump_tower": 5, "Clinton_Trump": 1}
    assert dropped.get == {"malformed": 1}


def test_hour_range_is_inclusive_and_complete(spark, tmp_path):
    for h in range(4):
        (tmp_path / f"pageviews-20160201-{h:02d}0000").write_text(f"en Trump {h} 0\n")
    read = pageviews.read_hour_range(spark, str(tmp_path), datetime(2016, 2, 1, 1), datetime(2016, 2, 1, 2))
    assert sorted(r.line for r in read.collect()) == ["en Trump 1 0", "en Trump 2 0"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        pageviews.read_hour_range(
            spark, str(tmp_path), datetime(2016, 2, 1, 3), datetime(2016, 2, 1, 4)
        ).count()


def test_month_manifest(spark):
    year = pageviews.month_manifest(spark, 2016, 1, 9)
    assert year.count() == 274 * 24
    september = pageviews.spread(pageviews.month_manifest(spark, 2016, 9, 9))
    assert september.count() == 720 and september.rdd.getNumPartitions() == 3
    first = year.orderBy("ts").first()
    assert first.url.endswith("/2016/2016-01/pageviews-20160101-000000.gz")
    assert first.file_name == "pageviews-20160101-000000.gz"
    assert year.where(F.contains("url", F.lit("20160229-230000"))).count() == 1


def test_event_dates(spark, tmp_path):
    (tmp_path / "dates").write_text("2016-02-09\r\nnot a date\r\n2016-06-07\r\n")
    rows = calendar.read_event_dates(spark, str(tmp_path / "dates"))
    ms = rows.select(F.unix_millis("event_ts").alias("ms")).collect()
    assert [r.ms for r in ms] == [1454997600000, 1465275600000]
    assert calendar.known_event_dates(spark).count() == 52


def test_event_calendar(spark, tmp_path):
    (tmp_path / "calendar.csv").write_text(
        "Date,Type,Party,Location,Topic\r\n"
        '2016-02-09,open primary,democrats,"Springfield, ""North""",\r\n'
        "2016-02-09,closed caucus,republicans,Iowa,Debate\r\n"
    )
    rows = calendar.read_calendar(spark, str(tmp_path / "calendar.csv")).orderBy("position").collect()
    assert [r.location for r in rows] == ['Springfield, "North"', "Iowa"]
    assert [r.topic for r in rows] == [None, "Debate"]
    assert rows[0].event_ts == datetime(2016, 2, 9, 6)


def test_signal_text(spark):
    lines = [
        "(plain,[(1000,1.0,0.0), (2000,1.0E7,1.0)])",
        "(a,b,[x,[(3000,2.5,0.0)])",
        "(empty,[])",
        "(bad,[(4000,zz,0.0), (5000,1.0,0.0)])",
        "nonsense",
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = signals.parse_signal_text(frame).select("topic", F.unix_millis("ts").alias("ms"), "views", "signal")
    assert sorted(map(tuple, rows.collect())) == [
        ("a,b,[x", 3000, 2.5, 0.0),
        ("bad", 5000, 1.0, 0.0),
        ("plain", 1000, 1.0, 0.0),
        ("plain", 2000, 1.0e7, 1.0),
    ]


def test_signal_files(spark, make_series, tmp_path):
    found = make_series({"a": [1, 2, 3, 50, 2], "b": [1, 1, 1, 1, 1]})
    params = PeakParams(2, 3.0, 0.0)
    expected = sorted(map(tuple, peaks.detect_peaks(found, params).collect()))
    files.write_signal_text(peaks.packed_peaks(found, params), str(tmp_path / "text"))
    assert list((tmp_path / "text").glob("*.gz"))
    read = signals.read_signal_text(spark, str(tmp_path / "text"))
    assert sorted(map(tuple, read.collect())) == expected
    files.write_signals(peaks.detect_peaks(found, params), str(tmp_path / "table"))
    assert list((tmp_path / "table").glob("day=2016-02-01"))
    read = signals.read_signals(spark, str(tmp_path / "table")).drop("day")
    assert sorted(map(tuple, read.collect())) == expected


def test_topic_chart(spark, make_series, tmp_path):
    found = peaks.detect_peaks(make_series({"a": [1, 2, 3, 50, 2], "b": [9] * 5}), PeakParams(2, 3.0))
    files.write_topic_chart(found, "a", str(tmp_path / "chart"))
    rows = charts.read_topic_chart(spark, str(tmp_path / "chart")).orderBy("id").collect()
    assert [(r.id, r.views, r.time) for r in rows] == [
        (i, v, naive(i)) for i, v in enumerate([1.0, 2.0, 3.0, 50.0, 2.0])
    ]


def test_spike_array_file(spark, tmp_path):
    spike = {"topic": "t", "event_timestamp": 1454997600000, "on_the_day": [1.0, 2.0]}
    spike |= {n: [] for n in signals.BUCKET_NAMES if n != "on_the_day"}
    (tmp_path / "spikes.json").write_text(json.dumps([spike, spike], indent=1))
    rows = signals.read_spikes(spark, str(tmp_path / "spikes.json"), whole_array=True).collect()
    assert len(rows) == 2
    assert rows[0].event_ts == datetime(2016, 2, 9, 6)
    assert rows[0].on_the_day == [1.0, 2.0] and rows[0].one_day_before == []


def test_polls(spark, tmp_path):
    document = {
        "poll": {
            "rcp_avg": [
                {"date": "2016-02-09", "candidate": [{"name": "A", "value": "40.5"}]},
                {"date": "2016-02-08", "candidate": [{"name": "A", "value": "40"}]},
            ]
        }
    }
    paths = {}
    for name in ("One", "Two"):
        paths[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    rows = polls.read_polls(spark, paths, EventParams()).orderBy("poll", "entry_ts").collect()
    assert [(r.poll, r.entry_ts) for r in rows] == [
        (p, datetime(2016, 2, d, 6)) for p in ("One", "Two") for d in (8, 9)
    ]
    assert rows[1].candidate[0].value == "40.5"


def test_hours_helper():
    assert hour(0).replace(tzinfo=None) == naive(0)


def test_signal_files_are_sorted_by_topic_within_their_day(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(f"t{i % 50:02d}", hour(i // 50), 1.0, 0.0) for i in range(1200)]
    files.write_signals(spark.createDataFrame(rows, "topic string, ts timestamp, views double, signal double"), str(tmp_path / "s"))
    parts = list((tmp_path / "s").glob("day=*/*.parquet"))
    assert parts
    for part in parts:
        topics = pq.read_table(part, partitioning=None)["topic"].to_pylist()
        assert topics == sorted(topics)
