"""From hourly files to report tables, through the command line where there is one."""

from __future__ import annotations

import gzip
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.__main__ import main
from tidewatch.params import EventParams, PeakParams
from tidewatch.plans import jobs
from tidewatch.sources import references, signals

FIRST = datetime(2016, 2, 1)
HOURS = 24 * 16
EVENT = datetime(2016, 2, 9, 6)
LOUD = int((EVENT - FIRST) / timedelta(hours=1)) + 10


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    """16 days of files: one topic peaks at the event, one far from it, one not at all."""
    folder = tmp_path_factory.mktemp("dump")
    rng = random.Random(4)
    for h in range(HOURS):
        views = {t: rng.randint(380, 420) for t in ("Near_Event", "Far_Away", "Quiet_Page")}
        if h == LOUD:
            views["Near_Event"] += 90_000
        if h == 100:
            views["Far_Away"] += 90_000
        lines = [f"en {t} {v} 0" for t, v in views.items()] + ["de Near_Event 999999 0", "broken"]
        stamp = f"{FIRST + timedelta(hours=h):%Y%m%d-%H%M%S}"
        with gzip.open(folder / f"pageviews-{stamp}.gz", "wt") as out:
            out.write("\n".join(lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("form", [{}, {"as_text": True}, {"peaking_only": True}])
def test_spikes_of_an_event(spark, dump, tmp_path, form):
    as_text = "as_text" in form
    jobs.detect_trends(spark, f"{dump}/*.gz", f"{tmp_path}/signals", PeakParams(), **form)
    jobs.extract_spikes(
        spark, f"{tmp_path}/signals", f"{tmp_path}/spikes", EventParams(300.0), from_text=as_text
    )
    parts = list((tmp_path / "spikes").glob("part-*"))
    assert len(parts) == 1
    spikes = [json.loads(line) for line in parts[0].read_text().splitlines()]
    at_event = [s for s in spikes if s["event_timestamp"] == 1454997600000]
    assert [s["topic"] for s in at_event] == ["near_event"]
    assert [len(at_event[0][b]) for b in signals.BUCKET_NAMES] == [25] * 5
    assert max(at_event[0]["on_the_day"]) > 90_000
    # The other peak lies in the windows of the events of the first days only.
    assert {s["topic"] for s in spikes if s["event_timestamp"] >= 1454997600000 + 3 * 86_400_000} <= {"near_event"}


def test_command_line_and_report(spark, dump, tmp_path):
    main(["detect", f"{dump}/*.gz", f"{tmp_path}/signals"])
    (tmp_path / "dates").write_text("2016-02-09\n2016-03-15\n")
    main(["extract", f"{tmp_path}/signals", f"{tmp_path}/spikes", "300", "--dates", f"{tmp_path}/dates"])
    (tmp_path / "calendar.csv").write_text(
        "Date,Type,Party,Location,Topic\n2016-02-09,primary,democrats,Iowa,\n2016-03-15,caucus,republicans,Ohio,\n"
    )
    poll = {
        "poll": {
            "rcp_avg": [
                {"date": f"2016-02-{d:02d}", "candidate": [{"name": "A", "value": str(d)}]}
                for d in (9, 5, 7, 8, 12, 13)
            ]
        }
    }
    (tmp_path / "poll.json").write_text(json.dumps(poll))
    main(["report", f"{tmp_path}/spikes", f"{tmp_path}/calendar.csv", f"{tmp_path}/report", "--poll", f"One={tmp_path}/poll.json"])
    read = lambda name: spark.read.parquet(f"{tmp_path}/report/{name}")
    bubbles = read("event_bubbles").orderBy("event_ts").collect()
    assert [(b.spikes, b.y, b.party_class) for b in bubbles] == [(1, 65.0, "democrats"), (0, 5.0, "republicans")]
    assert [r.topic for r in read("event_top_topics").collect()] == ["Near Event"]
    assert [p.value for p in read("event_polls").first().points] == [7.0, 8.0, 9.0, 12.0, 13.0]
    assert read("event_poll_midpoints").count() == 4
    jobs.topic_chart(spark, f"{tmp_path}/signals", "near_event", f"{tmp_path}/chart")
    chart = next((tmp_path / "chart").glob("part-*")).read_text().splitlines()
    assert chart[0] == "id,views,signal,time" and len(chart) == HOURS + 1


def test_keywords_restrict_the_lines(spark, dump, tmp_path):
    main(["detect", f"{dump}/*.gz", f"{tmp_path}/signals", "quiet", "FAR"])
    topics = signals.read_signals(spark, f"{tmp_path}/signals").select("topic").distinct().collect()
    assert [r.topic for r in topics] == ["quiet_page"]


def test_matrix(spark, tmp_path):
    for h in range(3):
        (tmp_path / f"pageviews-20160201-{h:02d}0000").write_text(
            f"en Trump {h} 0\nde Clinton 7 0\nen Other 100 0\n" if h != 1 else "en Nothing 1 0\n"
        )
    main(["matrix", str(tmp_path), "20160201-000000", "20160201-020000", f"{tmp_path}/out"])
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines == [
        "Date Clinton Trump",
        "Date(2016,02,01,00,00,00) 7 0",
        "Date(2016,02,01,01,00,00) 0 0",
        "Date(2016,02,01,02,00,00) 7 2",
    ]


def test_manifest(spark, tmp_path):
    main(["manifest", "2016", "2", "2", f"{tmp_path}/list"])
    listed = spark.read.csv(f"{tmp_path}/list", header=True)
    assert listed.count() == 29 * 24
    assert listed.where(F.endswith("url", F.col("file_name"))).count() == 29 * 24


def test_scores(spark, dump, tmp_path):
    raw = [("up", True, [float(i) for i in range(200)]), ("flat", False, [400.0] * 200)]
    frame = spark.createDataFrame(raw, "ref_id string, trending boolean, values array<double>")
    references.add_references(frame, f"{tmp_path}/library")
    main(["score", f"{dump}/*.gz", f"{tmp_path}/library", f"{tmp_path}/scores"])
    rows = signals.read_signals(spark, f"{tmp_path}/scores")
    assert rows.count() == 3 * HOURS
    assert rows.where("signal > 0").count() == 3 * (HOURS - 149)
