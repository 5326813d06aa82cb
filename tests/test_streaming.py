from __future__ import annotations

import random

import pytest
from conftest import hour
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, peaks, series, templates
from tidewatch.params import PeakParams, TemplateParams
from tidewatch.streaming import live


def test_arriving_files_match_the_batch_result(spark, tmp_path):
    """Files arrive in two runs; the second goes on from the state of the first."""
    rng = random.Random(9)
    params = PeakParams(6, 2.0, 0.3)
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(hours):
        for h in hours:
            lines = [f"en T{t} {int(rng.lognormvariate(3, 1))} 0" for t in range(4) for _ in range(2)]
            (folder / f"pageviews-{hour(h):%Y%m%d-%H%M%S}.gz.txt").write_text("\n".join(lines) + "\n")

    def update():
        points = cleaning.topic_points(live.read_lines(spark, str(folder), 10))
        return live.update_signals(points, str(tmp_path / "out"), params, "1 hour")

    arrive(range(30))
    first = update().count()
    assert first > 0
    arrive(range(30, 60))
    found = update()

    raw = spark.read.text(str(folder)).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line")
    )
    hours = series.topic_hours(cleaning.topic_points(raw))
    closed = hours.where(F.col("ts") < F.lit(hour(58)))
    expected = sorted(map(tuple, peaks.detect_peaks(closed, params).collect()))
    assert len(expected) > first
    assert sorted(map(tuple, found.collect())) == expected
    assert sum(r[3] for r in expected) > 0


def test_a_table_of_part_files_gives_the_whole_signal(spark, tmp_path):
    from tidewatch.plans import inputs
    from tidewatch.plans.catalog import QUERIES

    events = inputs.table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found, expected = (
        sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) for name in ("live_peak_signal", "peak_signal")
    )
    assert found == expected and len(found) > 100


def test_two_years_in_unordered_files_lose_no_hour(spark, tmp_path):
    """More files than a batch takes, each with hours from all over the table."""
    hours, params = 2 * 366 * 24, PeakParams(24, 3.0)
    rows = spark.range(hours).selectExpr(
        "'a' AS topic", "timestampadd(HOUR, id, timestamp'2016-01-01 00:00:00') AS ts",
        "cast(1 + pmod(xxhash64(id), 50) + if(id % 997 = 0, 5000, 0) AS double) AS views",
    )
    path = str(tmp_path / "in")
    rows.repartition(12, "views").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)
    delay = live.whole_length(spark.read.parquet(path))
    found = live.update_signals(stream, str(tmp_path / "out"), params, delay, last=True)
    expected = peaks.detect_peaks(rows, params)
    assert found.count() == hours and live.late_sums(spark, str(tmp_path / "out")) == 0
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    def arrive(*hours):
        rows = spark.createDataFrame([("a", hour(h), 1.0) for h in hours], "topic string, ts timestamp, views double")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def update(last=False):
        stream = spark.readStream.schema("topic string, ts timestamp, views double").parquet(str(tmp_path / "in"))
        return live.update_signals(stream, str(tmp_path / "out"), PeakParams(2, 2.0), "1 hour", last)

    arrive(0, 1, 2, 3, 10)
    update()
    assert live.late_sums(spark, str(tmp_path / "out")) == 0
    arrive(4, 5, 11)
    found = update(last=True)
    assert live.late_sums(spark, str(tmp_path / "out")) == 2
    assert found.count() == 6


def test_live_scores_go_on_after_a_restart(spark, tmp_path):
    rng, params = random.Random(3), TemplateParams(5, 8, 0.1, 0.1, 2, 3)
    library = spark.createDataFrame(
        [(i, i % 2 == 0, [rng.random() for _ in range(9)]) for i in range(4)] + [(9, None, [0.5] * 5), (10, True, [])],
        "ref_id long, trending boolean, series array<double>",
    )
    values = {"a": [float(rng.randint(0, 9)) for _ in range(40)], "late start": [0.0] * 12 + [3.0, 0.0, 5.0] * 5}

    def arrive(first, last):
        rows = [(t, hour(i), v) for t, xs in values.items() for i, v in enumerate(xs) if first <= i < last]
        spark.createDataFrame(rows, "topic string, ts timestamp, views double").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))

    def update(last=False):
        stream = spark.readStream.schema("topic string, ts timestamp, views double").parquet(str(tmp_path / "in"))
        signal = lambda hours: live.live_scores(hours, library, params)
        return live.update_signals(stream, str(tmp_path / "out"), signal, "1 hour", last)

    for first, last in ((0, 3), (3, 14), (14, 40)):
        arrive(first, last)
        found = update(last == 40)
    expected = templates.template_scores(spark.read.parquet(str(tmp_path / "in")), library, params)
    rows, wanted = ([tuple(r) for r in f.orderBy("topic", "ts").collect()] for f in (found, expected))
    assert [r[:3] for r in rows] == [w[:3] for w in wanted] and len(rows) == 67
    assert [r[3] for r in rows] == pytest.approx([w[3] for w in wanted])
    assert sum(r[3] > 0 for r in rows) > 40

    with pytest.raises(ValueError, match="library_bytes"):
        live.live_scores(expected, library, params, library_bytes=100)
