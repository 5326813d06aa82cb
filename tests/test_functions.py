from __future__ import annotations

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import clock, text, vectors
from tidewatch.operators import cleaning, series
from tidewatch.params import EventParams, PeakParams, TemplateParams


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*items):
    return F.array(*[F.lit(float(i)) for i in items])


@pytest.mark.parametrize(
    "title, expected",
    [
        ("donald_trump", "Donald Trump"),
        ("o'reilly_factor", "O'Reilly Factor"),
        ("new_york_(state)", "New York (State)"),
        ("mcCain-palin", "McCain-Palin"),
        ("éclair_été_x1", "éClair éTé X1"),
        ("", ""),
    ],
)
def test_prettify_title(spark, title, expected):
    assert value(spark, text.prettify_title(F.lit(title))) == expected


@pytest.mark.parametrize(
    "url, name",
    [("http://h/a/b.gz", "b.gz"), ("http://h/a/b/", "b"), ("b", "b"), ("http://h/a//", "a")],
)
def test_file_name_of_url(spark, url, name):
    assert value(spark, text.file_name_of_url(F.lit(url))) == name


@pytest.mark.parametrize(
    "given, number",
    [("45.5", 45.5), (" 12 pts", 12.0), ("-3e2x", -300.0), (".5", 0.5), ("3.", 3.0), ("n/a", None), ("", None)],
)
def test_leading_number(spark, given, number):
    assert value(spark, text.leading_number(F.lit(given))) == number


def test_contains_any(spark):
    assert value(spark, text.contains_any(F.lit("The Clinton era"), ["clinton"]))
    # Keywords are not lower-cased themselves, and no keywords match nothing.
    assert not value(spark, text.contains_any(F.lit("The Clinton era"), ["Clinton"]))
    assert not value(spark, text.contains_any(F.lit("anything"), []))


def test_local_midnight_follows_daylight_saving(spark):
    for day, ms in [(date(2016, 2, 9), 1454997600000), (date(2016, 6, 7), 1465275600000)]:
        assert value(spark, F.unix_millis(clock.local_midnight(F.lit(day), EventParams().zone))) == ms


def test_file_hour(spark):
    for name in ("pageviews-20160209-050000.gz", "a.gz.20160209-050000.gz", "20160209-050000.gz.part"):
        assert value(spark, clock.file_hour(F.lit(name))) == datetime(2016, 2, 9, 5)


def test_file_hour_of_a_bad_name_fails(spark):
    with pytest.raises(Exception, match="no hour in file name"):
        value(spark, clock.file_hour(F.lit("pageviews-notadate000000.gz")))


def test_chart_date(spark):
    ts = F.lit(datetime(2016, 2, 9, 5))
    assert value(spark, clock.chart_date(ts)) == "Date(2016,02,09,05,00,00)"


def test_add_one_and_log_scale(spark):
    assert value(spark, vectors.add_one(array(0, 1.5))) == [1.0, 2.5]
    assert value(spark, vectors.log_scale(array(100, 0, -1))) == pytest.approx([2.0, -5.0, -5.0])


def test_unit_normalise_divides_by_the_fixed_length(spark):
    params = TemplateParams(series_length=2, reference_length=4, baseline_offset=1)
    # Baseline: the items before the last one, here 3 of them, over 4.
    assert value(spark, vectors.unit_normalise(array(1, 2, 3, 6), params)) == pytest.approx(
        [x / 1.5 for x in (1, 2, 3, 6)]
    )
    # Longer than the baseline stretch: only the last 4 before the offset count.
    assert value(spark, vectors.unit_normalise(array(100, 1, 2, 3, 6, 9), params)) == pytest.approx(
        [x / 3.0 for x in (100, 1, 2, 3, 6, 9)]
    )
    # Nothing before the offset, or only zeros: a tiny level instead of 0.
    assert value(spark, vectors.unit_normalise(array(7), params)) == pytest.approx([7 / 0.00001])
    assert value(spark, vectors.unit_normalise(array(0, 0, 5), params)) == pytest.approx([0, 0, 5e5])


def test_smooth(spark):
    assert value(spark, vectors.smooth(array(1, 2, 6, 10), 3)) == pytest.approx([1, 1.5, 3, 6])
    assert value(spark, vectors.smooth(array(1, 2), 1)) == [1.0, 2.0]
    assert value(spark, vectors.smooth(array(1, 2), 0)) == [1.0, 2.0]


def test_many_keywords_are_found_like_few(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abÀé😀 .*", k=rng.randint(0, 30))) for _ in range(400)] + [None, "", "ABBA", "SS ß İ"]
    keywords = [*{"".join(rng.choices("abÀé😀 .*", k=rng.randint(2, 4))) for _ in range(60)}, "bba", "bbab", "A"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    one_by_one = text.any_of([F.contains(F.lower("t"), F.lit(k)) for k in keywords])
    rows = frame.select(text.contains_any(F.col("t"), keywords).alias("many"), one_by_one.alias("each")).collect()
    assert [r.many for r in rows] == [r.each for r in rows] and 50 < sum(bool(r.many) for r in rows) < 400
    assert frame.where(text.contains_any(F.col("t"), [*keywords, ""])).count() == len(texts) - 1
    assert frame.where(text.contains_any(F.col("t"), [])).count() == 0


def test_sums_by_stamp_are_sums_by_hour(spark):
    lines = [("pageviews-20160201-000000.gz", "en A 3 0"), ("projects-20160201-000000.gz", "es a 4 0"), ("x20160201-010000.gz", "en a 5 0")]
    raw = spark.createDataFrame(lines, "file_name string, line string")
    by_stamp = series.stamped_hours(cleaning.topic_lines(raw)).collect()
    assert sorted(by_stamp) == sorted(series.topic_hours(cleaning.topic_points(raw)).collect())
    assert sorted(r.views for r in by_stamp) == [5.0, 7.0]
    bad = spark.createDataFrame([("pageviews-20161301-000000.gz", "en A 3 0")], raw.schema)
    with pytest.raises(Exception, match="no hour in file name"):
        series.stamped_hours(cleaning.topic_lines(bad)).collect()


def test_spike_normalise(spark):
    assert value(spark, vectors.spike_normalise(array(4, 0, 9), 0.5)) == pytest.approx([2, 2, 3])


def test_keep_last(spark):
    assert value(spark, vectors.keep_last(array(1, 2, 3), 2)) == [2.0, 3.0]
    assert value(spark, vectors.keep_last(array(1), 2)) == [1.0]


def test_l1_distance(spark):
    assert value(spark, vectors.l1_distance(array(1, 2), array(3, 1))) == 3.0
    with pytest.raises(Exception, match="same length"):
        value(spark, vectors.l1_distance(array(1), array(1, 2)))


def test_weight_ratio(spark):
    assert value(spark, vectors.weight_ratio(F.lit(2.0), F.lit(4.0))) == 0.5
    assert value(spark, vectors.weight_ratio(F.lit(2.0), F.lit(0.0))) == pytest.approx(2000.0)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        TemplateParams(series_length=10, reference_length=9)
    with pytest.raises(ValueError):
        PeakParams(win_length=1)
    with pytest.raises(ValueError):
        EventParams(closed="right")
