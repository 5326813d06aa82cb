from __future__ import annotations

import math
import random
import statistics

import pytest
from conftest import naive
from pyspark.sql import functions as F

from tidewatch.operators import peaks, rolling, series
from tidewatch.params import PeakParams


def loop(x: list[float], k: int, d: float, f: float) -> list[float]:
    """The signal written down step by step."""
    mean = math.fsum(x[1 : k + 1]) / k
    std = statistics.stdev(x[1 : k + 1]) / math.sqrt(k - 1)
    out = [0.0] * k
    for v in x[k:]:
        away = abs(v - mean)
        if v > mean + d * std:
            std, mean = std + f * away / (1 + f), mean + f * v / (1 + f)
            out.append(1.0)
        else:
            std, mean = (std + away) / 2, (mean + v) / 2
            out.append(0.0)
    return out


def found(frame) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in frame.orderBy("topic", "ts").collect():
        out.setdefault(r.topic, []).append(r.signal)
    return out


@pytest.mark.parametrize("f", [0.0, 0.3])
def test_matches_a_plain_loop(make_series, f):
    rng = random.Random(7)
    topics = {
        f"t{i}": [rng.choice([1, 1, 1, 8]) * rng.lognormvariate(3, 0.7) for _ in range(rng.randint(12, 300))]
        for i in range(40)
    }
    result = found(peaks.detect_peaks(make_series(topics), PeakParams(10, 2.0, f)))
    assert result == {t: loop(x, 10, 2.0, f) for t, x in topics.items()}
    assert sum(map(sum, result.values())) > 50


def test_length_guard(make_series):
    topics = {"k": [1.0] * 5, "k+1": [1.0] * 6}
    assert found(peaks.detect_peaks(make_series(topics), PeakParams(5, 3.0))) == {"k+1": [0.0] * 6}


def test_flat_then_raised_stays_a_peak(make_series):
    """With influence 0 the baseline never follows: every later point is a peak."""
    x = [0.0] * 11 + [1.0] * 200
    result = found(peaks.detect_peaks(make_series({"a": x}), PeakParams(10, 10.0)))
    assert result["a"] == [0.0] * 11 + [1.0] * 200


def test_comparison_is_strict(make_series):
    assert found(peaks.detect_peaks(make_series({"a": [3.0] * 20}), PeakParams(4, 5.0)))["a"] == [0.0] * 20


def test_nan_is_no_peak(make_series):
    x = [1.0, 2.0, 1.0, 2.0, 1.0, math.nan, 90.0]
    assert found(peaks.detect_peaks(make_series({"a": x}), PeakParams(3, 1.0)))["a"] == loop(x, 3, 1.0, 0.0)


def test_gaps_shorten_the_window(make_series):
    x = [1.0, None, 2.0, None, 1.0, 50.0]
    assert found(peaks.detect_peaks(make_series({"a": x}), PeakParams(3, 1.0))) == {
        "a": loop([1.0, 2.0, 1.0, 50.0], 3, 1.0, 0.0)
    }


def test_peaking_only_drops_quiet_topics(make_series):
    topics = {"quiet": [2.0] * 30, "loud": [2.0] * 29 + [90.0]}
    result = found(peaks.detect_peaks(make_series(topics), PeakParams(5, 3.0), peaking_only=True))
    assert list(result) == ["loud"] and result["loud"][-1] == 1.0


def test_packed_form_says_the_same(make_series):
    rng = random.Random(3)
    frame = make_series({f"t{i}": [rng.lognormvariate(1, 1) for _ in range(150)] for i in range(5)})
    params = PeakParams(12, 2.0)
    assert found(series.unpack(peaks.packed_peaks(frame, params))) == found(peaks.detect_peaks(frame, params))


def test_moving_statistics(make_series):
    x, k = [4.0, 8.0, 6.0, 1.0, 9.0], 3
    frame = make_series({"a": x})
    means = [r.moving_mean for r in rolling.moving_mean(frame, k).orderBy("ts").collect()]
    assert means == pytest.approx([4 / 3, 12 / 3, 18 / 3, 15 / 3, 16 / 3])
    stds = [r.moving_std for r in rolling.moving_std(frame, k).orderBy("ts").collect()]
    dev = [v - sum(x) / 5 for v in x]
    expected = []
    for i in range(5):
        part = dev[max(0, i - k + 1) : i + 1]
        expected.append(math.sqrt(sum(v * v for v in part) - sum(part) ** 2 / k) / (k - 1))
    assert stds == pytest.approx(expected)
    for i in range(k - 1, 5):
        assert stds[i] == pytest.approx(statistics.stdev(x[i - k + 1 : i + 1]) / math.sqrt(k - 1))


def test_trailing_forms(make_series):
    frame = make_series({"a": [4.0, 0.0, 9.0]})
    change = rolling.spike_normalised(frame, 0.5).orderBy("ts").collect()
    assert [r.change for r in change] == pytest.approx([2, 2, 3])
    smooth = rolling.trailing_mean(frame, 2).orderBy("ts").collect()
    assert [r.smoothed for r in smooth] == pytest.approx([4, 2, 4.5])
    rows = rolling.trailing_windows(frame, 2).orderBy("ts").collect()
    assert [(r.buffer, r.running_total) for r in rows] == [([4], 4), ([4, 0], 4), ([0, 9], 13)]


def test_densify(make_series):
    rows = series.densify(make_series({"a": [1.0, None, None, 2.0], "b": [5.0]})).collect()
    assert sorted((r.topic, r.ts, r.views) for r in rows) == [
        ("a", naive(0), 1.0),
        ("a", naive(1), 0.0),
        ("a", naive(2), 0.0),
        ("a", naive(3), 2.0),
        ("b", naive(0), 5.0),
    ]


def test_a_third_of_all_lines_on_one_topic(spark):
    """Millions of lines of one topic shrink to its hours before they meet."""
    lines = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5000)).alias("topic"),
        F.timestamp_seconds(F.lit(1454284800) + F.pmod(F.hash("id"), F.lit(200)) * 3600).alias("ts"),
        F.lit(1.0).alias("views"),
    )
    hours = series.topic_hours(lines)
    assert hours.where("topic = 'hot'").count() == 200
    assert hours.agg(F.sum("views")).first()[0] == 300_000
    assert series.pack(hours).agg(F.max(F.size("points"))).first()[0] <= 200
