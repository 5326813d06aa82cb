from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tidewatch.operators import templates
from tidewatch.params import TemplateParams
from tidewatch.sources import references

PARAMS = TemplateParams(5, 8, 0.1, 0.1, 2, 3)


def prepared(x: list[float], p: TemplateParams) -> list[float]:
    x = [v + 1 for v in x]
    end = len(x) - p.baseline_offset
    level = sum(x[max(end - p.reference_length, 0) : max(end, 0)]) / p.reference_length or 0.00001
    x = [math.log10(v / level if v / level > 0 else 0.00001) for v in x]
    width = max(p.smooth, 1)
    return [sum(x[max(i - width + 1, 0) : i + 1]) / min(i + 1, width) for i in range(len(x))]


def scores(x: list[float], library: list[tuple[bool, list[float]]], p: TemplateParams) -> list[float]:
    out = []
    for n in range(1, len(x) + 1):
        buffer = x[max(n - p.reference_length, 0) : n]
        weights = {True: 0.0, False: 0.0}
        if len(buffer) == p.reference_length and sum(x[:n]) != 0:
            test = prepared(buffer, p)[-p.series_length :]
            for trending, ref in library:
                ds = [
                    sum(abs(a - b) for a, b in zip(ref[i : i + p.series_length], test))
                    for i in range(len(ref) - p.series_length + 1)
                ]
                weights[trending] += math.exp(-p.decay * min(ds)) if ds else 0.0
        out.append(weights[True] / (weights[False] or 0.001))
    return out


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", None if i == 7 else i % 3 == 0, [rng.lognormvariate(2, 1) for _ in range(rng.randint(3, 14))]) for i in range(9)]
    frame = spark.createDataFrame(rows, "ref_id string, trending boolean, values array<double>")
    return references.prepare_references(frame, PARAMS).persist()


def test_prepared_references(spark, library):
    rows = library.collect()
    assert all(len(r.series) <= 8 for r in rows)
    raw = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0, 7.0, 6.0, 2.0]
    frame = spark.createDataFrame([("a", True, raw)], "ref_id string, trending boolean, values array<double>")
    row = references.prepare_references(frame, PARAMS).first()
    assert row.series == pytest.approx(prepared(raw, PARAMS)[-8:])


@pytest.mark.parametrize("per_chunk, blocks", [(256, None), (4, 1), (1, 5), (2, 40)])
def test_scores_match_a_plain_loop(make_series, library, per_chunk, blocks):
    rng = random.Random(11)
    topics = {f"t{i}": [float(rng.randint(0, 50)) for _ in range(rng.randint(4, 60))] for i in range(6)}
    topics["zeros first"] = [0.0] * 12 + [4.0, 9.0]
    topics["only zeros"] = [0.0] * 12
    known = [(bool(r.trending), r.series) for r in library.collect()]
    rows = templates.template_scores(make_series(topics), library, PARAMS, per_chunk, blocks)
    found: dict[str, list[float]] = {}
    for r in rows.orderBy("topic", "ts").collect():
        found.setdefault(r.topic, []).append(r.signal)
    assert set(found) == set(topics)
    for topic, x in topics.items():
        assert found[topic] == pytest.approx(scores(x, known, PARAMS), abs=1e-9)
    assert found["only zeros"] == [0.0] * 12


def test_scores_start_once_the_window_is_full(make_series, library):
    """Default parameters: zero for 149 points, positive from then on."""
    rng = random.Random(2)
    topics = {f"s{n}": [float(rng.randint(1, 90)) for _ in range(n)] for n in (264, 369)}
    params = TemplateParams()
    raw = [("a", True, [float(i % 17) for i in range(200)]), ("b", False, [float(i % 5) for i in range(200)])]
    frame = library.sparkSession.createDataFrame(raw, "ref_id string, trending boolean, values array<double>")
    known = references.prepare_references(frame, params)
    rows = templates.template_scores(make_series(topics), known, params).orderBy("topic", "ts").collect()
    for n in (264, 369):
        signal = [r.signal for r in rows if r.topic == f"s{n}"]
        assert len(signal) == n
        assert signal[:149] == [0.0] * 149 and min(signal[149:]) > 0


def test_library_is_stored_and_grows(spark, tmp_path):
    frame = spark.createDataFrame([("a", True, [1.0] * 10)], "ref_id string, trending boolean, values array<double>")
    references.add_references(frame, str(tmp_path / "lib"), PARAMS)
    references.add_references(frame.withColumn("ref_id", F.lit("b")), str(tmp_path / "lib"), PARAMS)
    assert sorted(r.ref_id for r in references.read_references(spark, str(tmp_path / "lib")).collect()) == ["a", "b"]


def test_no_job_runs_while_the_plan_is_built(spark, make_series, library):
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup() or [0])
    templates.template_scores(make_series({"t": [5.0] * 9}), library, PARAMS)
    assert max(spark.sparkContext.statusTracker().getJobIdsForGroup() or [0]) == before


def test_an_empty_library_weighs_nothing(make_series, library):
    rows = templates.template_weights(make_series({"t": [5.0] * 9}), library.where("false"), PARAMS).collect()
    assert len(rows) == 9 and all(r.trend_weight == r.other_weight == 0 for r in rows)


def test_references_without_one_class(make_series, library):
    only = library.where("trending")
    rows = templates.template_scores(make_series({"t": [5.0] * 9}), only, PARAMS).orderBy("ts").collect()
    assert rows[-1].signal > 0.001


def test_nearest_leaves_out_no_nearer_slice():
    rng = np.random.default_rng(1)
    for n, m, t in [(1, 6, 9), (3, 1, 4), (7, 30, 50), (24, 13, 200)]:
        tests, ref = rng.normal(size=(t, n)).cumsum(axis=1), rng.normal(size=n + m - 1).cumsum()
        ref[: n // 2] = tests[0][: n // 2]
        slices = np.lib.stride_tricks.sliding_window_view(ref, n)
        expected = np.abs(tests[:, None, :] - slices[None]).sum(axis=2).min(axis=1)
        assert templates.nearest(tests, slices) == pytest.approx(expected, abs=1e-12)


def test_slice_weight_of_each_row(spark):
    rng = random.Random(6)
    rows = [([rng.random() for _ in range(rng.randint(0, 30))], [rng.random() for _ in range(rng.choice([4, 4, 4, 2]))]) for _ in range(200)]
    rows += [(None, [1.0] * 4), ([1.0] * 9, None)]
    params = TemplateParams(series_length=4, reference_length=4, decay=0.5)
    frame = spark.createDataFrame(rows, "r array<double>, t array<double>").coalesce(2)
    found = frame.select("r", "t", templates.slice_weight(F.col("r"), F.col("t"), params).alias("w")).collect()
    for row in found:
        ds = [sum(abs(a - b) for a, b in zip(row.r[i : i + 4], row.t or [])) for i in range(len(row.r or []) - 3)]
        assert row.w == pytest.approx(math.exp(-0.5 * min(ds)) if ds and len(row.t or []) == 4 else 0.0)


def test_series_are_shuffled_once_whatever_the_library(spark, make_series):
    """No broadcast, no copies of the series in a shuffle, and nothing shuffled after the join."""
    topics = make_series({f"t{i}": [float(i + j) for j in range(12)] for i in range(9)})
    # 40,000 references of 400 bytes: above the broadcast threshold of 10 MB.
    large = spark.range(40_000).selectExpr("id AS ref_id", "id % 2 = 0 AS trending", "transform(sequence(1, 50), i -> double(i * id % 7)) AS series")
    plan = plan_of(templates.template_weights(topics, large, PARAMS))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # The plan is printed from the top: everything after the join stands above it.
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    assert plan.count("Exchange hashpartitioning(_block") == 1
    rows = templates.template_weights(topics, large.limit(2_000), PARAMS).collect()
    assert len(rows) == 9 * 12 and sum(r.trend_weight > 0 for r in rows) == 9 * 5
