"""Signals one hour at a time, equal to the batch results for all closed hours.

One query: points are summed per topic and hour, with a partial sum before the shuffle, and once the
watermark has passed an hour its sum goes on to an operator that holds the state of its topic. Hours close
in their order, so a topic's state takes them in batch after batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import vectors
from tidewatch.operators.templates import prepared_windows, weights_of
from tidewatch.params import PeakParams, TemplateParams

_SIGNAL = "topic string, ts timestamp, views double, signal double"
# Peaks: hours waiting for the first baseline; afterwards only the baseline itself is kept.
_PEAK_STATE = "waiting_ts array<timestamp>, waiting array<double>, mean double, std double"
# Scores: the last points, one fewer than a window has, and whether any point so far was not 0.
_SCORE_STATE = "recent array<double>, started boolean"
#: Bytes of reference series that are sent to every task of a stream.
LIBRARY_BYTES = 64 << 20
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes its changes of the state, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Late rows are counted over all batches of a run.
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}

Rows = list[tuple]
Step = Callable[[tuple | None, Sequence, list[float]], tuple[tuple, Rows]]


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 24) -> DataFrame:
    """Arriving hourly count files as ``(file_name, line)``."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return stream.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


def closed_hours(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sum of views per topic and hour, given out once the watermark has passed the hour."""
    hour = F.window("ts", "1 hour")
    return (
        points.withWatermark("ts", delay)
        .groupBy("topic", hour)
        .agg(F.sum("views").alias("views"))
        .select("topic", F.col("window.start").alias("ts"), F.col("views").cast("double").alias("views"))
    )


class _Series(StatefulProcessor):
    """Takes the hours of a topic in their order; its state is one value of a fixed size."""

    def __init__(self, step: Step, schema: str):
        self.step, self.schema = step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values("ts")
        before = self.state.get() if self.state.exists() else None
        after, out = self.step(before, list(arrived["ts"]), arrived["views"].tolist())
        self.state.update(after)
        found = pd.DataFrame(out, columns=["ts", "views", "signal"])
        found.insert(0, "topic", key[0])
        yield found

    def close(self) -> None:
        pass


def _stateful(hours: DataFrame, step: Step, schema: str) -> DataFrame:
    return hours.groupBy("topic").transformWithStateInPandas(_Series(step, schema), _SIGNAL, "append", "none")


def peak_step(params: PeakParams) -> Step:
    """The peak signal of some more hours of a topic."""
    k, d, f = params.win_length, params.diff, params.influence

    def step(state: tuple | None, arrived: Sequence, views: list[float]) -> tuple[tuple, Rows]:
        times, waiting, mean, std = state or ([], [], None, None)
        times, waiting = list(times or []), list(waiting or [])
        out: Rows = []
        for ts, v in zip(arrived, views):
            if mean is None and len(waiting) < k:
                times.append(ts)
                waiting.append(v)
                continue
            if mean is None:
                first = [*waiting[1:], v]
                mean = sum(first) / k
                std = sqrt(sum((x - mean) ** 2 for x in first)) / (k - 1)
                out = [(t, x, 0.0) for t, x in zip(times, waiting)]
                times, waiting = [], []
            away = abs(v - mean)
            if v > mean + d * std:
                mean, std = mean + v * f / (1 + f), std + away * f / (1 + f)
                out.append((ts, v, 1.0))
            else:
                mean, std = (mean + v) / 2, (std + away) / 2
                out.append((ts, v, 0.0))
        return (times, waiting, mean, std), out

    return step


def score_step(trending: list[np.ndarray], others: list[np.ndarray], params: TemplateParams) -> Step:
    """The trend score of some more hours of a topic, each from the window that ends with it."""
    keep = params.reference_length - 1

    def step(state: tuple | None, arrived: Sequence, views: list[float]) -> tuple[tuple, Rows]:
        recent, started = state or ([], False)
        x = np.array([*(recent or []), *views], dtype=float)
        new = np.array(views, dtype=float)
        signal = np.zeros(len(new))
        if len(x) > keep:
            tests = prepared_windows(x, params)
            trend, other = (weights_of(tests, refs, params) for refs in (trending, others))
            signal[-len(tests) :] = trend / np.where(other == 0, vectors.EMPTY_WEIGHT, other)
        # Nothing is scored while all points of the topic so far are zero.
        any_before = np.logical_or.accumulate(new != 0) | started
        signal[~any_before] = 0.0
        return (x[max(len(x) - keep, 0) :].tolist(), bool(any_before[-1])), list(zip(arrived, views, signal.tolist()))

    return step


def live_peaks(hours: DataFrame, params: PeakParams = PeakParams()) -> DataFrame:
    """``(topic, ts, views, signal)`` from closed hours ``(topic, ts, views)``.

    The state of a topic is its baseline, or before that at most ``win_length`` hours.
    """
    return _stateful(hours, peak_step(params), _PEAK_STATE)


def live_scores(
    hours: DataFrame,
    references: DataFrame,
    params: TemplateParams = TemplateParams(),
    library_bytes: int = LIBRARY_BYTES,
) -> DataFrame:
    """``(topic, ts, views, signal)`` with the similarity score, from closed hours ``(topic, ts, views)``.

    The state of a topic is its last ``reference_length`` - 1 points. The library is measured and then sent to the
    tasks; one above ``library_bytes`` is refused, since a stream has no second shuffle for it: score
    the closed hours with ``template_scores`` then.
    """
    items = references.agg(F.coalesce(F.sum(F.size("series")), F.lit(0))).first()[0]
    if items * 8 > library_bytes:
        raise ValueError(f"the library has {items * 8} bytes, more than library_bytes: score the hours with template_scores")
    library = references.select(F.coalesce("trending", F.lit(False)), "series").collect()
    trending, others = ([np.array(s, dtype=float) for t, s in library if t == kind and s] for kind in (True, False))
    return _stateful(hours, score_step(trending, others, params), _SCORE_STATE)


@contextmanager
def _settings(spark: SparkSession, close: bool) -> Iterator[None]:
    """The settings a stream takes over when it starts."""
    settings = {**_SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled": str(close).lower()}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_available(stream: DataFrame, folder: str, close: bool = True) -> str:
    """Process what has arrived since the last run into parquet below ``folder``.

    Unless ``close`` is set, hours that the last of it closes come out in the next run.

    The folder, which must be shared by all executors, also holds the checkpoint: a restarted
    run goes on where the last one ended. Returns the path of the rows. The sums that came too late for
    their hour, and were left out, are counted in ``late``, a row per run that had any.
    """
    spark = stream.sparkSession
    with _settings(spark, close):
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        query.awaitTermination()
        late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    if late:
        spark.range(1).selectExpr(f"{late}L AS late").write.mode("append").parquet(f"{folder}/late")
    return f"{folder}/rows"


def late_sums(spark: SparkSession, folder: str) -> int:
    """Sums of a topic and an hour, as tasks made them, that all runs so far left out as late."""
    spark.createDataFrame([], "late long").write.mode("append").parquet(f"{folder}/late")
    return spark.read.schema("late long").parquet(f"{folder}/late").agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]


def whole_length(points: DataFrame) -> str:
    """A delay that loses no point of a finished table, whatever the order of its files: its whole length.

    The open hours are then as many as the table covers, one sum per topic each.
    """
    ends = points.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).selectExpr("timestampdiff(SECOND, a, b) AS s").first()
    return f"{(ends.s or 0) + 3600} seconds"


_CLOSING = "topic string, ts timestamp, views double"


def update_signals(
    points: DataFrame,
    folder: str,
    signal: Callable[[DataFrame], DataFrame] | PeakParams,
    delay: str,
    last: bool = False,
) -> DataFrame:
    """Bring the signals below ``folder`` up to date with a stream of points.

    ``signal`` turns closed hours into signals, such as ``live_peaks`` and ``live_scores``; parameters alone
    mean peaks. An hour comes out once the watermark has passed it. ``last`` says that the input has ended: what has
    arrived is processed, then a point far in the future, without a topic, closes the hours still open.
    Points that arrive after that, or later than ``delay``, are left out and counted (``late_sums``).
    """
    spark = points.sparkSession
    params = signal
    found = (lambda hours: live_peaks(hours, params)) if isinstance(signal, PeakParams) else signal
    end = f"{folder}/closing"
    spark.createDataFrame([], _CLOSING).write.mode("ignore").parquet(end)
    kind = points.schema["views"].dataType
    closing = spark.readStream.schema(_CLOSING).parquet(end).withColumn("views", F.col("views").cast(kind))
    # The closing point's own hour never closes, so it needs no filter; one would be moved below the
    # watermark and hide the point from it.
    signals = found(closed_hours(points.select("topic", "ts", "views").unionByName(closing), delay))
    rows = run_available(signals, folder, close=not last)
    if last:
        spark.range(1).selectExpr(
            "CAST(NULL AS string) AS topic", "timestamp'9000-01-01 00:00:00' AS ts", "0D AS views"
        ).write.mode("append").parquet(end)
        run_available(signals, folder)
    return spark.read.schema(_SIGNAL).parquet(rows)
