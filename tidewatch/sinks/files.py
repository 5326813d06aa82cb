"""File sinks. Only results of a bounded size go to a single file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.sources.signals import BUCKET_NAMES


def write_signals(signals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Signals as parquet, one folder per UTC day.

    The rebalance lets AQE give every day files of a good size; the day folders let the
    search around events read only the days it needs (dynamic partition pruning). Within a file rows
    are sorted by topic, so that a scan for one topic skips the row groups without it.
    """
    by_day = signals.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
    by_day.sortWithinPartitions("day", "topic", "ts").write.mode(mode).partitionBy("day").parquet(path)


def signal_text(packed: DataFrame, points: str = "points") -> DataFrame:
    """Text records ``(topic,[(ms,views,signal), ...])`` from packed series."""

    def triple(p: Column) -> Column:
        ms = F.unix_millis(p["ts"]).cast("string")
        numbers = F.concat_ws(",", ms, p["views"].cast("string"), p["signal"].cast("string"))
        return F.concat(F.lit("("), numbers, F.lit(")"))

    series = F.array_join(F.transform(points, triple), ", ")
    return packed.select(
        F.concat(F.lit("("), F.col("topic"), F.lit(",["), series, F.lit("])")).alias("value")
    )


def write_signal_text(packed: DataFrame, path: str) -> None:
    signal_text(packed).write.text(path, compression="gzip")


def spike_json(spikes: DataFrame) -> DataFrame:
    """One JSON object per spike."""
    fields = [
        F.col("topic"),
        F.unix_millis("event_ts").alias("event_timestamp"),
        *map(F.col, BUCKET_NAMES),
    ]
    return spikes.select(F.to_json(F.struct(*fields)).alias("value"))


def write_spikes(spikes: DataFrame, path: str, single_file: bool = False) -> None:
    """Spikes as JSON lines, a file per task, or one file with ``single_file``.

    Then ``repartition(1)`` rather than ``coalesce(1)``: the search for spikes keeps its
    parallelism and only finished lines meet in the writing task.
    """
    lines = spike_json(spikes)
    (lines.repartition(1) if single_file else lines).write.text(path)


def matrix_text(matrix: DataFrame) -> DataFrame:
    """``(ts, value)``: the text row of each hour, ``Date(...)`` and the numbers by spaces."""
    numbers = [F.col(c).cast("string") for c in matrix.columns if c != "ts"]
    return matrix.select("ts", F.concat_ws(" ", clock.chart_date(F.col("ts")), *numbers).alias("value"))


def write_matrix(matrix: DataFrame, pages: list[str], path: str) -> None:
    """Hour x page matrix as one text file: a header with the titles, then a row per hour."""
    header = matrix.sparkSession.range(1).select(
        F.lit(None).cast("timestamp").alias("ts"), F.lit(" ".join(["Date", *pages])).alias("value")
    )
    lines = header.unionByName(matrix_text(matrix)).repartition(1)
    lines.sortWithinPartitions(F.asc_nulls_first("ts")).select("value").write.text(path)


def topic_chart(signals: DataFrame, topic: str) -> DataFrame:
    """``(id, views, signal, time)`` of one topic; the filter reaches the parquet scan."""
    picked = signals.where(F.col("topic") == topic)
    # One topic has one row per hour, so a single sorted task is enough.
    packed = picked.agg(F.sort_array(F.collect_list(F.struct("ts", "views", "signal"))).alias("p"))
    return packed.select(F.posexplode("p").alias("id", "p")).select(
        F.col("id").cast("bigint").alias("id"), "p.views", "p.signal", F.col("p.ts").alias("time")
    )


def write_topic_chart(signals: DataFrame, topic: str, path: str) -> None:
    topic_chart(signals, topic).coalesce(1).write.csv(path, header=True)
