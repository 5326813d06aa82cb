"""Spikes around calendar events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.params import EventParams
from tidewatch.sources.signals import BUCKET_NAMES

# First and last hour of each day bucket, relative to the event.
BUCKET_HOURS = ((-48, -24), (-24, 0), (0, 24), (24, 48), (48, 72))


def event_buckets(events: DataFrame) -> DataFrame:
    """``(event_ts, bucket, lo, hi, day)``: the day buckets, one row per UTC day they touch.

    A date that the calendar lists several times is one event.
    """
    rows = ", ".join(
        f"{i}, event_ts + interval {lo} hours, event_ts + interval {hi} hours"
        for i, (lo, hi) in enumerate(BUCKET_HOURS)
    )
    buckets = events.select("event_ts").distinct().selectExpr(
        "event_ts", f"stack({len(BUCKET_HOURS)}, {rows}) AS (bucket, lo, hi)"
    )
    return buckets.withColumn("day", F.expr("explode(sequence(date(lo), date(hi)))"))


# Bytes of a window row in memory, about, and the days its buckets touch.
_WINDOW_BYTES, _WINDOW_DAYS = 64, 2
#: Parts of a day when the calendar is not broadcast.
SALTS = 64


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts the side of a join; -1 means never."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def salts_for(events: DataFrame) -> int:
    """Into how many parts the topics of a day are dealt: one for a calendar that Spark broadcasts."""
    rows = events.select("event_ts").distinct().count() * len(BUCKET_HOURS) * _WINDOW_DAYS
    return 1 if rows * _WINDOW_BYTES <= broadcast_limit(events.sparkSession) else SALTS


def window_points(
    signals: DataFrame, events: DataFrame, params: EventParams = EventParams(), salts: int = 1
) -> DataFrame:
    """Points of the signals in each event's day buckets, with ``event_ts`` and ``bucket``.

    A range join written as an equi-join on the UTC day with the exact bounds as residual.
    No side is forced: Spark broadcasts the calendar while its size stays below the broadcast
    threshold, and the signals then keep their place and their partitioning by topic. Signals stored in day
    folders are pruned to the days needed.

    A larger calendar is sort-merge joined. All topics of a day would then be one join key; with
    ``salts`` (``salts_for`` the calendar) a hash of the topic deals them into so many parts, each of which meets
    its own copy of the day's windows. The rows are the same whatever ``salts`` is.
    """
    by_day = signals if "day" in signals.columns else signals.selectExpr("*", "date(ts) AS day")
    inside = "ts >= lo AND ts <= hi" if params.closed == "both" else "ts >= lo AND ts < hi"
    windows, keys = event_buckets(events), ["day"]
    if salts > 1:
        by_day = by_day.withColumn("_salt", F.pmod(F.xxhash64("topic"), F.lit(salts)).cast("int"))
        windows = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        keys = ["day", "_salt"]
    return by_day.join(windows, keys).where(inside).drop(*keys, "lo", "hi")


def event_windows(points: DataFrame) -> DataFrame:
    """Per topic and event: five ordered view arrays, totals, and whether a peak was seen.

    A bucket holds at most 25 hourly points, so the lists are bounded; an empty bucket is an
    empty array.
    """
    grouped = points.groupBy("topic", "event_ts").agg(
        F.expr("sort_array(collect_list(struct(bucket, ts, views))) AS _p"),
        F.expr("sum(views) AS total_views"),
        F.expr("count(*) AS points"),
        F.expr("bool_or(signal > 0) AS has_peak"),
    )
    buckets = [
        f"transform(filter(_p, p -> p.bucket = {i}), p -> p.views) AS {name}"
        for i, name in enumerate(BUCKET_NAMES)
    ]
    return grouped.selectExpr("topic", "event_ts", *buckets, "total_views", "points", "has_peak")


def find_spikes(
    signals: DataFrame, events: DataFrame, params: EventParams = EventParams(), salts: int = 1
) -> DataFrame:
    """Event windows with a peak and at least ``views_threshold`` views per point."""
    windows = event_windows(window_points(signals, events, params, salts))
    busy = f"total_views / points >= {float(params.views_threshold)!r}D"
    return windows.where(f"has_peak AND {busy}").drop("points", "has_peak")
