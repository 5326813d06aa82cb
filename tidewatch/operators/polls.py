"""Poll movements around an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text

# Fixed value: entries shown on either side of the poll of the event's date.
NEIGHBOURS = 2


def poll_neighbourhood(
    entries: DataFrame, events: DataFrame, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """Entries from ``neighbours`` before to ``neighbours`` after the entry of an event's date.

    A poll without an entry on that date is not shown for the event. Of several entries of a poll on
    one date the first counts as the event's; ``entry_no`` counts all. Each entry takes over the events matched by itself and its
    neighbours, so the entries are read once and joined with nothing but the event dates.
    """
    dates = events.select("event_ts").distinct()
    by_date = Window.partitionBy("poll").orderBy("entry_ts", "candidate")
    nearby = by_date.rowsBetween(-neighbours, neighbours)
    matched = entries.join(dates, F.col("entry_ts") == F.col("event_ts"), "left")
    again = F.lag("entry_ts").over(by_date).eqNullSafe(F.col("entry_ts"))
    return (
        matched.withColumn("entry_no", F.row_number().over(by_date))
        .withColumn("_event", F.when(~again, F.col("event_ts")))
        .withColumn("_events", F.collect_list("_event").over(nearby))
        .select(*entries.columns, "entry_no", F.explode("_events").alias("event_ts"))
    )


def entry_midpoints(neighbourhood: DataFrame) -> DataFrame:
    """``(poll, event_ts, midpoint_ms)``: halfway from each entry to the one before it."""
    order = Window.partitionBy("poll", "event_ts").orderBy("entry_ts")
    ms = F.unix_millis("entry_ts")
    middle = F.floor((ms + F.lag(ms).over(order)) / 2)
    return neighbourhood.select("poll", "event_ts", middle.alias("midpoint_ms")).where(
        F.col("midpoint_ms").isNotNull()
    )


def candidate_points(neighbourhood: DataFrame) -> DataFrame:
    """``(poll, event_ts, name, entry_ts, value)``: one row per candidate and entry."""
    return neighbourhood.select(
        "poll", "event_ts", "entry_ts", F.explode("candidate").alias("c")
    ).select(
        "poll",
        "event_ts",
        F.col("c.name").alias("name"),
        "entry_ts",
        text.leading_number(F.col("c.value")).alias("value"),
    )


def candidate_series(neighbourhood: DataFrame) -> DataFrame:
    """Points of each candidate as one ordered array; at most one per neighbouring entry."""
    return (
        candidate_points(neighbourhood)
        .groupBy("poll", "event_ts", "name")
        .agg(F.sort_array(F.collect_list(F.struct("entry_ts", "value"))).alias("points"))
    )
