"""Report tables: what spiked around which event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text, vectors
from tidewatch.sources.signals import BUCKET_NAMES

# An event with more spikes than the first number shows the second many.
CROWDED_EVENT = 300
SHOWN_WHEN_CROWDED = 50
_PARTS = 64

# Chart placement of an event, base + share of the largest event * range.
COUNT_BASE, COUNT_RANGE = 5, 60
VIEWS_BASE, VIEWS_RANGE = 5, 15


def summarise_spikes(spikes: DataFrame) -> DataFrame:
    """``(topic, event_ts, views, total_views, offsets)`` with a readable topic.

    ``views`` joins the five buckets, ``offsets`` says where the last four of them start.
    """
    buckets = [F.col(name) for name in BUCKET_NAMES]
    sizes = [F.size(b) for b in buckets[:-1]]
    offsets = [sum(sizes[1 : i + 1], sizes[0]) for i in range(len(sizes))]
    return spikes.select(
        text.prettify_title(F.col("topic")).alias("topic"),
        "event_ts",
        F.concat(*buckets).alias("views"),
        vectors.total(F.concat(*buckets)).alias("total_views"),
        F.array(*offsets).alias("offsets"),
    )


def rank_spikes(summary: DataFrame) -> DataFrame:
    """Events in time order, the most viewed spike of each first."""
    return summary.orderBy(F.asc("event_ts"), F.desc("total_views"), F.asc("topic"))


def top_spikes(
    summary: DataFrame, crowded: int = CROWDED_EVENT, shown: int = SHOWN_WHEN_CROWDED
) -> DataFrame:
    """All spikes of an event, or its ``shown`` most viewed when it has over ``crowded``.

    A rank up to ``crowded + 1`` decides which case holds, so no more than that many spikes
    per event are of interest. Each task drops the others before the shuffle, then each of
    ``_PARTS`` parts of an event does: what meets in one task in the end is bounded by the
    parts, however many spikes one event has.
    """
    summary = summary.withColumn("_part", F.pmod(F.xxhash64("topic"), F.lit(_PARTS)))
    part = Window.partitionBy("event_ts", "_part")
    event = Window.partitionBy("event_ts")
    order = (F.desc("total_views"), F.asc("topic"))

    def leading(spikes: DataFrame, group) -> DataFrame:
        ranked = spikes.withColumn("rank", F.row_number().over(group.orderBy(*order)))
        return ranked.where(F.col("rank") <= crowded + 1)

    return (
        leading(leading(summary, part), event)
        .withColumn("_most", F.max("rank").over(event))
        .where((F.col("_most") <= crowded) | (F.col("rank") <= shown))
        .drop("_most", "_part")
    )


def event_totals(summary: DataFrame) -> DataFrame:
    """Number of spikes and their views per event."""
    return summary.groupBy("event_ts").agg(
        F.count("*").alias("spikes"), F.sum("total_views").alias("views")
    )


def with_largest(totals: DataFrame) -> DataFrame:
    """Totals with the largest number of spikes and of views of any event.

    The window is a single one, over rows already summed to one per event day.
    """
    everything = Window.partitionBy(F.lit(0))
    return totals.withColumn("max_spikes", F.max("spikes").over(everything)).withColumn(
        "max_views", F.max("views").over(everything)
    )


def party_class(only_democrats: Column, only_republicans: Column) -> Column:
    return (
        F.when(only_democrats, F.lit("democrats"))
        .when(only_republicans, F.lit("republicans"))
        .otherwise(F.lit("mixed"))
    )


def calendar_dates(calendar: DataFrame) -> DataFrame:
    """``(event_ts, tooltip, parties, party_class)``: one row per date of the calendar.

    The tooltip lists the events of the date in calendar order. A blank field is read as null;
    it counts as an empty text, and a blank party as one of its own.
    """
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("party", "type", "location")]
    calendar = calendar.select("event_ts", "position", *blank)
    line = F.concat("party", F.lit(" "), "type", F.lit(" in "), "location", F.lit("<br>"))
    listed = F.sort_array(F.collect_list(F.struct("position", line.alias("line"))))
    return calendar.groupBy("event_ts").agg(
        F.array_join(F.transform(listed, lambda p: p["line"]), "").alias("tooltip"),
        F.sort_array(F.collect_set("party")).alias("parties"),
        party_class(
            F.bool_and(F.col("party") == "democrats"),
            F.bool_and(F.col("party") == "republicans"),
        ).alias("party_class"),
    )


def event_bubbles(calendar: DataFrame, summary: DataFrame) -> DataFrame:
    """One bubble per calendar date: spikes, views, chart position and size, class.

    Dates without a spike stay, with zeros. Both sides of the join have one row per event.
    """
    totals = with_largest(event_totals(summary))
    joined = calendar_dates(calendar).join(totals, "event_ts", "left")

    def scaled(value: str, most: str, base: int, reach: int) -> Column:
        return F.lit(base) + F.try_divide(F.col(value), F.col(most)) * reach

    return joined.select(
        "event_ts",
        F.coalesce("spikes", F.lit(0)).alias("spikes"),
        F.coalesce("views", F.lit(0.0)).alias("views"),
        F.coalesce(scaled("spikes", "max_spikes", COUNT_BASE, COUNT_RANGE), F.lit(COUNT_BASE)).alias("y"),
        F.coalesce(scaled("views", "max_views", VIEWS_BASE, VIEWS_RANGE), F.lit(VIEWS_BASE)).alias("z"),
        "tooltip",
        "party_class",
    )
