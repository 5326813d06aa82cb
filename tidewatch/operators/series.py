"""Hourly series: sums per hour, packed and dense forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import clock


def topic_hours(points: DataFrame) -> DataFrame:
    """Sum of views per topic and hour. Hours without a line stay absent.

    The key holds the hour, so even a topic with a third of all lines spreads over as many
    reducers as it has hours, and the map side sums before the shuffle.
    """
    return points.groupBy("topic", "ts").agg(F.sum("views").alias("views"))


def stamped_hours(lines: DataFrame) -> DataFrame:
    """``topic_hours`` of ``(topic, stamp, views)``: a stamp is an hour, so it is read after the sum.

    Parsing a time costs as much as the rest of a line; here it is done once per topic and hour. A stamp that
    is no hour is an error.
    """
    summed = lines.groupBy("topic", "stamp").agg(F.sum("views").alias("views"))
    return summed.select("topic", clock.stamp_hour(F.col("stamp")).alias("ts"), "views")


def page_hours(points: DataFrame) -> DataFrame:
    """Sum of views per page and hour."""
    return points.groupBy("title", "ts").agg(F.sum("views").alias("views"))


def page_totals(hours: DataFrame) -> DataFrame:
    """Sum of views per page over all hours, from sums per hour or from points."""
    return hours.groupBy("title").agg(F.sum("views").alias("total"))


def pack(series: DataFrame, *fields: str) -> DataFrame:
    """One row per topic with ``points``, its rows in time order.

    Only for series that hold one row per topic and hour: a packed row is then no longer
    than the number of hours covered (8,784 in a leap year), however many lines there were.
    """
    values = F.struct("ts", *(fields or ("views",)))
    return series.groupBy("topic").agg(F.sort_array(F.collect_list(values)).alias("points"))


def unpack(packed: DataFrame, points: str = "points") -> DataFrame:
    """Back to one row per topic and hour."""
    return packed.select("topic", F.explode(points).alias("p")).select("topic", "p.*")


def values(points: Column | str, field: str = "views") -> Column:
    """One field of packed points as an array."""
    return F.transform(points, lambda p: p[field])


def hour_spine(times: DataFrame) -> DataFrame:
    """Every hour from the first to the last ``ts``, both included."""
    ends = times.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return ends.select(F.explode(clock.hours_between(F.col("first"), F.col("last"))).alias("ts"))


def densify_packed(packed: DataFrame) -> DataFrame:
    """Add the absent hours of each packed series, between its first and last, with 0 views.

    The gap after each point is filled from that point alone, in place: no join and no spine per
    topic.
    """

    def with_gap(p: Column, i: Column) -> Column:
        following = F.get("points", i + 1)["ts"]
        until = F.coalesce(following - F.expr("interval 1 hour"), p["ts"])
        hours = clock.hours_between(p["ts"], until)
        return F.transform(
            hours,
            lambda h: F.struct(
                h.alias("ts"), F.when(h == p["ts"], p["views"]).otherwise(F.lit(0.0)).alias("views")
            ),
        )

    return packed.withColumn("points", F.flatten(F.transform("points", with_gap)))


def densify(series: DataFrame) -> DataFrame:
    """The long form of ``densify_packed``, from long rows."""
    return unpack(densify_packed(pack(series)))
