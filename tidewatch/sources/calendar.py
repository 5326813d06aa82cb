"""Event dates and the event calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import clock
from tidewatch.params import EventParams

CALENDAR_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("Date", "Type", "Party", "Location", "Topic")]
)

# A quote inside quotes is doubled.
CSV_FORM = {"quote": '"', "escape": '"'}

# The event dates used when no list is given.
EVENT_DATES = """
2015-08-06 2015-09-16 2015-10-28 2015-11-10 2015-11-12 2015-11-14 2015-12-15 2015-12-19
2016-01-02 2016-01-14 2016-01-17 2016-01-28 2016-02-01 2016-02-04 2016-02-07 2016-02-09
2016-02-11 2016-02-14 2016-02-20 2016-02-23 2016-02-26 2016-02-27 2016-03-01 2016-03-04
2016-03-05 2016-03-06 2016-03-07 2016-03-08 2016-03-09 2016-03-10 2016-03-11 2016-03-12
2016-03-15 2016-03-22 2016-03-26 2016-04-01 2016-04-05 2016-04-07 2016-04-09 2016-04-14
2016-04-19 2016-04-26 2016-05-03 2016-05-07 2016-05-10 2016-05-17 2016-05-24 2016-06-04
2016-06-05 2016-06-07 2016-06-14 2016-09-26
""".split()


def event_times(
    dates: DataFrame, params: EventParams = EventParams(), dropped: Observation | None = None
) -> DataFrame:
    """``(event_date, event_ts)`` from a text column ``value``; unreadable rows are left out.

    A row begins with year, month and day, the latter two with one or two digits; what follows is
    ignored.

    The filter on the text is also what lets Spark prune day folders of stored signals: it
    does so only from a filtered side of a join. ``dropped`` reports, under the name ``unreadable``, how many rows
    are left out because they begin with no date; blank ones count too.
    """
    begin = F.regexp_extract(F.trim("value"), r"^(\d{4}-\d{1,2}-\d{1,2})(?!\d)", 1)
    looks_right = F.trim("value").rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?!\d)")
    date = F.try_to_date(begin, "yyyy-M-d")
    if dropped is not None:
        readable = F.coalesce(looks_right, F.lit(False)) & date.isNotNull()
        dates = dates.observe(dropped, F.count_if(~readable).alias("unreadable"))
    return (
        dates.where(looks_right)
        .select(date.alias("event_date"))
        .where(F.col("event_date").isNotNull())
        .withColumn("event_ts", clock.local_midnight(F.col("event_date"), params.zone))
    )


def read_event_dates(spark: SparkSession, path: str, params: EventParams = EventParams()) -> DataFrame:
    """One ``yyyy-MM-dd`` date per line."""
    return event_times(spark.read.text(path), params)


def known_event_dates(
    spark: SparkSession, dates: list[str] = EVENT_DATES, params: EventParams = EventParams()
) -> DataFrame:
    """Event times of a short list of dates held by the caller."""
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, dates))).alias("value"))
    return event_times(listed, params)


def read_calendar(spark: SparkSession, path: str, params: EventParams = EventParams()) -> DataFrame:
    """Calendar CSV with its header and doubled quotes, numbered in file order."""
    rows = spark.read.csv(path, schema=CALENDAR_SCHEMA, header=True, **CSV_FORM)
    return with_event_time(rows.withColumn("position", F.monotonically_increasing_id()), params)


def parse_calendar(lines: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """The same from a column ``line`` of single lines without header, and their ``position``."""
    schema = ", ".join(f"{f.name} string" for f in CALENDAR_SCHEMA)
    rows = lines.select("position", F.from_csv("line", schema, CSV_FORM).alias("c"))
    return with_event_time(rows.select("c.*", "position"), params)


def with_event_time(rows: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """Calendar rows under lower-case names with the time their event starts."""
    date = F.try_to_date("Date", "yyyy-MM-dd")
    return rows.select(
        date.alias("event_date"),
        clock.local_midnight(date, params.zone).alias("event_ts"),
        F.col("Type").alias("type"),
        F.col("Party").alias("party"),
        F.col("Location").alias("location"),
        F.col("Topic").alias("topic"),
        "position",
    )
