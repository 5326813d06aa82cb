"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.clock import local_midnight
from tidewatch.operators import series
from tidewatch.params import EventParams, PeakParams, TemplateParams
from tidewatch.sources.calendar import known_event_dates, with_event_time

# Query parameters, shared with the SQL checks.
PEAKS = PeakParams(win_length=24, diff=3.0, influence=0.0)
INFLUENCED = PeakParams(win_length=24, diff=3.0, influence=0.3)
EVENTS = EventParams(views_threshold=40.0)
TEMPLATES = TemplateParams(
    series_length=24, reference_length=36, decay=0.1, alpha=0.1, smooth=2, baseline_offset=6
)
CALENDAR_DATES = (  # one of them listed twice
    "2024-01-04 2024-01-08 2024-01-08 2024-01-09 2024-01-15 2024-01-19 2024-01-23 2024-01-27".split()
)
# (date, type, party, location); the last date lies after all events.
CALENDAR_ROWS = (
    ("2024-01-04", "open primary", "democrats", "Iowa"),
    ("2024-01-04", "closed caucus", "democrats", "Guam"),
    ("2024-01-08", "closed primary", "republicans", "Ohio"),
    ("2024-01-09", "open caucus", "democrats", "Utah"),
    ("2024-01-09", "open caucus", "republicans", "Utah"),
    ("2024-01-15", "debate", "presidential", "Virginia, \"North\""),
    ("2024-01-19", "open primary", "republicans", "Texas"),
    ("2024-01-23", "debate", None, None),
    ("2024-01-23", "debate", "democrats", "Nevada"),
    ("2024-01-27", "convention", "republicans", "Maine"),
    ("2024-03-01", "convention", "democrats", "Kansas"),
)


# Schemas of the tables in use: with them given, no job has to look into the files first.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def ms(ts: Column | str) -> Column:
    return F.unix_millis(ts)


def _hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts).cast("timestamp"))


def event_series(spark: SparkSession, folder: str, topic: Column) -> DataFrame:
    """Hourly value sums of the events, added up exactly in hundredths."""
    points = table(spark, folder, "events").select(
        topic.alias("topic"), _hour().alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("views")
    )
    return series.topic_hours(points).withColumn("views", F.col("views") / 100)


def type_series(spark: SparkSession, folder: str) -> DataFrame:
    """Few long series: one topic per event type."""
    return event_series(spark, folder, F.col("event_type"))


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    """Many short series: one topic per user."""
    return event_series(spark, folder, F.concat(F.lit("user_"), F.col("user_id").cast("string")))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pageview-style lines ``language Source_n views bytes`` with unreadable counts among them."""
    hour = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(720)) * 3600)
    views = F.when(F.col("n_chars") < 200, F.lit("NaN")).otherwise(F.col("n_chars").cast("string"))
    return table(spark, folder, "documents").select(
        F.concat(F.lit("pageviews-"), F.date_format(hour, "yyyyMMdd-HHmmss"), F.lit(".gz")).alias("file_name"),
        F.concat_ws(
            " ",
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit(".m"))),
            F.concat(F.initcap("source"), F.lit("_"), F.upper("lang")),
            views,
            F.lit("0"),
        ).alias("line"),
    )


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pageview-style lines ``en Key_k views bytes`` of the events, one title per property."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("pageviews-"), F.date_format(_hour(), "yyyyMMdd-HHmmss"), F.lit(".gz")).alias("file_name"),
        F.concat_ws(
            " ",
            F.lit("en"),
            F.concat(F.initcap("event_type"), F.lit("_"), F.get_json_object("props", "$.k")),
            # Small counts stand for the unreadable ones of real files.
            F.when(F.col("value") < 2, "n/a").otherwise(F.floor("value").cast("string")),
            F.lit("0"),
        ).alias("line"),
    )


def january_events(spark: SparkSession) -> DataFrame:
    """Event times of the query calendar."""
    return known_event_dates(spark, list(CALENDAR_DATES), EVENTS)


def january_calendar(spark: SparkSession) -> DataFrame:
    rows = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(("Date", "Type", "Party", "Location"), r)]) for r in CALENDAR_ROWS]
    )
    listed = spark.range(1).select(F.posexplode(rows).alias("position", "r"))
    return with_event_time(listed.select("r.*", F.lit("").alias("Topic"), "position"), EVENTS)


def order_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """A calendar from the orders: type is the priority, party follows the status.

    Orders are first reduced to distinct calendar entries, a bounded number per date.
    """
    party = (
        F.when(F.col("o_orderstatus") == "F", "democrats")
        .when(F.col("o_orderstatus") == "O", "republicans")
        .otherwise("presidential")
    )
    rows = (
        table(spark, folder, "orders")
        .groupBy(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
            F.substring_index("o_orderpriority", "-", -1).alias("Type"),
            party.alias("Party"),
        )
        .agg(F.min("o_orderkey").alias("position"))
    )
    return with_event_time(
        rows.withColumn("Location", F.concat(F.lit("District "), F.length("Type").cast("string"))).withColumn(
            "Topic", F.lit("")
        ),
        EVENTS,
    )


def poll_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Nested poll documents from the orders: a poll per priority, a candidate per status.

    Values are sums per date, so a document has at most one entry per calendar day.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    values = (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("poll_name"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_orderstatus").alias("name"),
        )
        .agg((F.sum(cents) / F.lit(100)).alias("v"))
    )
    entries = values.groupBy("poll_name", "date").agg(
        F.sort_array(
            F.collect_list(F.struct("name", F.concat(F.col("v").cast("decimal(18,2)").cast("string"), F.lit(" pts")).alias("value")))
        ).alias("candidate")
    )
    return entries.groupBy("poll_name").agg(
        F.struct(F.collect_list(F.struct("date", "candidate")).alias("rcp_avg")).alias("poll")
    )


def poll_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event times for the polls: the first day of every month that has orders."""
    day = F.to_date("o_orderdate")
    months = table(spark, folder, "orders").select(F.trunc(day, "month").alias("d")).distinct()
    return months.select(local_midnight(F.col("d"), EVENTS.zone).alias("event_ts"))


def labelled_series(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reference series: all hours of each type, labelled by type."""
    packed = series.pack(type_series(spark, folder))
    return packed.select(
        F.col("topic").alias("ref_id"),
        F.col("topic").isin("purchase", "signup").alias("trending"),
        series.values("points").alias("values"),
    )
