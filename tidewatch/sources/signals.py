"""Stored signals and spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the five day buckets, first to last.
BUCKET_NAMES = ("two_days_before", "one_day_before", "on_the_day", "one_day_after", "two_days_after")

SPIKE_SCHEMA = T.StructType(
    [T.StructField("topic", T.StringType()), T.StructField("event_timestamp", T.LongType())]
    + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in BUCKET_NAMES]
)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Parquet signals ``(topic, ts, views, signal)`` with their folder column ``day``."""
    return spark.read.parquet(path).select("topic", "ts", "views", "signal", "day")


def parse_signal_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """Long-form signals from text records ``(topic,[(ms,views,signal), ...])``.

    Numbers keep their exponents and topics their commas. Records without a point disappear.
    """
    text = F.col(line)
    # The list starts at the last ",[": numbers hold none, topics may.
    split = lines.select(text.alias("_t"), F.substring_index(text, ",[", -1).alias("_series"))
    topic = F.substr("_t", F.lit(2), F.length("_t") - F.length("_series") - 3)
    triples = F.regexp_extract_all("_series", F.lit(r"\(([^()]+)\)"), 1)
    fields = split.select(topic.alias("topic"), F.explode(triples).alias("_p")).select(
        "topic", F.split("_p", ",").alias("_f")
    )
    return fields.where(F.size("_f") == 3).select(
        "topic",
        F.timestamp_millis(F.get("_f", F.lit(0)).try_cast("bigint")).alias("ts"),
        F.get("_f", F.lit(1)).try_cast("double").alias("views"),
        F.get("_f", F.lit(2)).try_cast("double").alias("signal"),
    ).where(F.col("ts").isNotNull() & F.col("views").isNotNull() & F.col("signal").isNotNull())


def read_signal_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_signal_text(spark.read.text(path))


def parse_spikes(documents: DataFrame, document: str = "value") -> DataFrame:
    """Spikes from one JSON document per row."""
    parsed = documents.select(F.from_json(document, SPIKE_SCHEMA).alias("s")).select("s.*")
    return with_event_time(parsed)


def read_spikes(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """Spike JSON, one object per line, or with ``whole_array`` one array per file."""
    return with_event_time(spark.read.json(path, schema=SPIKE_SCHEMA, multiLine=whole_array))


def with_event_time(spikes: DataFrame) -> DataFrame:
    return spikes.select(
        "topic", F.timestamp_millis("event_timestamp").alias("event_ts"), *BUCKET_NAMES
    )
