"""Hourly count files: one text file per hour, lines of ``project title views bytes``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import clock, text

# Where the public hourly dumps live, and how their files are named.
DUMP_ROOT = "https://dumps.wikimedia.org/other/pageviews"
FILE_PREFIX = "pageviews-"


def read_lines(spark: SparkSession, path: str | list[str], skip_corrupt: bool = False) -> DataFrame:
    """Lines paired with the base name of their file: ``(file_name, line)``.

    gzip files cannot be split, so each hour is one task; decompression, parsing and the
    map-side sum all happen in that task. ``skip_corrupt`` ends a damaged file at the damage.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return reader.text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line")
    )


def hour_paths(folder: str, first: datetime, last: datetime, suffix: str = "") -> list[str]:
    """Paths of the hourly files of an inclusive range, a missing one being a read error."""
    hours = int((last - first) / timedelta(hours=1))
    stamps = (first + timedelta(hours=h) for h in range(hours + 1))
    return [f"{folder.rstrip('/')}/{FILE_PREFIX}{s:%Y%m%d-%H%M%S}{suffix}" for s in stamps]


def read_hour_range(
    spark: SparkSession, folder: str, first: datetime, last: datetime, suffix: str = ""
) -> DataFrame:
    """Lines of the hourly files from ``first`` to ``last``, both included.

    The file names are shown with ``.gz`` at the end, packed or not.
    """
    lines = read_lines(spark, hour_paths(folder, first, last, suffix))
    return lines.withColumn(
        "file_name",
        F.when(F.endswith("file_name", F.lit(".gz")), F.col("file_name")).otherwise(
            F.concat("file_name", F.lit(".gz"))
        ),
    )


def dump_url(ts: Column, root: str = DUMP_ROOT) -> Column:
    """URL of the packed file of one hour."""
    folder = F.date_format(ts, "/yyyy/yyyy-MM/")
    return F.concat(F.lit(root), folder, clock.stamped_name(ts, FILE_PREFIX))


def manifest(hours: DataFrame, root: str = DUMP_ROOT) -> DataFrame:
    """One row per hour of ``hours(ts)``: ``(ts, url, file_name)``."""
    return hours.select("ts", dump_url(F.col("ts"), root).alias("url")).withColumn(
        "file_name", text.file_name_of_url(F.col("url"))
    )


def month_manifest(
    spark: SparkSession, year: int, first_month: int, last_month: int, root: str = DUMP_ROOT
) -> DataFrame:
    """Manifest of whole calendar months, leap days included."""
    start = F.make_date(F.lit(year), F.lit(first_month), F.lit(1))
    end = F.add_months(start, last_month - first_month + 1)
    days = spark.range(1).select(F.explode(F.sequence(start, F.date_sub(end, 1))).alias("day"))
    hours = days.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(23)),
                lambda h: F.col("day").cast("timestamp") + F.make_dt_interval(hours=h),
            )
        ).alias("ts")
    )
    return manifest(hours, root)


def spread(frame: DataFrame, partitions: int = 3) -> DataFrame:
    """Distribute a small driver-made frame over a number of tasks."""
    return frame.repartition(partitions)
