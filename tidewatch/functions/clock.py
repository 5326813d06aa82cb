"""Date and time column functions. The session zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stamp inside hourly file names, and the date form of chart matrices.
FILE_STAMP = "yyyyMMdd-HHmmss"
CHART_DATE = "'Date('yyyy,MM,dd,HH,mm,ss')'"


def local_midnight(date: Column, zone: str) -> Column:
    """UTC instant at which a calendar date begins in ``zone``, daylight saving included."""
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def file_stamp(file_name: Column) -> Column:
    """The 15 characters in front of the last ``.gz``.

    Plain substring work instead of a regular expression: this runs once per input line.
    """
    suffix = F.substring_index(file_name, ".gz", -1)
    return F.substr(file_name, F.length(file_name) - F.length(suffix) - 17, F.lit(15))


def stamp_hour(stamp: Column) -> Column:
    """Timestamp from a stamp; one that is none is an error."""
    ts = F.try_to_timestamp(stamp, F.lit(FILE_STAMP))
    return F.coalesce(ts, F.raise_error(F.concat(F.lit("no hour in file name: "), stamp)))


def file_hour(file_name: Column) -> Column:
    """Timestamp from the stamp of a file name."""
    return stamp_hour(file_stamp(file_name))


def stamped_name(ts: Column, prefix: str = "", suffix: str = ".gz") -> Column:
    """``<prefix>yyyyMMdd-HHmmss<suffix>``."""
    return F.concat(F.lit(prefix), F.date_format(ts, FILE_STAMP), F.lit(suffix))


def chart_date(ts: Column) -> Column:
    """``Date(Y,m,d,H,M,S)`` with a 1-based month."""
    return F.date_format(ts, CHART_DATE)


def hours_between(first: Column, last: Column) -> Column:
    """Inclusive array of hourly timestamps."""
    return F.sequence(first, last, F.expr("interval 1 hour"))
