"""From raw lines to counted points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.functions import clock, text

# Project prefixes and page keywords used when none are given.
LANGUAGES = ("en", "es")
KEYWORDS = ("clinton", "trump", "democrat", "republican")


# Two things keep the parsing of lines cheap. A test on the raw line comes first, so that most
# lines are dropped unsplit. And a value that is filtered on goes through a one-item
# ``explode``: Spark moves no filter below it, so the line is split once, not once more for
# the filter.


def topic_lines(raw: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Counted lines ``(topic, stamp, views)`` of the projects whose name starts with a language.

    Lines hold single-space separated ``project title views ...``. All matching projects share
    one topic, the lower-cased title. Foreign lines, and lines whose count is missing, no
    number, NaN or infinite, are dropped before any shuffle. The stamp is the text in the file name.
    """
    # The project begins the line, so its prefix is the prefix of the line.
    wanted = raw.where(text.starts_with_any(F.col("line"), languages))
    fields = wanted.select("file_name", F.split("line", " ", -1).alias("_f"))
    counted = fields.select(
        "file_name", "_f", F.explode(F.array(F.get("_f", F.lit(2)).try_cast("double"))).alias("views")
    )
    return counted.where(F.abs("views") < F.lit(float("inf"))).select(
        F.lower(F.get("_f", F.lit(1))).alias("topic"), clock.file_stamp(F.col("file_name")).alias("stamp"), "views"
    )


def topic_points(raw: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``topic_lines`` as points ``(topic, ts, views)``, for streams, which need the time of each line."""
    return topic_lines(raw, languages).select("topic", clock.stamp_hour(F.col("stamp")).alias("ts"), "views")


def keyword_lines(raw: DataFrame, keywords: Sequence[str], column: str = "line") -> DataFrame:
    """Rows whose lower-cased text contains a keyword; no keywords keep nothing."""
    return raw.where(text.contains_any(F.col(column), keywords))


def keyword_points(
    raw: DataFrame,
    keywords: Sequence[str] = KEYWORDS,
    dropped: Observation | None = None,
) -> DataFrame:
    """Points ``(title, ts, views)`` of the pages whose title contains a keyword.

    Titles keep their case and every project counts. Rows with an unreadable count are
    left out; ``dropped`` reports how many under the name ``malformed``.
    """
    fields = keyword_lines(raw, keywords).select(
        "file_name", F.split("line", " ", -1).alias("_f")
    )
    pages = (
        fields.select("file_name", "_f", F.explode(F.array(F.get("_f", F.lit(1)))).alias("title"))
        .where(text.contains_any(F.col("title"), keywords))
        .select(
            "file_name",
            "title",
            F.explode(F.array(F.get("_f", F.lit(2)).try_cast("bigint"))).alias("views"),
        )
    )
    if dropped is not None:
        pages = pages.observe(dropped, F.count_if(F.col("views").isNull()).alias("malformed"))
    return pages.where(F.col("views").isNotNull()).select(
        "title", clock.file_hour(F.col("file_name")).alias("ts"), "views"
    )
