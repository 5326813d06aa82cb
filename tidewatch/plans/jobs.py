"""Whole jobs: from files to files. Each is a function; ``python -m tidewatch`` calls them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.operators import cleaning, events, peaks, polls, report, series, templates, topk
from tidewatch.params import EventParams, PeakParams, TemplateParams
from tidewatch.plans.staging import staged
from tidewatch.sinks import files
from tidewatch.sources import calendar, pageviews, references, signals
from tidewatch.sources import polls as poll_source


def topic_series(
    spark: SparkSession,
    source: str | list[str],
    languages: Sequence[str] = cleaning.LANGUAGES,
    keywords: Sequence[str] | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Hourly series of all topics in hourly count files, optionally of matching lines only."""
    raw = pageviews.read_lines(spark, source, skip_corrupt)
    if keywords is not None:
        raw = cleaning.keyword_lines(raw, keywords)
    return series.stamped_hours(cleaning.topic_lines(raw, languages))


def detect_trends(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    params: PeakParams = PeakParams(),
    keywords: Sequence[str] | None = None,
    densify: bool = False,
    as_text: bool = False,
    peaking_only: bool = False,
) -> None:
    """Hourly count files to peak signals: parquet by day, or gzip text records.

    ``peaking_only`` leaves out the topics that never peak, the great majority: enough where
    the signals serve to find spikes, and the search for them then has far less to read.
    """
    found = topic_series(spark, source, keywords=keywords)
    if as_text:
        files.write_signal_text(peaks.packed_peaks(found, params, densify), target)
    else:
        files.write_signals(peaks.detect_peaks(found, params, peaking_only, densify), target)


def score_trends(
    spark: SparkSession,
    source: str | list[str],
    library: str,
    target: str,
    params: TemplateParams = TemplateParams(),
) -> None:
    """Hourly count files to similarity scores against a stored reference library."""
    found = topic_series(spark, source)
    known = references.read_references(spark, library)
    files.write_signals(templates.template_scores(found, known, params), target)


def extract_spikes(
    spark: SparkSession,
    source: str,
    target: str,
    params: EventParams = EventParams(),
    dates: str | None = None,
    from_text: bool = False,
    single_file: bool = False,
) -> None:
    """Peak signals to spike JSON lines around the event dates."""
    found = signals.read_signal_text(spark, source) if from_text else signals.read_signals(spark, source)
    known = (
        calendar.read_event_dates(spark, dates, params)
        if dates
        else calendar.known_event_dates(spark, params=params)
    )
    files.write_spikes(events.find_spikes(found, known, params, events.salts_for(known)), target, single_file)


def event_report(
    spark: SparkSession,
    spikes: str,
    calendar_file: str,
    target: str,
    poll_files: dict[str, str] | None = None,
    params: EventParams = EventParams(),
    poll_date_format: str = "yyyy-MM-dd",
) -> None:
    """Report tables: ``event_bubbles``, ``event_top_topics`` and the two poll tables."""
    summary = staged(report.summarise_spikes(signals.read_spikes(spark, spikes)), "spikes")
    dates = calendar.read_calendar(spark, calendar_file, params)
    out = target.rstrip("/")
    report.event_bubbles(dates, summary).write.mode("overwrite").parquet(f"{out}/event_bubbles")
    report.rank_spikes(report.top_spikes(summary)).write.mode("overwrite").parquet(
        f"{out}/event_top_topics"
    )
    if poll_files:
        entries = poll_source.read_polls(spark, poll_files, params, poll_date_format)
        near = staged(polls.poll_neighbourhood(entries, dates), "poll-neighbourhood")
        polls.candidate_series(near).write.mode("overwrite").parquet(f"{out}/event_polls")
        polls.entry_midpoints(near).write.mode("overwrite").parquet(f"{out}/event_poll_midpoints")


def page_matrix(
    spark: SparkSession,
    folder: str,
    first: datetime,
    last: datetime,
    target: str,
    keywords: Sequence[str] = cleaning.KEYWORDS,
    suffix: str = "",
) -> None:
    """Hour x page table of the most viewed matching pages, as space-separated text.

    The files are read once: later passes use the sums per page and hour.
    """
    raw = pageviews.read_hour_range(spark, folder, first, last, suffix)
    hours = staged(series.page_hours(cleaning.keyword_points(raw, keywords)), "page-hours")
    span = spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last"))
    spine = span.select(F.explode(clock.hours_between(F.col("first"), F.col("last"))).alias("ts"))
    pages = topk.page_names(hours)
    files.write_matrix(topk.page_matrix(hours, len(pages), spine), pages, target)


def topic_chart(spark: SparkSession, source: str, topic: str, target: str) -> None:
    """One topic's signals as a chart CSV."""
    files.write_topic_chart(signals.read_signals(spark, source), topic, target)


def download_list(
    spark: SparkSession, year: int, first_month: int, last_month: int, target: str
) -> None:
    """URLs and names of the hourly files of whole months."""
    listed = pageviews.month_manifest(spark, year, first_month, last_month)
    pageviews.spread(listed.select("url", "file_name")).write.csv(target, header=True)
