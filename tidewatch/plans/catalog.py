"""Registered queries: every operator over the driver's tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text, vectors
from tidewatch.operators import (
    cleaning,
    events,
    peaks,
    polls,
    report,
    rolling,
    series,
    templates,
    topk,
)
from tidewatch.params import PeakParams
from tidewatch.plans import inputs
from tidewatch.plans.inputs import ms, table
from tidewatch.plans.staging import staged
from tidewatch.session import shared_folder
from tidewatch.sinks import files
from tidewatch.sources import calendar, pageviews, references, signals
from tidewatch.sources import polls as poll_source
from tidewatch.sources.signals import BUCKET_NAMES
from tidewatch.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WIDTH = 24
PAGE_KEYWORDS = ("click_1", "view", "purchase_9")
TEXT_KEYWORDS = ("password", "copyright", "the and", "email")
MANY_KEYWORDS = tuple(f"{a}{b}{a}{b}" for a in "aeiou" for b in "bcdfghjklmnprstv")
CROWDED, SHOWN = 20, 5
LIVE_FILES = 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rows(frame: DataFrame, *columns: str | Column) -> DataFrame:
    """Topic and hour in milliseconds, then the given columns."""
    return frame.select("topic", ms("ts").alias("ts_ms"), *columns)


def _r(column: str | Column, digits: int = 6) -> Column:
    name = column if isinstance(column, str) else None
    rounded = F.round(column, digits)
    return rounded.alias(name) if name else rounded


def _listed(array: Column | str) -> Column:
    """An array of views as text with two decimals."""
    return F.array_join(
        F.transform(array, lambda v: v.cast("decimal(18,2)").cast("string")), ","
    )


# Sources, cleaning, sums -------------------------------------------------------------------


@query
def topic_hourly_views(spark, folder):
    return _rows(inputs.type_series(spark, folder), "views")


@query
def pageview_line_parse(spark, folder):
    lines = cleaning.topic_lines(inputs.document_lines(spark, folder))
    return _rows(series.stamped_hours(lines), "views")


@query
def keyword_lines(spark, folder):
    found = cleaning.keyword_lines(table(spark, folder, "documents"), TEXT_KEYWORDS, "text")
    return found.select("doc_id", "lang", "source")


@query
def keyword_lines_many(spark, folder):
    found = cleaning.keyword_lines(table(spark, folder, "documents"), MANY_KEYWORDS, "text")
    return found.select("doc_id", "lang", "source")


@query
def keyword_page_hours(spark, folder):
    return _page_hours(spark, folder).select("title", ms("ts").alias("ts_ms"), "views")


@query
def page_totals(spark, folder):
    return series.page_totals(_page_hours(spark, folder))


@query
def url_file_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.file_name_of_url(F.col("url")).alias("file_name")
    )


@query
def hourly_manifest(spark, folder):
    times = table(spark, folder, "events").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    )
    found = pageviews.manifest(series.hour_spine(times), "https://dumps.example.org/other")
    return pageviews.spread(found).select(ms("ts").alias("ts_ms"), "url", "file_name")


@query
def densified_series(spark, folder):
    return _rows(series.densify(inputs.user_series(spark, folder)), "views")


@query
def packed_series(spark, folder):
    packed = series.pack(inputs.user_series(spark, folder))
    return packed.select(
        "topic", F.size("points").alias("hours"), _listed(series.values("points")).alias("views")
    )


# Rolling statistics ------------------------------------------------------------------------


@query
def moving_mean(spark, folder):
    return _rows(rolling.moving_mean(inputs.type_series(spark, folder), WIDTH), _r("moving_mean"))


@query
def moving_std(spark, folder):
    return _rows(rolling.moving_std(inputs.type_series(spark, folder), WIDTH), _r("moving_std"))


@query
def trailing_mean(spark, folder):
    return _rows(rolling.trailing_mean(inputs.user_series(spark, folder), 3), _r("smoothed"))


@query
def spike_change(spark, folder):
    return _rows(rolling.spike_normalised(inputs.user_series(spark, folder), 0.1), _r("change"))


@query
def trailing_windows(spark, folder):
    rows = rolling.trailing_windows(inputs.user_series(spark, folder), 5)
    return _rows(rows, _listed("buffer").alias("buffer"), _r("running_total", 2))


# Peak signal -------------------------------------------------------------------------------


@query
def peak_signal(spark, folder):
    return _rows(peaks.detect_peaks(inputs.type_series(spark, folder), inputs.PEAKS), "views", "signal")


@query
def peak_signal_defaults(spark, folder):
    return _rows(peaks.detect_peaks(inputs.type_series(spark, folder), PeakParams()), "views", "signal")


@query
def peak_signal_influence(spark, folder):
    return _rows(
        peaks.detect_peaks(inputs.type_series(spark, folder), inputs.INFLUENCED), "views", "signal"
    )


@query
def peak_signal_users(spark, folder):
    return _rows(peaks.detect_peaks(inputs.user_series(spark, folder), inputs.PEAKS), "views", "signal")


@query
def peak_signal_dense(spark, folder):
    """The signal of users whose absent hours count as hours without views."""
    found = peaks.detect_peaks(inputs.user_series(spark, folder), inputs.PEAKS, densify=True)
    return _rows(found, "views", "signal")


@query
def signal_text_roundtrip(spark, folder):
    packed = peaks.packed_peaks(inputs.user_series(spark, folder), inputs.PEAKS)
    return _rows(signals.parse_signal_text(files.signal_text(packed)), "views", "signal")


@query
def topic_chart(spark, folder):
    found = peaks.detect_peaks(inputs.type_series(spark, folder), inputs.PEAKS)
    chart = files.topic_chart(found, "view")
    return chart.select("id", "views", "signal", ms("time").alias("time_ms"))


def _event_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("decimal(18,2)").alias("views"),
    )


def _live(spark, folder, name, signal):
    """A signal from a stream of the events, a few files at a time, brought to its end.

    The files of a table are in no order of time, so hours stay open for as long as the table is.
    """
    # The streaming reader takes folders and patterns; as a pattern, the table may be one file too.
    files = spark.readStream.schema(inputs.SCHEMAS["events"]).option("maxFilesPerTrigger", LIVE_FILES)
    points = _event_points(files.parquet(f"{folder}/events.parque[t]"))
    delay = live.whole_length(_event_points(table(spark, folder, "events")))
    return live.update_signals(points, shared_folder(spark, name), signal, delay, last=True)


@query
def live_peak_signal(spark, folder):
    found = _live(spark, folder, "live-peaks", lambda hours: live.live_peaks(hours, inputs.PEAKS))
    return _rows(found, "views", "signal")


@query
def live_template_scores(spark, folder):
    library = _library(spark, folder)
    found = _live(spark, folder, "live-scores", lambda hours: live.live_scores(hours, library, inputs.TEMPLATES))
    return _rows(found, "views", _r("signal", 5))


# Events ------------------------------------------------------------------------------------


def _user_signals(spark, folder, peaking_only=False):
    return peaks.detect_peaks(inputs.user_series(spark, folder), inputs.PEAKS, peaking_only)


def _user_spikes(spark, folder):
    return events.find_spikes(
        _user_signals(spark, folder, peaking_only=True), inputs.january_events(spark), inputs.EVENTS
    )


@query
def event_start_times(spark, folder):
    dates = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")
    )
    return calendar.event_times(dates.distinct(), inputs.EVENTS).select(
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), ms("event_ts").alias("event_ms")
    )


@query
def event_window_points(spark, folder):
    found = peaks.detect_peaks(inputs.type_series(spark, folder), inputs.PEAKS)
    points = events.window_points(found, inputs.january_events(spark), inputs.EVENTS)
    return _rows(points, ms("event_ts").alias("event_ms"), "bucket", "views", "signal")


@query
def event_window_points_dealt(spark, folder):
    """The same join as for a calendar above the broadcast size, with the topics of a day dealt to parts."""
    points = events.window_points(_user_signals(spark, folder), inputs.january_events(spark), inputs.EVENTS, events.SALTS)
    return _rows(points, ms("event_ts").alias("event_ms"), "bucket", "views", "signal")


@query
def event_window_buckets(spark, folder):
    windows = events.event_windows(
        events.window_points(_user_signals(spark, folder), inputs.january_events(spark), inputs.EVENTS)
    )
    return windows.select(
        "topic",
        ms("event_ts").alias("event_ms"),
        *[_listed(b).alias(b) for b in BUCKET_NAMES],
        _r("total_views", 2),
        "points",
        "has_peak",
    )


@query
def event_spikes(spark, folder):
    spikes = _user_spikes(spark, folder)
    return spikes.select(
        "topic",
        ms("event_ts").alias("event_ms"),
        *[_listed(b).alias(b) for b in BUCKET_NAMES],
        _r("total_views", 2),
    )


@query
def spike_json_roundtrip(spark, folder):
    spikes = signals.parse_spikes(files.spike_json(_user_spikes(spark, folder)))
    return spikes.select(
        "topic", ms("event_ts").alias("event_ms"), *[_listed(b).alias(b) for b in BUCKET_NAMES]
    )


# Report ------------------------------------------------------------------------------------


def _summary(spark, folder):
    return report.summarise_spikes(_user_spikes(spark, folder))


@query
def spikes_ranked(spark, folder):
    ranked = report.rank_spikes(_summary(spark, folder))
    return ranked.select(
        "topic",
        ms("event_ts").alias("event_ms"),
        _listed("views").alias("views"),
        _r("total_views", 2),
        F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"),
    )


@query
def spikes_capped(spark, folder):
    top = report.top_spikes(_summary(spark, folder), CROWDED, SHOWN)
    return top.select("topic", ms("event_ts").alias("event_ms"), _r("total_views", 2), "rank")


@query
def event_totals(spark, folder):
    totals = report.event_totals(_summary(spark, folder))
    return totals.select(ms("event_ts").alias("event_ms"), "spikes", _r("views", 2))


@query
def event_bubbles(spark, folder):
    bubbles = report.event_bubbles(inputs.january_calendar(spark), _summary(spark, folder))
    return bubbles.select(
        ms("event_ts").alias("event_ms"),
        "spikes",
        _r("views", 2),
        _r("y"),
        _r("z"),
        "tooltip",
        "party_class",
    )


@query
def calendar_dates(spark, folder):
    dates = report.calendar_dates(inputs.order_calendar(spark, folder))
    return dates.select(
        ms("event_ts").alias("event_ms"),
        "tooltip",
        F.array_join("parties", ",").alias("parties"),
        "party_class",
    )


@query
def calendar_csv_parse(spark, folder):
    """Calendar lines with quoted commas and doubled quotes, parsed by the CSV reader's rules."""
    place = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    quoted = F.concat(F.lit('"'), F.replace(place, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"),
        F.concat(F.lit("2016-03-01,open primary,democrats,"), quoted, F.lit(",")).alias("line"),
    )
    return calendar.parse_calendar(lines, inputs.EVENTS).select(
        F.col("position").alias("c_custkey"), F.date_format("event_date", "yyyy-MM-dd").alias("date"), "party", "location"
    )


@query
def title_prettify(spark, folder):
    named = table(spark, folder, "part").select(
        "p_partkey", F.concat_ws("_", F.translate("p_name", " ", "_"), F.lower("p_type"), F.lit("o'reilly-x_été")).alias("t")
    )
    return named.select("p_partkey", text.prettify_title(F.col("t")).alias("title"))


# Top pages ---------------------------------------------------------------------------------


def _page_points(spark, folder):
    return cleaning.keyword_points(inputs.page_lines(spark, folder), PAGE_KEYWORDS)


def _page_hours(spark, folder):
    return series.page_hours(_page_points(spark, folder))


@query
def top_pages(spark, folder):
    """Totals straight from the points: no sums per hour on the way."""
    return topk.top_pages(_page_points(spark, folder))


def _matrix(spark, folder):
    """The lines are read once; spine, ranks and cells are worked out from the sums."""
    return topk.page_matrix(staged(_page_hours(spark, folder), "page-hours"))


@query
def page_matrix(spark, folder):
    """Always ``TOP_PAGES`` columns, so that the schema does not depend on the data."""
    matrix = _matrix(spark, folder)
    return matrix.select(ms("ts").alias("ts_ms"), *matrix.columns[1:])


@query
def page_matrix_text(spark, folder):
    """The text rows of the matrix sink."""
    return files.matrix_text(_matrix(spark, folder)).select(F.col("value").alias("row"))


# Reference series and scores ---------------------------------------------------------------


def _vector(name: str, change: Callable[[Column], Column]) -> None:
    """Register an array function, applied to the series of each user, one row per item."""

    def run(spark, folder):
        packed = series.pack(inputs.user_series(spark, folder))
        changed = packed.select("topic", F.posexplode(change(series.values("points"))).alias("i", "value"))
        return changed.select("topic", "i", _r("value"))

    run.__name__ = name
    query(run)


_vector("vector_add_one", vectors.add_one)
_vector("vector_unit_normalise", lambda x: vectors.unit_normalise(x, inputs.TEMPLATES))
_vector("vector_log_scale", vectors.log_scale)
_vector("vector_smooth", lambda x: vectors.smooth(x, 4))
_vector("vector_spike_normalise", lambda x: vectors.spike_normalise(x, 0.1))
_vector("vector_keep_last", lambda x: vectors.keep_last(x, 10))
_vector("vector_transform", lambda x: vectors.transform_series(x, inputs.TEMPLATES))


@query
def reference_library(spark, folder):
    library = references.prepare_references(inputs.labelled_series(spark, folder), inputs.TEMPLATES)
    return library.select("ref_id", "trending", F.posexplode("series").alias("i", "value")).select(
        "ref_id", "trending", "i", _r("value")
    )


@query
def slice_distance(spark, folder):
    """Distance of each user's last 8 hours to the 8 before, and the weight of the nearest slice of all hours
    before; a user with fewer hours has no distance and weight 0."""
    packed = series.pack(inputs.user_series(spark, folder))
    x = packed.select("topic", series.values("points").alias("x"))
    before = F.slice("x", 1, F.greatest(F.size("x") - 8, F.lit(0)))
    x = x.withColumn("before", before).withColumn("last", vectors.keep_last(F.col("x"), 8))
    params = inputs.TemplateParams(series_length=8, reference_length=8, decay=0.001)
    enough = F.size("before") >= 8
    return x.select(
        "topic",
        _r(F.when(enough, vectors.l1_distance(vectors.keep_last(F.col("before"), 8), F.col("last"))), 4).alias("distance"),
        _r(templates.slice_weight(F.col("before"), F.col("last"), params)).alias("weight"),
    )


def _library(spark, folder):
    return references.prepare_references(inputs.labelled_series(spark, folder), inputs.TEMPLATES)


@query
def template_weights(spark, folder):
    weights = templates.template_weights(
        inputs.type_series(spark, folder), _library(spark, folder), inputs.TEMPLATES
    )
    return _rows(weights, _r("trend_weight"), _r("other_weight"))


@query
def template_scores(spark, folder):
    scores = templates.template_scores(
        inputs.type_series(spark, folder), _library(spark, folder), inputs.TEMPLATES
    )
    return _rows(scores, "views", _r("signal", 5))


# Polls -------------------------------------------------------------------------------------


def _entries(spark, folder):
    documents = inputs.poll_documents(spark, folder)
    packed = documents.select("poll_name", F.to_json(F.struct("poll")).alias("json"))
    read_back = packed.select(
        "poll_name", F.from_json("json", poll_source.POLL_SCHEMA).alias("d")
    ).select("poll_name", "d.poll")
    return poll_source.poll_entries(read_back, inputs.EVENTS)


@query
def poll_entries(spark, folder):
    entries = _entries(spark, folder).select("poll", "entry_ts", F.explode("candidate").alias("c"))
    return entries.select(
        "poll", ms("entry_ts").alias("entry_ms"), "c.name", "c.value"
    )


def _neighbourhood(spark, folder):
    return polls.poll_neighbourhood(_entries(spark, folder), inputs.poll_events(spark, folder))


@query
def poll_neighbourhood(spark, folder):
    return _neighbourhood(spark, folder).select(
        "poll", ms("event_ts").alias("event_ms"), "entry_no", ms("entry_ts").alias("entry_ms")
    )


@query
def poll_midpoints(spark, folder):
    return polls.entry_midpoints(_neighbourhood(spark, folder)).select(
        "poll", ms("event_ts").alias("event_ms"), "midpoint_ms"
    )


@query
def poll_candidates(spark, folder):
    found = polls.candidate_series(_neighbourhood(spark, folder))
    point = lambda p: F.concat_ws(
        "=", ms(p["entry_ts"]).cast("string"), p["value"].cast("decimal(18,2)").cast("string")
    )
    return found.select(
        "poll",
        ms("event_ts").alias("event_ms"),
        "name",
        F.array_join(F.transform("points", point), ",").alias("points"),
    )
