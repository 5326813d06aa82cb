"""SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from tidewatch.plans import inputs
from tidewatch.plans.catalog import CROWDED, MANY_KEYWORDS, PAGE_KEYWORDS, SHOWN, TEXT_KEYWORDS, WIDTH
from tidewatch.params import PeakParams
from tidewatch.sources.signals import BUCKET_NAMES

ZONE = inputs.EVENTS.zone
T = inputs.TEMPLATES

# Building blocks: common table expressions and scalar forms --------------------------------


def ms(ts: str) -> str:
    return f"epoch_ms({ts})"


def listed(array: str) -> str:
    """Array of views as text with two decimals."""
    texts = f"list_transform({array}, lambda v: CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR))"
    return f"COALESCE(array_to_string({texts}, ','), '')"


def total(array: str) -> str:
    return f"COALESCE(list_sum({array}), 0.0)"


def hours(topic: str) -> str:
    return f"""hours AS (
      SELECT {topic} AS topic, date_trunc('hour', ts) AS ts,
             CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS views
      FROM events GROUP BY ALL)"""


TYPES = hours("event_type")
USERS = hours("'user_' || CAST(user_id AS VARCHAR)")


def signals(p: PeakParams = inputs.PEAKS) -> str:
    """The fold as a recursive query, after ``hours``."""
    k, d, f = p.win_length, p.diff, p.influence
    peak = f"n.views > f.mean + {d} * f.std"
    return f"""numbered AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY ts) AS rn,
             COUNT(*) OVER (PARTITION BY topic) AS cnt FROM hours),
    base AS (
      SELECT topic, AVG(views) AS mean, SQRT(VAR_SAMP(views) / ({k} - 1)) AS std
      FROM numbered WHERE cnt > {k} AND rn BETWEEN 2 AND {k} + 1 GROUP BY topic),
    fold AS (
      SELECT topic, CAST({k} AS BIGINT) AS rn, mean, std, 0.0::DOUBLE AS signal FROM base
      UNION ALL
      SELECT f.topic, n.rn,
             CASE WHEN {peak} THEN f.mean + {f} * n.views / (1 + {f}) ELSE (f.mean + n.views) / 2 END,
             CASE WHEN {peak} THEN f.std + {f} * ABS(n.views - f.mean) / (1 + {f})
                  ELSE (f.std + ABS(n.views - f.mean)) / 2 END,
             CASE WHEN {peak} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      FROM fold f JOIN numbered n ON n.topic = f.topic AND n.rn = f.rn + 1),
    signals AS (
      SELECT n.topic, n.ts, n.views, COALESCE(f.signal, 0.0) AS signal
      FROM numbered n LEFT JOIN fold f ON f.topic = n.topic AND f.rn = n.rn
      WHERE n.cnt > {k})"""


def midnight(date: str) -> str:
    return f"timezone('UTC', timezone('{ZONE}', CAST({date} AS TIMESTAMP)))"


EVENTS = "event_list AS (SELECT DISTINCT {} AS event_ts FROM (VALUES {}) AS v(d))".format(
    midnight("CAST(d AS DATE)"), ", ".join(f"('{d}')" for d in inputs.CALENDAR_DATES)
)
POINTS = """points AS (
      SELECT s.*, e.event_ts, b.bucket FROM signals s, event_list e,
        (VALUES (0, -48, -24), (1, -24, 0), (2, 0, 24), (3, 24, 48), (4, 48, 72)) AS b(bucket, lo, hi)
      WHERE s.ts BETWEEN e.event_ts + to_hours(b.lo) AND e.event_ts + to_hours(b.hi))"""
WINDOWS = """windows AS (
      SELECT topic, event_ts, {}, SUM(views) AS total_views, COUNT(*) AS points,
             BOOL_OR(signal > 0) AS has_peak
      FROM points GROUP BY topic, event_ts)""".format(
    ", ".join(
        f"COALESCE(LIST(views ORDER BY ts) FILTER (bucket = {i}), []) AS {name}"
        for i, name in enumerate(BUCKET_NAMES)
    )
)
SPIKES = f"""spikes AS (
      SELECT * FROM windows WHERE has_peak AND total_views / points >= {inputs.EVENTS.views_threshold})"""


def pretty(title: str) -> str:
    runs = f"regexp_extract_all(replace({title}, '_', ' '), '(\\w+|\\W+)', 1)"
    word = "CASE WHEN regexp_matches(r, '^\\w') THEN upper(r[1]) || substr(r, 2) ELSE r END"
    return f"array_to_string(list_transform({runs}, lambda r: {word}), '')"


ALL_BUCKETS = " || ".join(BUCKET_NAMES)
SUMMARY = f"""summary AS (
      SELECT {pretty("topic")} AS topic, event_ts, {ALL_BUCKETS} AS views,
             ROUND(list_sum({ALL_BUCKETS}), 2) AS total_views,
             concat_ws(',', {", ".join(" + ".join(f"len({b})" for b in BUCKET_NAMES[: i + 1]) for i in range(4))}) AS offsets
      FROM spikes)"""
USER_SPIKES = ", ".join([USERS, signals(), EVENTS, POINTS, WINDOWS, SPIKES])
TOTALS = """totals AS (
      SELECT event_ts, COUNT(*) AS spikes, SUM(total_views) AS views FROM summary GROUP BY event_ts)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def any_keyword(column: str, keywords) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{k}')" for k in keywords) + ")"


# page_lines: titles and whole counts
PAGE_HOURS = f"""page_hours AS (
      SELECT title, ts, CAST(SUM(views) AS BIGINT) AS views FROM (
        SELECT upper(event_type[1]) || event_type[2:] || '_' || json_extract_string(props, '$.k') AS title,
               date_trunc('hour', ts) AS ts, CAST(FLOOR(value) AS BIGINT) AS views FROM events WHERE value >= 2)
      WHERE {any_keyword("title", PAGE_KEYWORDS)} GROUP BY ALL)"""
TOP = """top AS (
      SELECT title, CAST(SUM(views) AS BIGINT) AS total FROM page_hours
      GROUP BY title ORDER BY total DESC, title LIMIT 20),
    top_ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total DESC, title) AS rk FROM top)"""
SPINE = """spine AS (
      SELECT UNNEST(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS ts FROM {})"""

PACKED = "packed AS (SELECT topic, LIST(views ORDER BY ts) AS x FROM {} GROUP BY topic)"


def level(x: str, n: str) -> str:
    """Baseline level of a list ``x`` of length ``n``."""
    end = f"GREATEST({n} - {T.baseline_offset}, 0)"
    start = f"GREATEST({n} - {T.baseline_offset} - {T.reference_length}, 0)"
    value = f"{total(f'list_slice({x}, {start} + 1, {end})')} / {T.reference_length}"
    return f"CASE WHEN {value} = 0 THEN 0.00001 ELSE {value} END"


def log10(v: str) -> str:
    return f"LOG10(CASE WHEN {v} <= 0 THEN 0.00001 ELSE {v} END)"


def smoothed(x: str, width: int) -> str:
    """Trailing mean of a list, item by item."""
    part = f"list_slice({x}, GREATEST(i - {width} + 1, 1), i)"
    return f"list_transform(range(1, len({x}) + 1), lambda i: list_avg({part}))"


def chain(name: str, source: str, keep: str) -> str:
    """CTEs that take ``source(<keep>, x)`` through add one, unit level, log and smoothing."""
    return f"""{name}_1 AS (SELECT {keep}, list_transform(x, lambda v: v + 1) AS x FROM {source}),
    {name}_2 AS (SELECT {keep}, x, {level("x", "len(x)")} AS lv FROM {name}_1),
    {name}_3 AS (SELECT {keep}, list_transform(x, lambda v: {log10("(v / lv)")}) AS x FROM {name}_2),
    {name} AS (SELECT {keep}, {smoothed("x", T.smooth)} AS x FROM {name}_3)"""


LABELLED = """labelled AS (
      SELECT topic AS ref_id, topic IN ('purchase', 'signup') AS trending, x FROM packed)"""
LIBRARY = ", ".join(
    [
        PACKED.format("hours"),
        LABELLED,
        chain("refs", "labelled", "ref_id, trending"),
        f"""library AS (
      SELECT ref_id, trending, x[GREATEST(len(x) - {T.reference_length} + 1, 1):] AS x FROM refs)""",
    ]
)
_SLICES = f"range(1, len(r.x) - {T.series_length} + 2)"
_PART = f"list_slice(r.x, s, s + {T.series_length} - 1)"
_DISTANCE = f"list_sum(list_transform(list_zip({_PART}, t.x), lambda p: ABS(p[1] - p[2])))"
WEIGHTS = f"""buffers AS (
      SELECT topic, ts, views, LIST(views) OVER w AS x,
             SUM(views) OVER (PARTITION BY topic ORDER BY ts) AS running
      FROM hours WINDOW w AS (PARTITION BY topic ORDER BY ts
                              ROWS BETWEEN {T.reference_length - 1} PRECEDING AND CURRENT ROW)),
    ready AS (SELECT topic, ts, x FROM buffers WHERE len(x) = {T.reference_length} AND running <> 0),
    {chain("prepared", "ready", "topic, ts")},
    tests AS (SELECT topic, ts, x[len(x) - {T.series_length} + 1:] AS x FROM prepared),
    pairs AS (
      SELECT t.topic, t.ts, r.trending,
             EXP(-{T.decay} * list_min(list_transform({_SLICES}, lambda s: {_DISTANCE}))) AS w
      FROM tests t, library r),
    weights AS (
      SELECT b.topic, b.ts, b.views, COALESCE(SUM(w) FILTER (trending), 0.0) AS tw,
             COALESCE(SUM(w) FILTER (NOT trending), 0.0) AS ow
      FROM buffers b LEFT JOIN pairs p ON p.topic = b.topic AND p.ts = b.ts GROUP BY ALL)"""

CALENDAR = """entries AS (
      SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, split_part(o_orderpriority, '-', 2) AS type,
             CASE o_orderstatus WHEN 'F' THEN 'democrats' WHEN 'O' THEN 'republicans'
                                ELSE 'presidential' END AS party,
             MIN(o_orderkey) AS position
      FROM orders GROUP BY ALL)"""
POLLS = f"""values_ AS (
      SELECT o_orderpriority AS poll, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS name,
             CAST(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DECIMAL(28,2)) / 100 AS DECIMAL(18,2)) AS v
      FROM orders GROUP BY ALL),
    entry_days AS (SELECT DISTINCT poll, d FROM values_),
    entries AS (
      SELECT poll, d, {midnight("d")} AS entry_ts,
             ROW_NUMBER() OVER (PARTITION BY poll ORDER BY d) AS entry_no FROM entry_days),
    firsts AS (SELECT DISTINCT {midnight("date_trunc('month', o_orderdate)")} AS event_ts FROM orders),
    near AS (
      SELECT e.poll, f.event_ts, n.entry_no, n.entry_ts, n.d
      FROM entries e JOIN firsts f ON f.event_ts = e.entry_ts
      JOIN entries n ON n.poll = e.poll AND n.entry_no BETWEEN e.entry_no - 2 AND e.entry_no + 2)"""


def _vector(expression: str, source: str = USERS) -> str:
    """One row per item of an array expression over the packed series ``x``."""
    return (
        with_(source, PACKED.format("hours"), f"changed AS (SELECT topic, {expression} AS y FROM packed)")
        + """SELECT topic, CAST(i - 1 AS INTEGER) AS i, ROUND(y[i], 6) AS value
             FROM (SELECT topic, y, UNNEST(range(1, len(y) + 1)) AS i FROM changed)"""
    )


_SIGNAL_ROWS = f"SELECT topic, {ms('ts')} AS ts_ms, views, signal FROM signals"
_BUCKET_TEXTS = ", ".join(f"{listed(b)} AS {b}" for b in BUCKET_NAMES)

_SCORES = f"""SELECT topic, {ms('ts')} AS ts_ms, views,
             ROUND(tw / CASE WHEN ow = 0 THEN 0.001 ELSE ow END, 5) AS signal FROM weights"""

ORACLES: dict[str, str] = {
    "topic_hourly_views": with_(TYPES) + f"SELECT topic, {ms('ts')} AS ts_ms, views FROM hours",
    "pageview_line_parse": f"""
      SELECT lower(upper(source[1]) || source[2:] || '_' || upper(lang)) AS topic,
             1704067200000 + (doc_id % 720) * 3600000 AS ts_ms, CAST(SUM(n_chars) AS DOUBLE) AS views
      FROM documents
      WHERE n_chars >= 200 AND (starts_with(lang, 'en') OR starts_with(lang, 'es')) GROUP BY ALL""",
    "keyword_lines": f"SELECT doc_id, lang, source FROM documents WHERE {any_keyword('text', TEXT_KEYWORDS)}",
    "keyword_lines_many": f"SELECT doc_id, lang, source FROM documents WHERE {any_keyword('text', MANY_KEYWORDS)}",
    "keyword_page_hours": with_(PAGE_HOURS) + f"SELECT title, {ms('ts')} AS ts_ms, views FROM page_hours",
    "page_totals": with_(PAGE_HOURS)
    + "SELECT title, CAST(SUM(views) AS BIGINT) AS total FROM page_hours GROUP BY title",
    "url_file_name": "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS file_name FROM pages",
    "hourly_manifest": with_(TYPES, SPINE.format("hours"))
    + f"""SELECT {ms('ts')} AS ts_ms,
             'https://dumps.example.org/other/' || strftime(ts, '%Y/%Y-%m/pageviews-%Y%m%d-%H%M%S.gz') AS url,
             strftime(ts, 'pageviews-%Y%m%d-%H%M%S.gz') AS file_name FROM spine""",
    "densified_series": with_(
        USERS,
        """spans AS (SELECT topic, UNNEST(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS ts
                    FROM hours GROUP BY topic)""",
    )
    + f"""SELECT s.topic, {ms('s.ts')} AS ts_ms, COALESCE(h.views, 0.0) AS views
          FROM spans s LEFT JOIN hours h ON h.topic = s.topic AND h.ts = s.ts""",
    "packed_series": with_(USERS, PACKED.format("hours"))
    + f"SELECT topic, CAST(len(x) AS INTEGER) AS hours, {listed('x')} AS views FROM packed",
    "moving_mean": with_(TYPES)
    + f"""SELECT topic, {ms('ts')} AS ts_ms, ROUND(SUM(views) OVER (PARTITION BY topic ORDER BY ts
             ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) / {WIDTH}, 6) AS moving_mean FROM hours""",
    "moving_std": with_(
        TYPES,
        "dev AS (SELECT topic, ts, views - AVG(views) OVER (PARTITION BY topic) AS x FROM hours)",
        f"""sums AS (SELECT topic, ts, SUM(x) OVER w AS s, SUM(x * x) OVER w AS ss FROM dev
            WINDOW w AS (PARTITION BY topic ORDER BY ts ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW))""",
    )
    + f"""SELECT topic, {ms('ts')} AS ts_ms,
             ROUND(SQRT(GREATEST(ss - s * s / {WIDTH}, 0)) / ({WIDTH} - 1), 6) AS moving_std FROM sums""",
    "trailing_mean": with_(USERS)
    + f"""SELECT topic, {ms('ts')} AS ts_ms, ROUND(AVG(views) OVER (PARTITION BY topic ORDER BY ts
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM hours""",
    "spike_change": with_(USERS)
    + f"""SELECT topic, {ms('ts')} AS ts_ms, ROUND(POW(ABS(views - COALESCE(LAG(views)
             OVER (PARTITION BY topic ORDER BY ts), 0)), 0.1), 6) AS change FROM hours""",
    "trailing_windows": with_(
        USERS,
        """wins AS (SELECT topic, ts, LIST(views) OVER (PARTITION BY topic ORDER BY ts
                ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b,
              SUM(views) OVER (PARTITION BY topic ORDER BY ts) AS running FROM hours)""",
    )
    + f"""SELECT topic, {ms('ts')} AS ts_ms, {listed('b')} AS buffer,
             ROUND(running, 2) AS running_total FROM wins""",
    "peak_signal": with_(TYPES, signals()) + _SIGNAL_ROWS,
    "peak_signal_defaults": with_(TYPES, signals(PeakParams())) + _SIGNAL_ROWS,
    "peak_signal_influence": with_(TYPES, signals(inputs.INFLUENCED)) + _SIGNAL_ROWS,
    "peak_signal_users": with_(USERS, signals()) + _SIGNAL_ROWS,
    "peak_signal_dense": with_(
        USERS.replace("hours AS", "sums AS", 1),
        """spans AS (SELECT topic, UNNEST(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS ts
                    FROM sums GROUP BY topic)""",
        """hours AS (SELECT s.topic, s.ts, COALESCE(h.views, 0.0) AS views
                    FROM spans s LEFT JOIN sums h ON h.topic = s.topic AND h.ts = s.ts)""",
        signals(),
    )
    + _SIGNAL_ROWS,
    "signal_text_roundtrip": with_(USERS, signals()) + _SIGNAL_ROWS,
    "live_peak_signal": with_(TYPES, signals()) + _SIGNAL_ROWS,
    "topic_chart": with_(TYPES, signals())
    + f"""SELECT ROW_NUMBER() OVER (ORDER BY ts) - 1 AS id, views, signal, {ms('ts')} AS time_ms
          FROM signals WHERE topic = 'view'""",
    "event_start_times": f"""
      SELECT strftime(d, '%Y-%m-%d') AS event_date, {ms(midnight('d'))} AS event_ms
      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "event_window_points": with_(TYPES, signals(), EVENTS, POINTS)
    + f"SELECT topic, {ms('ts')} AS ts_ms, {ms('event_ts')} AS event_ms, bucket, views, signal FROM points",
    "event_window_points_dealt": with_(USERS, signals(), EVENTS, POINTS)
    + f"SELECT topic, {ms('ts')} AS ts_ms, {ms('event_ts')} AS event_ms, bucket, views, signal FROM points",
    "event_window_buckets": with_(USERS, signals(), EVENTS, POINTS, WINDOWS)
    + f"""SELECT topic, {ms('event_ts')} AS event_ms, {_BUCKET_TEXTS},
             ROUND(total_views, 2) AS total_views, points, has_peak FROM windows""",
    "event_spikes": with_(USER_SPIKES)
    + f"""SELECT topic, {ms('event_ts')} AS event_ms, {_BUCKET_TEXTS},
             ROUND(total_views, 2) AS total_views FROM spikes""",
    "spike_json_roundtrip": with_(USER_SPIKES)
    + f"SELECT topic, {ms('event_ts')} AS event_ms, {_BUCKET_TEXTS} FROM spikes",
    "spikes_ranked": with_(USER_SPIKES, SUMMARY)
    + f"""SELECT topic, {ms('event_ts')} AS event_ms, {listed('views')} AS views, total_views, offsets
          FROM summary ORDER BY event_ts, total_views DESC, topic""",
    "spikes_capped": with_(
        USER_SPIKES,
        SUMMARY,
        """ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY event_ts
               ORDER BY total_views DESC, topic) AS INTEGER) AS rank,
             COUNT(*) OVER (PARTITION BY event_ts) AS n FROM summary)""",
    )
    + f"""SELECT topic, {ms('event_ts')} AS event_ms, total_views, rank FROM ranked
          WHERE n <= {CROWDED} OR rank <= {SHOWN}""",
    "event_totals": with_(USER_SPIKES, SUMMARY, TOTALS)
    + f"SELECT {ms('event_ts')} AS event_ms, spikes, ROUND(views, 2) AS views FROM totals",
    "event_bubbles": with_(
        USER_SPIKES,
        SUMMARY,
        TOTALS,
        "calendar(position, d, type, party, location) AS (VALUES {})".format(
            ", ".join(f"({i}, '{d}', '{t}', '{p or ''}', '{lo or ''}')" for i, (d, t, p, lo) in enumerate(inputs.CALENDAR_ROWS))
        ),
        f"""dates AS (SELECT {midnight('CAST(d AS DATE)')} AS event_ts,
              string_agg(party || ' ' || type || ' in ' || location || '<br>', '' ORDER BY position) AS tooltip,
              CASE WHEN BOOL_AND(party = 'democrats') THEN 'democrats'
                   WHEN BOOL_AND(party = 'republicans') THEN 'republicans' ELSE 'mixed' END AS party_class
            FROM calendar GROUP BY 1)""",
    )
    + f"""SELECT {ms('event_ts')} AS event_ms, COALESCE(spikes, 0) AS spikes,
             ROUND(COALESCE(views, 0), 2) AS views,
             ROUND(5 + COALESCE(spikes / (SELECT MAX(spikes) FROM totals), 0) * 60, 6) AS y,
             ROUND(5 + COALESCE(views / (SELECT MAX(views) FROM totals), 0) * 15, 6) AS z,
             tooltip, party_class
          FROM dates LEFT JOIN totals USING (event_ts)""",
    "calendar_dates": with_(CALENDAR)
    + f"""SELECT {ms(midnight('CAST(d AS DATE)'))} AS event_ms,
             string_agg(party || ' ' || type || ' in District ' || len(type) || '<br>', '' ORDER BY position) AS tooltip,
             string_agg(DISTINCT party, ',' ORDER BY party) AS parties,
             CASE WHEN BOOL_AND(party = 'democrats') THEN 'democrats'
                  WHEN BOOL_AND(party = 'republicans') THEN 'republicans' ELSE 'mixed' END AS party_class
          FROM entries GROUP BY d""",
    "calendar_csv_parse": """
      SELECT c_custkey, '2016-03-01' AS date, 'democrats' AS party,
             c_name || ', "' || c_mktsegment || '"' AS location FROM customer""",
    "title_prettify": f"""
      SELECT p_partkey, {pretty("replace(p_name, ' ', '_') || '_' || lower(p_type) || '_o''reilly-x_été'")} AS title
      FROM part""",
    "top_pages": with_(PAGE_HOURS, TOP) + "SELECT title, total FROM top",
    "page_matrix": with_(PAGE_HOURS, TOP, SPINE.format("page_hours"))
    + "SELECT epoch_ms(s.ts) AS ts_ms, {} FROM spine s LEFT JOIN page_hours p ON p.ts = s.ts "
    "LEFT JOIN top_ranked t ON t.title = p.title GROUP BY s.ts".format(
        ", ".join(
            f"CAST(COALESCE(SUM(p.views) FILTER (t.rk = {i}), 0) AS BIGINT) AS page_{i:02d}"
            for i in range(1, 21)
        )
    ),
    "page_matrix_text": with_(
        PAGE_HOURS,
        TOP,
        SPINE.format("page_hours"),
        """cells AS (SELECT s.ts, t.rk, COALESCE(SUM(p.views), 0) AS n FROM spine s CROSS JOIN top_ranked t
             LEFT JOIN page_hours p ON p.ts = s.ts AND p.title = t.title GROUP BY ALL)""",
    )
    + """SELECT strftime(ts, 'Date(%Y,%m,%d,%H,%M,%S)') || ' '
             || string_agg(CAST(n AS VARCHAR), ' ' ORDER BY rk) AS row FROM cells GROUP BY ts""",
    "vector_add_one": _vector("list_transform(x, lambda v: v + 1)"),
    "vector_unit_normalise": _vector(f"list_transform(x, lambda v: v / ({level('x', 'len(x)')}))"),
    "vector_log_scale": _vector(f"list_transform(x, lambda v: {log10('v')})"),
    "vector_smooth": _vector(smoothed("x", 4)),
    "vector_spike_normalise": _vector(
        "list_transform(range(1, len(x) + 1), lambda i: POW(ABS(x[i] - CASE WHEN i > 1 THEN x[i - 1] ELSE 0 END), 0.1))"
    ),
    "vector_keep_last": _vector("x[GREATEST(len(x) - 9, 1):]"),
    "vector_transform": with_(USERS, PACKED.format("hours"), chain("changed", "packed", "topic"))
    + """SELECT topic, CAST(i - 1 AS INTEGER) AS i, ROUND(x[i], 6) AS value
         FROM (SELECT topic, x, UNNEST(range(1, len(x) + 1)) AS i FROM changed)""",
    "reference_library": with_(TYPES, LIBRARY)
    + """SELECT ref_id, trending, CAST(i - 1 AS INTEGER) AS i, ROUND(x[i], 6) AS value
         FROM (SELECT *, UNNEST(range(1, len(x) + 1)) AS i FROM library)""",
    "slice_distance": with_(
        USERS,
        PACKED.format("hours"),
        """slices AS (SELECT topic, x[len(x) - 7:] AS a, UNNEST(range(1, len(x) - 14)) AS s, x FROM packed
                     WHERE len(x) >= 16),
           distances AS (SELECT topic, s, len(x) - 15 AS last, list_sum(list_transform(list_zip(a, x[s:s + 7]),
                           lambda p: ABS(p[1] - p[2]))) AS d FROM slices)""",
    )
    + """SELECT p.topic, ROUND(MAX(d) FILTER (s = last), 4) AS distance,
             ROUND(COALESCE(EXP(-0.001 * MIN(d)), 0), 6) AS weight
         FROM packed p LEFT JOIN distances USING (topic) GROUP BY p.topic""",
    "template_weights": with_(TYPES, LIBRARY, WEIGHTS)
    + f"""SELECT topic, {ms('ts')} AS ts_ms, ROUND(tw, 6) AS trend_weight,
             ROUND(ow, 6) AS other_weight FROM weights""",
    "template_scores": with_(TYPES, LIBRARY, WEIGHTS) + _SCORES,
    "live_template_scores": with_(TYPES, LIBRARY, WEIGHTS) + _SCORES,
    "poll_entries": with_(POLLS)
    + f"""SELECT poll, {ms(midnight('d'))} AS entry_ms, name, CAST(v AS VARCHAR) || ' pts' AS value
          FROM values_""",
    "poll_neighbourhood": with_(POLLS)
    + f"""SELECT poll, {ms('event_ts')} AS event_ms, CAST(entry_no AS INTEGER) AS entry_no,
             {ms('entry_ts')} AS entry_ms FROM near""",
    "poll_midpoints": with_(
        POLLS,
        f"""lagged AS (SELECT poll, event_ts, {ms('entry_ts')} AS m, LAG({ms('entry_ts')})
             OVER (PARTITION BY poll, event_ts ORDER BY entry_ts) AS p FROM near)""",
    )
    + f"""SELECT poll, {ms('event_ts')} AS event_ms, CAST(FLOOR((m + p) / 2) AS BIGINT) AS midpoint_ms
          FROM lagged WHERE p IS NOT NULL""",
    "poll_candidates": with_(POLLS)
    + f"""SELECT n.poll, {ms('n.event_ts')} AS event_ms, v.name,
             string_agg({ms('n.entry_ts')} || '=' || CAST(v.v AS VARCHAR), ',' ORDER BY n.entry_ts) AS points
          FROM near n JOIN values_ v ON v.poll = n.poll AND v.d = n.d GROUP BY ALL""",
}
