"""Similarity of recent traffic to labelled reference series.

At every hour the last ``reference_length`` points of a topic are normalised and compared
with all reference series; the score is the weight of the trending ones over the weight of
the others. Spark shuffles the series once, packed by topic, and lays a grid over topics and library: topics are
dealt to blocks, the library is cut into chunks, and each block meets every chunk. The comparison
itself is ``hours x references x series_length`` arithmetic on numbers already in place, done with
numpy on Arrow batches: no pair of window and reference ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import vectors
from tidewatch.params import TemplateParams

# References of a chunk.
PER_CHUNK = 256
_WINDOWS_AT_ONCE = 2_048
_ROWS_AT_ONCE = 10_000
# Numbers compared at a time where every row has its own series.
_CELLS_AT_ONCE = 1 << 21
# Pieces of a series whose sums bound its distance, and room for the rounding of those sums.
_PIECES = 4
_ROUNDING = 1e-9


# Comparison ------------------------------------------------------------------------------------


def prepared_windows(x: np.ndarray, params: TemplateParams) -> np.ndarray:
    """Last ``series_length`` items of each transformed window, one row per window."""
    length = params.reference_length
    w = np.lib.stride_tricks.sliding_window_view(x + 1.0, length)
    level = w[:, : max(length - params.baseline_offset, 0)].sum(axis=1) / length
    level[level == 0] = vectors.EMPTY_LEVEL
    w = w / level[:, None]
    w = np.log10(np.where(w <= 0, vectors.EMPTY_LEVEL, w))
    if params.smooth > 1:
        sums = np.cumsum(w, axis=1)
        sums[:, params.smooth :] -= sums[:, : -params.smooth].copy()
        w = sums / np.minimum(np.arange(1, length + 1), params.smooth)
    return np.ascontiguousarray(w[:, length - params.series_length :])


def distances(tests: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """L1 distances of rows to rows."""
    return np.abs(tests - slices).sum(axis=1)


def _piece_sums(rows: np.ndarray) -> np.ndarray:
    """Sums over the pieces of each row."""
    starts = np.linspace(0, rows.shape[1], min(_PIECES, rows.shape[1]), endpoint=False).astype(int)
    return np.add.reduceat(rows, starts, axis=1)


def nearest(tests: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Distance of each test to the nearest slice.

    The differences between the sums of the pieces of two series add up to no more than their distance.
    Each test is first compared with the slice of the least such bound; then a slice is compared only
    with the tests that its bound leaves open, so none that could be nearer is left out.
    """
    if len(slices) == 1:
        return distances(tests, slices[0])
    of_tests, of_slices = _piece_sums(tests), _piece_sums(slices)
    bounds = sum(np.abs(a[:, None] - b[None, :]) for a, b in zip(of_tests.T, of_slices.T)) - _ROUNDING
    first = bounds.argmin(axis=1)
    best = distances(tests, slices[first])
    bounds[np.arange(len(tests)), first] = np.inf
    for j in np.nonzero((bounds < best[:, None]).any(axis=0))[0]:
        left = np.nonzero(bounds[:, j] < best)[0]
        if len(left):
            best[left] = np.minimum(best[left], distances(tests[left], slices[j]))
    return best


def weights_of(tests: np.ndarray, references: list, params: TemplateParams) -> np.ndarray:
    """Summed weight of the references for each test series; one shorter than a test weighs 0."""
    n = params.series_length
    weight = np.zeros(len(tests))
    for ref in references:
        if len(ref) >= n and len(tests):
            slices = np.lib.stride_tricks.sliding_window_view(ref, n)
            weight += np.exp(-params.decay * nearest(tests, slices))
    return weight


def score_series(x: np.ndarray, trending: list, others: list, params: TemplateParams) -> np.ndarray:
    """Weights of one series, shape ``(hours, 2)``; zero until the window has filled."""
    weights = np.zeros((len(x), 2))
    first = params.reference_length - 1
    for at in range(first, len(x), _WINDOWS_AT_ONCE):
        until = min(at + _WINDOWS_AT_ONCE, len(x))
        tests = prepared_windows(x[at - first : until], params)
        weights[at:until, 0] = weights_of(tests, trending, params)
        weights[at:until, 1] = weights_of(tests, others, params)
    # Nothing is scored while the total since the start of the series is still zero.
    weights[np.cumsum(x) == 0] = 0.0
    return weights


def _nearest_rows(refs: pa.ListArray, tests: np.ndarray) -> np.ndarray:
    """Distance of each row's test to the nearest slice of its own reference; infinite without a slice."""
    n = tests.shape[1]
    lengths = refs.value_lengths().fill_null(0).to_numpy()
    flat = refs.flatten().to_numpy(zero_copy_only=False)
    counts = np.maximum(lengths - n + 1, 0)
    best = np.full(len(lengths), np.inf)
    starts, at = np.cumsum(lengths) - lengths, 0
    while at < len(lengths):
        until = at + max(int(np.searchsorted(np.cumsum(counts[at:]), _CELLS_AT_ONCE // n, "right")), 1)
        row = np.repeat(np.arange(at, until), counts[at:until])
        if len(row):
            within = np.arange(len(row)) - np.repeat(np.cumsum(counts[at:until]) - counts[at:until], counts[at:until])
            slices = np.lib.stride_tricks.sliding_window_view(flat, n)[starts[row] + within]
            np.minimum.at(best, row, distances(tests[row], slices))
        at = until
    return best


def slice_weight(reference: Column, test: Column, params: TemplateParams) -> Column:
    """Weight of a reference for a prepared series of ``series_length`` items, row by row.

    A reference shorter than the series weighs 0.
    """
    n = params.series_length

    @F.arrow_udf("double")
    def weight(refs: pa.Array, tests: pa.Array) -> pa.Array:
        # A row without a whole series has no use for its values.
        whole = (tests.value_lengths().fill_null(0).to_numpy() == n) & (refs.value_lengths().fill_null(0).to_numpy() >= n)
        out = np.zeros(len(tests))
        if whole.any():
            kept = pa.array(whole)
            rows = tests.filter(kept).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            out[whole] = np.exp(-params.decay * _nearest_rows(refs.filter(kept), rows))
        return pa.array(out)

    return weight(reference, test)


# The grid --------------------------------------------------------------------------------------


def chunks(references: DataFrame, per_chunk: int = PER_CHUNK) -> DataFrame:
    """The library in rows of up to ``per_chunk`` series: labels, lengths, and all items one after the other.

    References are put together where they lie, without a shuffle. One without a label counts as other.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per_chunk):
                part = batch.slice(at, per_chunk)
                series = part.column("series")
                row = {
                    "labels": part.column("trending").to_pylist(),
                    "lengths": series.value_lengths().fill_null(0).to_pylist(),
                    "items": series.flatten().to_numpy(zero_copy_only=False),
                }
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _CHUNK)

    labelled = references.select(
        F.coalesce("trending", F.lit(False)).alias("trending"), F.col("series").cast("array<double>").alias("series")
    )
    return labelled.mapInArrow(cut, "labels array<boolean>, lengths array<int>, items array<double>")


_CHUNK = pa.schema(
    [("labels", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.float64()))]
)


def _chunk_series(chunk: dict[str, pa.Array], row: int) -> tuple[list, list]:
    """Trending and other series of a chunk; none where a topic met no chunk."""
    if not chunk["lengths"][row].is_valid:
        return [], []
    values = chunk["items"][row].values.to_numpy(zero_copy_only=False)
    lengths = chunk["lengths"][row].values.to_numpy()
    series = np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []
    labels = chunk["labels"][row].as_py()
    return [s for s, t in zip(series, labels) if t], [s for s, t in zip(series, labels) if not t]


class _Rows:
    """Scored series on their way out, a few thousand rows at a time."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, topic: str | None, points: pa.StructArray, weights: np.ndarray) -> None:
        self.parts.append((topic, points, weights))
        self.size += len(points)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            lengths = [len(p) for _, p, _ in self.parts]
            topics = pa.array([t for t, _, _ in self.parts], pa.string()).take(
                pa.array(np.repeat(np.arange(len(lengths)), lengths))
            )
            points = pa.concat_arrays([p for _, p, _ in self.parts])
            weights = np.concatenate([w for _, _, w in self.parts])
            columns = [topics, points.field("ts"), points.field("views"), pa.array(weights[:, 0]), pa.array(weights[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["topic", "ts", "views", "trend_weight", "other_weight"])
        self.parts, self.size = [], 0


def template_weights(
    series: DataFrame,
    references: DataFrame,
    params: TemplateParams = TemplateParams(),
    per_chunk: int = PER_CHUNK,
    blocks: int | None = None,
) -> DataFrame:
    """Weights of trending and other references per topic and hour.

    A hash deals the topics to ``blocks`` (twice the shuffle partitions if not given), and the series are
    shuffled once, by block. Each block meets the whole library, chunk by chunk, in a sort-merge join
    whose streamed side are the topics: a topic's meetings follow each other in one task, which adds their weights up, and
    nothing is shuffled after them. Neither side is broadcast, whatever its size; what is copied for every block is the
    library. The result does not depend on blocks and chunks. A topic shorter than the
    window meets no chunk and weighs 0.
    """
    spark = series.sparkSession
    blocks = blocks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks)).alias("_block")
    dealt = series.select(block, "topic", "ts", F.col("views").cast("double").alias("views")).repartition("_block")
    points = F.sort_array(F.collect_list(F.struct("ts", "views"))).alias("points")
    packed = dealt.groupBy("_block", "topic").agg(points)
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    library = chunks(references, per_chunk).select(F.explode(every).alias("_with"), "*").hint("merge")
    filled = F.size("points") >= params.reference_length
    met = packed.join(library, (F.col("_block") == F.col("_with")) & filled, "left")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, done, topic, points, weights = _Rows(), set(), None, None, None
        for batch in batches:
            chunk = {name: batch.column(name) for name in _CHUNK.names}
            topics, lists = batch.column("topic").to_pylist(), batch.column("points")
            for i, current in enumerate(topics):
                if points is None or current != topic:
                    if points is not None:
                        rows.add(topic, points, weights)
                        done.add(topic)
                    if current in done:
                        raise ValueError(f"the meetings of topic {current!r} are not in a row")
                    topic, points = current, lists[i].values
                    x = points.field("views").to_numpy(zero_copy_only=False)
                    weights = np.zeros((len(x), 2))
                trending, others = _chunk_series(chunk, i)
                if trending or others:
                    weights += score_series(x, trending, others, params)
                if rows.size >= _ROWS_AT_ONCE:
                    yield from rows.flush()
        if points is not None:
            rows.add(topic, points, weights)
        yield from rows.flush()

    schema = "topic string, ts timestamp, views double, trend_weight double, other_weight double"
    return met.select("topic", "points", *_CHUNK.names).mapInArrow(scored, schema)


def template_scores(
    series: DataFrame,
    references: DataFrame,
    params: TemplateParams = TemplateParams(),
    per_chunk: int = PER_CHUNK,
    blocks: int | None = None,
) -> DataFrame:
    """``(topic, ts, views, signal)`` with the ratio of the two weights as signal."""
    weights = template_weights(series, references, params, per_chunk, blocks)
    ratio = vectors.weight_ratio(F.col("trend_weight"), F.col("other_weight"))
    return weights.select("topic", "ts", "views", ratio.alias("signal"))
