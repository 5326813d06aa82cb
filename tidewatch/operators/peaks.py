"""Adaptive peak signal.

The baseline of a point depends on which earlier points were peaks, so no window frame can
express it. It is a left fold over the series of one topic, run by Spark's ``aggregate``
inside the JVM: topics are shuffled once, then folded in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators.series import densify_packed, pack
from tidewatch.params import PeakParams

# The fold keeps its 0/1 decisions as the bits of a list of longs: appending each one to an
# array would copy the array at every step.
_BITS = 62


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` worked out once per row instead of wherever it is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(x: str, params: PeakParams) -> str:
    """Decisions of the rows of ``x`` as an array of longs, from a baseline ``mean``, ``std``."""
    f = f"{float(params.influence)!r}D"

    def state(mean: str, std: str, bit: int) -> str:
        word = f"acc.word * 2 + {bit}"
        full = f"acc.n = {_BITS - 1}"
        return f"""named_struct(
            'mean', {mean}, 'std', {std}, 'n', if({full}, 0, acc.n + 1),
            'word', if({full}, 0L, {word}),
            'words', if({full}, array_append(acc.words, {word}), acc.words))"""

    away = "abs(v - acc.mean)"
    peak = state(f"acc.mean + v * {f} / (1 + {f})", f"acc.std + {away} * {f} / (1 + {f})", 1)
    calm = state("(acc.mean + v) / 2", f"(acc.std + {away}) / 2", 0)
    # NaN is no peak, although Spark orders it above all numbers.
    above = f"v > acc.mean + acc.std * {float(params.diff)!r}D AND NOT isnan(v)"
    # The last word is padded, so that the bit of a row is always at the same place.
    return f"""aggregate(
        {x},
        named_struct('mean', mean, 'std', std, 'n', 0, 'word', 0L,
                     'words', cast(array() AS array<bigint>)),
        (acc, v) -> if({above}, {peak}, {calm}),
        acc -> array_append(acc.words, shiftleft(acc.word, {_BITS} - acc.n)))"""


def _decided(points: str, params: PeakParams) -> str:
    """Bits of the decisions of one packed series, longer than the window."""
    k = params.win_length
    # The first baseline covers rows 2 to k+1: the first row is out, the first judged one in.
    first = f"slice(x, 2, {k})"
    mean = f"aggregate({first}, 0D, (s, v) -> s + v) / {k}"
    std = f"sqrt(aggregate({first}, 0D, (s, v) -> s + (v - mean) * (v - mean))) / ({k} - 1)"
    fold = _fold(f"slice(x, {k} + 1, size(x) - {k})", params)
    return _let("x", f"transform({points}, p -> p.views)", _let("mean", mean, _let("std", std, fold)))


def _signal(words: str, index: str, k: int) -> str:
    """Decision of the row at ``index``: 0.0 or 1.0."""
    judged = f"({index} - {k})"
    bit = f"shiftright(get({words}, int({judged} div {_BITS})), {_BITS - 1} - {judged} % {_BITS}) % 2"
    return f"if({judged} < 0, 0D, double({bit}))"


def _long_enough(packed: DataFrame, params: PeakParams) -> DataFrame:
    return packed.where(f"size(points) > {params.win_length}")


def _packed(series: DataFrame, params: PeakParams, densify: bool) -> DataFrame:
    """Packed series longer than the window, optionally with their gaps filled where they lie."""
    packed = pack(series)
    return _long_enough(densify_packed(packed) if densify else packed, params)


def detect_peaks(
    series: DataFrame, params: PeakParams = PeakParams(), peaking_only: bool = False, densify: bool = False
) -> DataFrame:
    """``(topic, ts, views, signal)`` from hourly series ``(topic, ts, views)``.

    Topics with no more than ``win_length`` rows produce nothing. With ``densify`` absent hours count as
    rows of 0 views; the series is packed once and handed on as it is. With ``peaking_only``
    topics without a single peak are not unpacked: they cannot produce a spike, and they are
    the great majority.
    """
    packed = _packed(series, params, densify)
    decided = packed.selectExpr("topic", "points", f"{_decided('points', params)} AS _words")
    # Not a filter: Spark would move it below the fold and run the fold twice.
    points = "if(exists(_words, w -> w <> 0), points, null)" if peaking_only else "points"
    rows = decided.selectExpr("topic", f"posexplode({points}) AS (_i, _p)", "_words")
    signal = _signal("_words", "_i", params.win_length)
    return rows.selectExpr("topic", "_p.ts", "_p.views", f"{signal} AS signal")


def packed_peaks(series: DataFrame, params: PeakParams = PeakParams(), densify: bool = False) -> DataFrame:
    """One row per topic: ``points`` array of ``(ts, views, signal)``."""
    signal = _signal("words", "i", params.win_length)
    rows = f"""transform(
        points, (p, i) -> named_struct('ts', p.ts, 'views', p.views, 'signal', {signal}))"""
    points = _let("words", _decided("points", params), rows)
    return _packed(series, params, densify).selectExpr("topic", f"{points} AS points")
