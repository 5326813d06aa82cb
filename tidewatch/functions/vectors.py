"""Functions on ``array<double>`` columns used to prepare and compare reference series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.params import TemplateParams

# Fixed values that stand in for a zero.
EMPTY_LEVEL = 0.00001
EMPTY_WEIGHT = 0.001


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Inside an array function a plain expression is worked out again for every item; passing
    it through a one-item array turns it into a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def add_one(values: Column) -> Column:
    return F.transform(values, lambda v: v + 1)


def baseline_level(values: Column, params: TemplateParams) -> Column:
    """Sum of the baseline stretch over ``reference_length``, a fixed divisor.

    The stretch ends ``baseline_offset`` items before the end of the series and is at most
    ``reference_length`` items long.
    """
    end = F.greatest(F.size(values) - params.baseline_offset, F.lit(0))
    start = F.greatest(end - params.reference_length, F.lit(0))
    level = total(F.slice(values, start + 1, end - start)) / params.reference_length
    return F.when(level == 0, F.lit(EMPTY_LEVEL)).otherwise(level)


def unit_normalise(values: Column, params: TemplateParams) -> Column:
    def divided(v: Column) -> Column:
        return let(
            baseline_level(v, params), lambda level: F.transform(v, lambda item: item / level)
        )

    return let(values, divided)


def log_scale(values: Column) -> Column:
    return F.transform(values, lambda v: F.log10(F.when(v <= 0, F.lit(EMPTY_LEVEL)).otherwise(v)))


def smooth(values: Column, width: int) -> Column:
    """Trailing mean over at most ``width`` items."""
    if width <= 1:
        return values

    def smoothed(v: Column) -> Column:
        def trailing(_: Column, i: Column) -> Column:
            n = F.least(i + 1, F.lit(width))
            return total(F.slice(v, i - n + 2, n)) / n

        return F.transform(v, trailing)

    return let(values, smoothed)


def spike_normalise(values: Column, alpha: float) -> Column:
    """``|x[i] - x[i-1]| ** alpha``, the item before the first counting as 0."""

    def changes(v: Column) -> Column:
        def step(item: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(v, i - 1)).otherwise(F.lit(0.0))
            return F.pow(F.abs(item - before), F.lit(alpha))

        return F.transform(v, step)

    return let(values, changes)


def keep_last(values: Column, length: int) -> Column:
    return let(
        values, lambda v: F.slice(v, F.greatest(F.size(v) - length, F.lit(0)) + 1, F.lit(length))
    )


def transform_series(values: Column, params: TemplateParams) -> Column:
    """Add one, normalise, log-scale, smooth."""
    return smooth(log_scale(unit_normalise(add_one(values), params)), params.smooth)


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences; series of unequal length are an error."""
    distance = total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.when(F.size(a) == F.size(b), distance).otherwise(
        F.raise_error(F.lit("series must have the same length"))
    )


def weight_ratio(trending: Column, other: Column) -> Column:
    return trending / F.when(other == 0, F.lit(EMPTY_WEIGHT)).otherwise(other)
