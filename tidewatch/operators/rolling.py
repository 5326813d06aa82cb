"""Rolling statistics over the rows of a topic, in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_time():
    return Window.partitionBy("topic").orderBy("ts")


def moving_mean(series: DataFrame, width: int) -> DataFrame:
    """Sum of the last ``width`` rows over ``width``; the first rows are therefore low."""
    frame = _by_time().rowsBetween(-(width - 1), 0)
    return series.withColumn("moving_mean", F.sum("views").over(frame) / width)


def moving_std(series: DataFrame, width: int) -> DataFrame:
    """Rolling spread ``sqrt(SS - S*S/width) / (width - 1)`` of the last ``width`` rows.

    S and SS are the sums of the deviations from the topic mean and of their squares. The
    division outside the root is part of the definition of the signal. All windows share one
    partitioning and one order, hence one shuffle and one sort.
    """
    whole = _by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = _by_time().rowsBetween(-(width - 1), 0)
    return (
        series.withColumn("_dev", F.col("views") - F.avg("views").over(whole))
        .withColumn("_s", F.sum("_dev").over(frame))
        .withColumn("_ss", F.sum(F.col("_dev") * F.col("_dev")).over(frame))
        .withColumn(
            "moving_std",
            F.sqrt(F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / width, F.lit(0.0)))
            / (width - 1),
        )
        .drop("_dev", "_s", "_ss")
    )


def trailing_mean(series: DataFrame, width: int) -> DataFrame:
    """Mean of up to ``width`` last rows, the first rows over as many as there are."""
    frame = _by_time().rowsBetween(-(max(width, 1) - 1), 0)
    return series.withColumn("smoothed", F.avg("views").over(frame))


def spike_normalised(series: DataFrame, alpha: float) -> DataFrame:
    """``|views - previous views| ** alpha``, the row before the first counting as 0."""
    before = F.coalesce(F.lag("views").over(_by_time()), F.lit(0.0))
    return series.withColumn("change", F.pow(F.abs(F.col("views") - before), F.lit(alpha)))


def trailing_windows(series: DataFrame, width: int) -> DataFrame:
    """Each row with its last ``width`` views and the running total since the topic began."""
    buffer = F.collect_list("views").over(_by_time().rowsBetween(-(width - 1), 0))
    running = F.sum("views").over(_by_time().rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("buffer", buffer).withColumn("running_total", running)
