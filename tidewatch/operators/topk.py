"""The most viewed pages, hour by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import hour_spine, page_totals

# Fixed value: pages in a matrix.
TOP_PAGES = 20


def top_pages(hours: DataFrame, k: int = TOP_PAGES) -> DataFrame:
    """``(title, total)`` of the ``k`` most viewed pages, ties in title order."""
    return page_totals(hours).orderBy(F.desc("total"), F.asc("title")).limit(k)


def page_names(hours: DataFrame, k: int = TOP_PAGES) -> list[str]:
    """Titles of the top pages, most viewed first: the header of a matrix, at most ``k`` rows."""
    return [row.title for row in top_pages(hours, k).select("title").collect()]


def matrix_columns(k: int = TOP_PAGES) -> list[str]:
    """Column names of a matrix of ``k`` pages. Titles may hold dots or differ in case only, so they
    are no column names."""
    return [f"page_{rank:02d}" for rank in range(1, k + 1)]


def page_matrix(hours: DataFrame, k: int = TOP_PAGES, spine: DataFrame | None = None) -> DataFrame:
    """One row per hour and one column per top page; hours and pages without views hold 0.

    The ranks are worked out in the plan, over ``k`` rows, and joined by title; rows of other pages
    are gone before the shuffle by hour. With fewer pages than ``k`` the last columns hold 0.
    """
    every_hour = hour_spine(hours) if spine is None else spine
    if not k:
        return every_hour
    ranked = Window.orderBy(F.desc("total"), F.asc("title"))  # of k rows
    ranks = top_pages(hours, k).select("title", F.row_number().over(ranked).alias("_rank"))
    cells = [
        F.sum(F.when(F.col("_rank") == rank, F.col("views"))).alias(name)
        for rank, name in enumerate(matrix_columns(k), 1)
    ]
    wide = hours.join(ranks, "title").groupBy("ts").agg(*cells)
    return every_hour.join(wide, "ts", "left").fillna(0, matrix_columns(k))
