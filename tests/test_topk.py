from __future__ import annotations

from conftest import hour, naive

from tidewatch.operators import series, topk
from tidewatch.sinks import files
from tidewatch.sources import charts


def hours_of(spark, rows):
    return spark.createDataFrame([(t, hour(h), v) for t, h, v in rows], "title string, ts timestamp, views long")


def test_top_pages_break_ties_by_title(spark):
    hours = hours_of(spark, [("b", 0, 5), ("a", 1, 5), ("c", 0, 9), ("d", 0, 1)])
    assert topk.page_names(hours, 3) == ["c", "a", "b"]


def test_matrix_is_dense(spark, tmp_path):
    hours = hours_of(
        spark, [("x.y", 0, 5), ("x.y", 3, 2), ("B`", 1, 9), ("b`", 1, 8), ("rest", 2, 1)]
    )
    pages = topk.page_names(hours, 3)
    assert pages == ["B`", "b`", "x.y"]
    matrix = topk.page_matrix(hours, len(pages))
    assert matrix.columns == ["ts", "page_01", "page_02", "page_03"]
    expected = [(naive(0), 0, 0, 5), (naive(1), 9, 8, 0), (naive(2), 0, 0, 0), (naive(3), 0, 0, 2)]
    assert sorted(map(tuple, matrix.collect())) == expected
    files.write_matrix(matrix, pages, str(tmp_path / "m"))
    parts = list((tmp_path / "m").glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text().splitlines() == [
        "Date B` b` x.y",
        "Date(2016,02,01,00,00,00) 0 0 5",
        "Date(2016,02,01,01,00,00) 9 8 0",
        "Date(2016,02,01,02,00,00) 0 0 0",
        "Date(2016,02,01,03,00,00) 0 0 2",
    ]
    read = charts.read_matrix(spark, str(tmp_path / "m"), topk.matrix_columns(len(pages)))
    assert sorted(map(tuple, read.collect())) == expected


def test_page_totals(spark):
    hours = hours_of(spark, [("a", 0, 5), ("a", 1, 6)])
    assert [tuple(r) for r in series.page_totals(hours).collect()] == [("a", 11)]
