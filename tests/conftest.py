from __future__ import annotations

import contextlib
import io
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tidewatch.session import local_session  # noqa: E402

START = datetime(2016, 2, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8, "6g")
    yield session
    session.stop()


def plan_of(frame) -> str:
    """The physical plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def hour(i: int) -> datetime:
    return START + timedelta(hours=i)


def naive(i: int) -> datetime:
    """The same hour as Spark hands it back to a driver in UTC."""
    return hour(i).replace(tzinfo=None)


@pytest.fixture(scope="session")
def make_series(spark):
    def make(topics: dict[str, list[float]]):
        rows = [(t, hour(i), float(v)) for t, xs in topics.items() for i, v in enumerate(xs) if v is not None]
        return spark.createDataFrame(rows, "topic string, ts timestamp, views double")

    return make
