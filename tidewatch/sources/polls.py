"""Opinion-poll documents: one nested JSON document per poll."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import clock
from tidewatch.params import EventParams

_CANDIDATE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
)
_ENTRY = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("candidate", T.ArrayType(_CANDIDATE)),
    ]
)
POLL_SCHEMA = T.StructType(
    [T.StructField("poll", T.StructType([T.StructField("rcp_avg", T.ArrayType(_ENTRY))]))]
)


def poll_entries(
    documents: DataFrame,
    params: EventParams = EventParams(),
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """``(poll, date, entry_ts, candidate)``: one row per poll and date.

    ``entry_ts`` starts the date in the event zone, so that polls and events meet on it.
    """
    entries = documents.select("poll_name", F.explode("poll.rcp_avg").alias("e"))
    date = F.try_to_date("e.date", date_format)
    return entries.select(
        F.col("poll_name").alias("poll"),
        date.alias("date"),
        clock.local_midnight(date, params.zone).alias("entry_ts"),
        F.col("e.candidate").alias("candidate"),
    ).where(F.col("date").isNotNull())


def read_polls(
    spark: SparkSession,
    paths: dict[str, str],
    params: EventParams = EventParams(),
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Entries of several named poll documents."""
    documents = [
        spark.read.json(path, schema=POLL_SCHEMA, multiLine=True).withColumn("poll_name", F.lit(name))
        for name, path in paths.items()
    ]
    return poll_entries(reduce(DataFrame.unionByName, documents), params, date_format)
