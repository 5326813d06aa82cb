"""Chart tables written by the sinks, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHART_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("views", T.DoubleType()),
        T.StructField("signal", T.DoubleType()),
        T.StructField("time", T.TimestampType()),
    ]
)


def read_topic_chart(spark: SparkSession, path: str) -> DataFrame:
    """Chart of one topic; columns go by position: id, views, signal, time."""
    return spark.read.csv(path, schema=CHART_SCHEMA, header=True, enforceSchema=True)


def read_matrix(spark: SparkSession, path: str, pages: list[str]) -> DataFrame:
    """Space-separated matrix: a ``Date(...)`` column, then one number per page."""
    schema = T.StructType(
        [T.StructField("Date", T.StringType())] + [T.StructField(p, T.LongType()) for p in pages]
    )
    rows = spark.read.csv(path, schema=schema, header=True, sep=" ", enforceSchema=True)
    ts = F.to_timestamp("Date", "'Date('yyyy,MM,dd,HH,mm,ss')'")
    return rows.withColumn("Date", ts).withColumnRenamed("Date", "ts")
