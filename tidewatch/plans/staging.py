"""Intermediate results that several passes read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.session import shared_folder


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a result below the shared folder and read it back.

    Later passes then start from the small result instead of the raw input, and a lost
    executor costs no recomputation of it.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def staged_by(frame: DataFrame, name: str, column: str, parts: int) -> DataFrame:
    """Write a result below the shared folder in ``parts`` by a hash of ``column`` and read it back.

    Joins of such results on ``column`` need no shuffle.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    table = "tidewatch_" + path.rpartition("/")[2].replace("-", "_")
    frame.write.bucketBy(parts, column).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.schema  # the files are known from here on, and the name is not needed
    spark.sql(f"DROP TABLE {table}")
    return found
