"""The library of labelled reference series: ``(ref_id, trending, series)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import vectors
from tidewatch.params import TemplateParams


def prepare_references(labelled: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """Library rows from raw labelled series ``(ref_id, trending, values array<double>)``."""
    prepared = vectors.transform_series(F.col("values"), params)
    return labelled.select("ref_id", "trending", prepared.alias("series")).withColumn(
        "series", vectors.keep_last(F.col("series"), params.reference_length)
    )


def add_references(
    labelled: DataFrame, path: str, params: TemplateParams = TemplateParams()
) -> None:
    """Append prepared reference series to a stored library."""
    prepare_references(labelled, params).write.mode("append").parquet(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ref_id", "trending", "series")
