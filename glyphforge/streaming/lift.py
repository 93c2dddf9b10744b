"""Streaming: the row operators are stateless and lift to streams as they are; and an extension,
coverage over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import coverage
from ..operators.segment import convert
from ..plans.charts import Spec


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    return spark.readStream.text(folder)


def converted(stream: DataFrame, spec: Spec, column: str = "value", sep: str = "") -> DataFrame:
    return stream.withColumn("converted", convert(F.col(column), spec, sep))


def windowed_coverage(stream: DataFrame, spec: Spec, time: str, text: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, n, coverage: mean coverage of the texts of each window; texts later than `late` are left out."""
    rows = coverage(stream, text, spec).withWatermark(time, late)
    return rows.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage"))
