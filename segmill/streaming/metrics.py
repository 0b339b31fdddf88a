"""Extension: training metrics as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import metric_points


def stream_points(spark: SparkSession, folder: str, metric: str = "total_loss") -> DataFrame:
    """(iteration, value) of lines as files arrive in a folder."""
    return metric_points(spark.readStream.text(folder), metric)


def running_summary(points: DataFrame) -> DataFrame:
    """Count, last iteration and least value so far; for the complete or update output mode."""
    return points.agg(F.max("iteration").alias("max_iteration"), F.min("value").alias("min_value"), F.count(F.lit(1)).alias("points"))
