"""The flagship plan: merge two label sets and describe the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import combine_labels
from ..operators.stats import label_stats
from . import fixtures as fx


def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.annotations(spark, sf_dir)
    merged = combine_labels(a.filter("source = 'baseline'"), a.filter("source = 'crop'"))
    return label_stats(fx.images(spark, sf_dir), merged)
