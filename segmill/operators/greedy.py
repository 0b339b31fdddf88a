"""Order-aware greedy selection as a fold in the JVM, one group of rows at a time.

A group is an image's candidates, which is bounded by what an image can hold, not by
the corpus. The order must be total; the columns in ``order`` end with a unique one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_lists(df: DataFrame, group: list[str], order: list[Column], fields: list[str], name: str = "items") -> DataFrame:
    """A row per group with its rows' ``fields`` as structs, in order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    packed = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__n", *fields))).alias(name))
    return packed


def fold(items: Column, hit: Callable[[Column, Column], Column], budget: Column | int | None = None, empty: Column | None = None) -> Column:
    """Keeps each item that hits none kept before, while fewer than ``budget`` are kept."""
    start = empty if empty is not None else F.filter(items, lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        drop = F.exists(kept, lambda k: hit(k, x))
        if budget is not None:
            drop = drop | (F.size(kept) >= budget)
        return F.when(drop, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(items, start, step)


def suppress(df: DataFrame, group: list[str], order: list[Column], fields: list[str], hit: Callable[[Column, Column], Column], budget: int | None = None) -> DataFrame:
    """The greedily kept rows: group columns, fields and ``rank`` among the kept."""
    lists = ordered_lists(df, group, order, fields)
    kept = lists.select(*group, F.posexplode(fold(F.col("items"), hit, budget)).alias("rank", "k"))
    return kept.select(*group, *[F.col(f"k.{f}").alias(f) for f in fields], (F.col("rank") + 1).alias("rank"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group; all of them for n <= 0."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n) if n > 0 else ranked
