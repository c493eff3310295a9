"""Analysis scopes: which rows an analysis sees, and how its results meet the full row set again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["slide_id", "tile_id"]


def members(assignments: DataFrame, parent: str, ids: list[int]) -> DataFrame:
    """Keys of the rows in the chosen clusters of the deepest parent. Stored assignments hold member rows only,
    so no ancestor has to be looked at; the predicate and the partition reach the scan."""
    if any(i < 0 for i in ids):
        raise ValueError("negative ids name rows outside of the parent")
    return assignments.where((F.col("filter_path") == parent) & F.col("cluster").isin(ids)).select(*KEYS)


def scoped(features: DataFrame, member_keys: DataFrame) -> DataFrame:
    return features.join(member_keys, KEYS, "left_semi")


def dense(features: DataFrame, results: DataFrame, column: str, default) -> DataFrame:
    """Every row of the full set, with ``default`` where a result is missing."""
    return features.join(results.select(*KEYS, column), KEYS, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def unassigned(features: DataFrame, assignments: DataFrame) -> DataFrame:
    return features.join(assignments.select(*KEYS), KEYS, "left_anti")


def in_first_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each combination of keys once, numbered from 0 in the order in which they first appear."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("first"))
    return first.select(*keys, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", *keys)) - 1).cast("long").alias("position"))  # one row a combination


def file_slices(features: DataFrame) -> DataFrame:
    """Offsets of each slide in the concatenation of all, from one row per slide."""
    counts = features.groupBy("slide_id").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("slide_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("stop", F.col("start") + F.col("n"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows each side lacks; an analysis refuses to run unless both are 0."""
    both = left.select(*KEYS, F.lit(1).alias("l")).join(right.select(*KEYS, F.lit(1).alias("r")), KEYS, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("missing_right"), F.count_if(F.col("l").isNull()).alias("missing_left"))
