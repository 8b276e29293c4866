"""Set checks over rows and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def first_occurrences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first, place): each value once, in order of first occurrence."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("first"))
    return first


def set_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(row columns, side): rows of one set that the other lacks; none if they are equal."""
    names = expected.columns
    tagged = expected.distinct().withColumn("e", F.lit(1)).withColumn("f", F.lit(0)).unionByName(found.select(*names).distinct().withColumn("e", F.lit(0)).withColumn("f", F.lit(1)))
    sides = tagged.groupBy(*names).agg(F.max("e").alias("e"), F.max("f").alias("f")).where("e <> f")
    return sides.select(*names, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, excess): rows that stand more often in a (positive) or in b (negative)."""
    both = a.select(*keys, F.lit(1).alias("n")).unionByName(b.select(*keys, F.lit(-1).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("excess")).where("excess <> 0")


def split_leaks(fingerprints: DataFrame, value: str, split: str) -> DataFrame:
    """(value, n_splits): values that stand in more than one split."""
    return fingerprints.groupBy(value).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): values seen twice or more."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value_a, value_b) over the union of the keys, where the values differ or one is absent."""
    left = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    return left.join(right, keys, "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("value_a").eqNullSafe(F.col("value_b"))).select(*keys, "value_a", "value_b")


def closest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")
