"""Interval operators: merging, gaps, coverage, byte budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(intervals: DataFrame, keys: list[str], touch: int = 1) -> DataFrame:
    """(keys, first, last, n): intervals [first, last] of integers, joined when one starts at most ``touch`` after the reach of those before.

    Intervals with first > last or a null end leave; repeated ones count in n.
    """
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("first") > reach + touch)).cast("int")
    marked = intervals.where("first <= last").withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).drop("island")


def gaps(required: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): the parts of each key's required range [first, last] that no delivered interval covers.

    ``required`` has one range per key.
    """
    cut = delivered.withColumnsRenamed({"first": "d_first", "last": "d_last"}).join(required, keys)
    cut = cut.where("d_first <= d_last and d_first <= last and d_last >= first").select(*keys, F.greatest("d_first", "first").alias("first"), F.least("d_last", "last").alias("last"))
    covers = merged(cut, keys).select(*keys, "first", "last")
    ends = required.select(*keys, (F.col("first") - 1).alias("last"), F.lit(None).cast("long").alias("first"), F.col("last").alias("end"))
    parts = ends.unionByName(covers.select(*keys, F.col("last").cast("long"), F.col("first").cast("long"), F.lit(None).cast("long").alias("end")))
    w = Window.partitionBy(*keys).orderBy("last")
    end = F.max("end").over(Window.partitionBy(*keys))
    following = F.coalesce(F.lead("first").over(w), end + 1)
    return parts.select(*keys, (F.col("last") + 1).alias("first"), (following - 1).alias("last")).where("first <= last")


def coverage(required: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): 'delivered', 'partial' or 'unobserved' for each required range."""
    open_parts = gaps(required, delivered, keys).groupBy(*keys).agg(F.sum(F.col("last") - F.col("first") + 1).alias("missing"))
    length = F.col("last") - F.col("first") + 1
    joined = required.join(open_parts, keys, "left")
    state = F.when(F.coalesce("missing", F.lit(0)) == 0, "delivered").when(F.col("missing") < length, "partial").otherwise("unobserved")
    return joined.select(*keys, state.alias("state"), (length - F.coalesce("missing", F.lit(0))).alias("n_covered"))


def all_covered(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reading): 'read_complete' if every part was delivered, else 'partially_read'."""
    return states.groupBy(*keys).agg(F.when(F.bool_and(F.col("state") == "delivered"), "read_complete").otherwise("partially_read").alias("reading"))


def byte_prefix(items: DataFrame, keys: list[str], order: list[str], size: str, budget: int, block: Column | None = None) -> DataFrame:
    """The items of each key up to the first that would exceed the budget, with their running size.

    ``block`` cuts a key's items into stretches that rise with the order, such
    as hundreds of pages: sizes are summed per stretch first, so that a window
    holds one stretch, and stretches beyond the budget leave before they are
    sorted.  Null sizes count as 0.
    """
    held = items.withColumn("block_", F.lit(0) if block is None else block)
    sums = held.groupBy(*keys, "block_").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("n_"))
    earlier = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    base = sums.withColumn("base_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).where(F.col("base_") <= budget).drop("n_")
    w = Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = held.join(base, [*keys, "block_"])
    return near.withColumn("running", F.col("base_") + F.sum(F.coalesce(F.col(size), F.lit(0))).over(w)).where(F.col("running") <= budget).select(*items.columns, "running")


def packed(items: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """items plus ``sheet``: greedy pages of at most ``budget`` in order; a larger item has a page of its own.

    Packing depends on all items before, so each partition is streamed in order;
    a key of any length is held row by row, not as a whole.
    """
    names = items.columns
    at = [names.index(k) for k in keys]
    where = names.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, sheet = None, 0, 0
        for batch in batches:
            sheets = []
            columns = [batch.column(i).to_pylist() for i in at]
            for own, weight in zip(zip(*columns), batch.column(where).to_pylist()):
                weight = weight or 0
                if own != key:
                    key, used, sheet = own, 0, 0
                elif used + weight > budget:
                    used, sheet = 0, sheet + 1
                used += weight
                sheets.append(sheet)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sheets, pa.int32())], [*names, "sheet"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sheet int"
    return items.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
