"""Chains of records: retries, supersession, changes between versions, call pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.plans import cut_lineage


def leaves(records: DataFrame, key: str, parent: str) -> DataFrame:
    """Records that no other record names as its parent."""
    named = records.where(F.col(parent).isNotNull()).select(F.col(parent).alias(key)).distinct()
    return records.join(named, key, "left_anti")


def chains(records: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth, state) of every record, by pointer doubling.

    state is 'rooted', 'orphan' (the first record of its chain names a parent
    that is not there; root is that first record and depth counts from it) or
    'cycle' (the record is on a cycle or below one; root and depth are null).
    A key that occurs twice counts once, with its smallest parent; null keys
    are none.  Each round doubles the links that are followed and joins only the
    records that have not arrived; once more links are followed than there are
    records, those left go in circles.  So chains of any length end.
    """
    once = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(parent).alias("parent"))
    known = once.select(F.col("k").alias("parent"), F.lit(True).alias("there"))
    linked = once.join(known, "parent", "left")
    first = F.col("parent").isNull() | F.col("there").isNull()
    state = F.when(F.col("parent").isNull(), "rooted").when(F.col("there").isNull(), "orphan")
    hops = cut_lineage(linked.select("k", F.when(first, F.col("k")).otherwise(F.col("parent")).alias("up"), (~first).cast("long").alias("depth"), state.alias("state")))
    n, links = hops.count(), 1
    done = hops.where("state is not null")
    moving = hops.where("state is null")
    while links <= n and moving.limit(1).count():
        above = done.unionByName(moving).select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("state").alias("state2"))
        step = cut_lineage(moving.join(above, "up").select("k", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("state2").alias("state")))
        done, moving = done.unionByName(step.where("state is not null")), step.where("state is null")
        links *= 2
    round_and_round = moving.select("k", F.lit(None).cast(records.schema[key].dataType).alias("up"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("state"))
    return done.unionByName(round_and_round).select(F.col("k").alias(key), F.col("up").alias("root"), "depth", "state")


def depths(records: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth) of the records whose chain begins at a record without a parent; see ``chains`` for the rest."""
    return chains(records, key, parent).where("state = 'rooted'").drop("state")


def branches(records: DataFrame, key: str, parent: str) -> DataFrame:
    """(parent, n): parents with more than one child, which no linear chain has."""
    return records.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("n")).where("n > 1")


def changed_paths(saves: DataFrame, keys: list[str], order: str, values: str) -> DataFrame:
    """(keys, order, added, removed, changed): paths that differ from the save before, each sorted."""
    before = F.lag(values).over(Window.partitionBy(*keys).orderBy(order))
    pairs = saves.withColumn("was", before).where(F.col("was").isNotNull())
    now, was = F.map_keys(values), F.map_keys("was")
    both = F.array_intersect(now, was)
    return pairs.select(
        *keys, order, F.array_sort(F.array_except(now, was)).alias("added"), F.array_sort(F.array_except(was, now)).alias("removed"),
        F.array_sort(F.filter(both, lambda p: ~F.element_at(values, p).eqNullSafe(F.element_at("was", p)))).alias("changed"),
    )


def last_change(versions: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each version with the order of the last version at which its value changed."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    marked = versions.withColumn("mark", F.when(changed, F.col(order)))
    return marked.withColumn("since", F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("mark")


def call_pairs(events: DataFrame) -> DataFrame:
    """(transcript, thread, call_id, started, completed): starts and completions of calls.

    ``events`` has (transcript, ordinal, type, call_id).  Threads count the
    'thread.started' events so far.  The n-th start of a call id in a thread
    belongs to its n-th completion, so reused ids pair in order, and either
    side may be missing.
    """
    w = Window.partitionBy("transcript").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    threaded = events.withColumn("thread", F.sum((F.col("type") == "thread.started").cast("int")).over(w))
    calls = threaded.where(F.col("type").isin("item.started", "item.completed") & F.col("call_id").isNotNull())
    n = F.row_number().over(Window.partitionBy("transcript", "thread", "call_id", "type").orderBy("ordinal"))
    return calls.withColumn("n", n).groupBy("transcript", "thread", "call_id", "n").agg(
        F.max(F.when(F.col("type") == "item.started", F.col("ordinal"))).alias("started"), F.max(F.when(F.col("type") == "item.completed", F.col("ordinal"))).alias("completed"),
    ).drop("n")
