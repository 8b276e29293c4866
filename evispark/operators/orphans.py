"""References to records that do not exist.

Every change is a signed delta on a key: a target row adds one to the key's
existence when it starts to live and takes one away when it ends, a reference
adds one to the key's references.  At any time the keys with references and
without existence are the orphans; a reference is one if its key is at the
reference's own time.

A key may hold a third of all rows, so no window runs over a whole key.  The
deltas of one key are cut into time buckets; the counts carried into each bucket
come from sums per key and bucket, and the running sums go over one key and
bucket only.  A bucket with more than ``SLICE`` references is cut further: its
references are spread over slices, each of which gets the bucket's target deltas
and the counts carried into it, so that no task holds more than a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.plans import broadcast_if_small, staged

#: references of one key and bucket that one window holds
SLICE = 200_000
#: most hot buckets that are broadcast
HOT_BUCKETS = 100_000
_REFERENCES, _LIVE, _BEGUN, _KNOWN = "n_references", "live", "begun", "known"
_SUMS = (_REFERENCES, _LIVE, _BEGUN, _KNOWN)
_KEY = ["ref_table", "key"]


def target_deltas(targets: DataFrame) -> DataFrame:
    """Signed existence deltas of target rows (ref_table, key, started_at, ended_at).

    A row that ends before or when it starts never lives, but it counts as
    known and as begun.  A row without a start is known and never begins.
    """
    starts = targets.select(
        "ref_table", "key", F.col("started_at").alias("ts"),
        F.when(F.col("started_at").isNull() | (F.col("ended_at") <= F.col("started_at")), 0).otherwise(1).cast("long").alias(_LIVE),
        F.col("started_at").isNotNull().cast("long").alias(_BEGUN),
        F.lit(1).cast("long").alias(_KNOWN),
    )
    ends = targets.where(F.col("ended_at") > F.col("started_at")).select(
        "ref_table", "key", F.col("ended_at").alias("ts"),
        F.lit(-1).cast("long").alias(_LIVE), F.lit(0).cast("long").alias(_BEGUN), F.lit(0).cast("long").alias(_KNOWN),
    )
    return (
        starts.unionByName(ends)
        .where(F.col("key").isNotNull())
        .groupBy("ref_table", "key", "ts")
        .agg(*[F.sum(c).alias(c) for c in (_LIVE, _BEGUN, _KNOWN)])
    )


def orphan_references(references: DataFrame, targets: DataFrame, bucket: str = "day", slice_rows: int = SLICE) -> DataFrame:
    """References without a live target at their own time.

    ``references`` has (ref_table, ref_key, ref_no, key, t), one row per
    reference; ``targets`` has (ref_table, key, started_at, ended_at).  Other
    columns are ignored.  Returns (ref_table, ref_key, ref_no, status, t).

    A target lives from ``started_at`` (inclusive) to ``ended_at`` (exclusive,
    null = never ends).  status is 'missing' if the key has no target row at
    all, else 'deleted' if one began at or before t, else 'late'.  References
    with a null key are none.  A reference with a null t has no moment to be
    judged at: it is reported only if its key is missing.  The references are
    staged once, so that the counts per bucket are known before the windows run.
    """
    at = [*_KEY, "bucket"]
    start = F.date_trunc(bucket, F.col("ts")).alias("bucket")
    none = {c: F.lit(0).cast("long") for c in _SUMS}
    one = none | {_REFERENCES: F.lit(1).cast("long")}
    refs = staged(
        references.where(F.col("key").isNotNull()).select("ref_table", "key", F.col("t").cast("timestamp").alias("ts"), F.col("ref_key").cast("string").alias("ref_key"), F.col("ref_no").cast("long").alias("ref_no"))
    )
    deltas = target_deltas(targets).withColumns({_REFERENCES: none[_REFERENCES], "ts": F.col("ts").cast("timestamp")})
    per_bucket = staged(
        deltas.select(*_KEY, start, *_SUMS).unionByName(refs.select(*_KEY, start, *[c.alias(n) for n, c in one.items()])).groupBy(*at).agg(*[F.sum(c).alias(c) for c in _SUMS])
    )
    hot = per_bucket.where(F.col(_REFERENCES) > slice_rows).select(*[F.col(c).alias(f"hot_{c}") for c in at], F.ceil(F.col(_REFERENCES) / slice_rows).cast("int").alias("slices"))
    few = broadcast_if_small(hot, HOT_BUCKETS)

    def sliced(rows: DataFrame, each) -> DataFrame:
        """Rows with their slice: 0, or in hot buckets what ``each`` makes of the number of slices."""
        same = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in at]
        return rows.join(few, same[0] & same[1] & same[2], "left").withColumn("slice", each(F.coalesce("slices", F.lit(1)))).drop("slices", *[f"hot_{c}" for c in at])

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = Window.partitionBy(*_KEY)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    empty = {"ref_key": F.lit(None).cast("string"), "ref_no": F.lit(None).cast("long")}
    carried = sliced(
        per_bucket.select(
            *at, F.lit(0).alias("step"), F.lit(None).cast("timestamp").alias("ts"), *[c.alias(n) for n, c in empty.items()],
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (_REFERENCES, _LIVE, _BEGUN)], F.sum(_KNOWN).over(whole).alias(_KNOWN),
        ),
        every,
    )
    changes = sliced(deltas.select(*_KEY, start, F.lit(1).alias("step"), "ts", *[c.alias(n) for n, c in empty.items()], _REFERENCES, _LIVE, _BEGUN, none[_KNOWN].alias(_KNOWN)), every)
    asked = sliced(refs.select(*_KEY, start, F.lit(2).alias("step"), "ts", "ref_key", "ref_no", *[c.alias(n) for n, c in one.items()]), lambda n: F.pmod(F.hash("ref_key", "ref_no"), n))
    running = Window.partitionBy(*at, "slice").orderBy(F.col("ts").asc_nulls_first(), "step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = carried.unionByName(changes).unionByName(asked).select("ref_table", "ref_key", "ref_no", "step", "ts", *[F.sum(c).over(running).alias(c) for c in _SUMS])
    orphan = (F.col(_REFERENCES) > 0) & ((F.col(_KNOWN) == 0) | (F.col("ts").isNotNull() & (F.col(_LIVE) <= 0)))
    status = F.when(F.col(_KNOWN) == 0, "missing").when(F.col(_BEGUN) > 0, "deleted").otherwise("late")
    return seen.where((F.col("step") == 2) & orphan).select("ref_table", "ref_key", "ref_no", status.alias("status"), F.col("ts").alias("t"))


def signed_deltas(references: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref_table, key, ts, reference, existence): the change deltas of references and targets.

    These are what ``streaming.counts`` keeps its counts from; a batch of them
    gives the report as it stands after the last change.
    """
    refs = references.select(*_KEY, F.col("t").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("reference"), F.lit(0).cast("long").alias("existence"))
    lives = target_deltas(targets).select(*_KEY, F.col("ts").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("reference"), F.col(_LIVE).alias("existence"))
    return refs.unionByName(lives).where(F.col("key").isNotNull())


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and status."""
    return orphans.groupBy("ref_table", F.date_format("t", "yyyy-MM").alias("period"), "status").agg(F.count("*").alias("n"))


def normal_identity(column):
    """An identity without surrounding blanks and without regard to case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
