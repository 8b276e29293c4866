"""Signed reference and existence counts kept up from a stream of change deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_counts(deltas: DataFrame) -> DataFrame:
    """(ref_table, key, n_references, n_existing): running sums of a stream's signed deltas.

    ``deltas`` has (ref_table, key, reference, existence); a retracted or ended
    row comes as a negative delta.  One pair of numbers is kept per key, in the
    stream's state store, so state grows with the keys and not with the rows.
    Null keys are left out.
    """
    known = deltas.where(F.col("key").isNotNull())
    return known.groupBy("ref_table", "key").agg(F.sum("reference").alias("n_references"), F.sum("existence").alias("n_existing"))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """The keys that are referred to and do not exist."""
    return counts.where("n_references > 0 and n_existing <= 0")
