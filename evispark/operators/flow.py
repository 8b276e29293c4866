"""Participant counts: derived quantities and conflicts between rows of one scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconciled(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """rows plus missing, missing_fraction and conflict.

    ``rows`` has (randomized, observed, unavailable).  missing is randomized -
    observed, else unavailable; its fraction is 0.0 for nobody randomized and
    null where unknown.  A row conflicts if it differs from the first row of
    its scope; conflicting rows stay.
    """
    counts = ["randomized", "observed", "unavailable"]
    w = Window.partitionBy(*scope).orderBy(order)
    missing = F.coalesce(F.col("randomized") - F.col("observed"), F.col("unavailable"))
    fraction = F.when(F.col("randomized") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("missing").cast("double"), F.col("randomized").cast("double")))
    differs = [~F.col(c).eqNullSafe(F.first(c).over(w)) for c in counts]
    return rows.withColumn("missing", missing).withColumn("missing_fraction", fraction).withColumn("conflict", differs[0] | differs[1] | differs[2])


def quantity_conflicts(rows: DataFrame) -> DataFrame:
    """rows plus quantity_conflict; derived counts that more imputed values contradict become null."""
    above = (F.col("imputed") > F.col("unavailable")) | (F.col("imputed") > F.col("randomized")) | (F.col("imputed") > F.col("randomized") - F.col("observed"))
    conflict = F.coalesce(above, F.lit(False))
    return rows.withColumn("quantity_conflict", conflict).withColumn("missing", F.when(~conflict, F.col("missing"))).withColumn("missing_fraction", F.when(~conflict, F.col("missing_fraction")))
