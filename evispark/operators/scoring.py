"""Evaluation scoring: rates, confusion, baselines, pairs, draws, novelty, intervals by resampling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.plans import rows_up_to

def rate(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def nullable_rate(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(label, prediction, n): every pair of the labels' and predictions' sorted union, zeros included."""
    counts = pairs.where("label is not null and prediction is not null").groupBy("label", "prediction").agg(F.count("*").alias("n"))
    names = counts.select(F.col("label").alias("x")).union(counts.select("prediction")).distinct()
    return names.withColumnRenamed("x", "label").crossJoin(F.broadcast(names.withColumnRenamed("x", "prediction"))).join(counts, ["label", "prediction"], "left").fillna(0, ["n"])  # classes only


def agreement(pairs: DataFrame) -> DataFrame:
    """One row (n, correct, accuracy, balanced_accuracy): balanced is the mean recall over labels with support."""
    by_label = pairs.where("label is not null and prediction is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("hits"))
    return by_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("correct"),
        rate(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"),
    )


def baselines(pairs: DataFrame, always: str) -> DataFrame:
    """One row (majority, majority_share, always_share): the most frequent label (the larger of equals) and a fixed guess."""
    counts = pairs.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(
        F.max_by("label", F.struct("n", "label")).alias("majority"),
        (F.max("n") / F.sum("n")).alias("majority_share"),
        (F.coalesce(F.sum(F.when(F.col("label") == always, F.col("n"))), F.lit(0)) / F.sum("n")).alias("always_share"),
    )


def ordinal(column: Column, order: list[str]) -> Column:
    """The step of a label in an ordered list, from 0; null for others."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place > 0, place - 1)


def ordinal_errors(pairs: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Per group: exact hits, over- and undercalls and their steps."""
    step = ordinal(F.col("prediction"), order) - ordinal(F.col("label"), order)
    return pairs.withColumn("step", step).groupBy(*keys).agg(
        F.count("step").alias("n"), F.count_if(F.col("step") == 0).alias("exact"),
        F.count_if(F.col("step") > 0).alias("overcalls"), F.coalesce(F.sum(F.when(F.col("step") > 0, F.col("step"))), F.lit(0)).alias("over_steps"),
        F.count_if(F.col("step") < 0).alias("undercalls"), F.coalesce(F.sum(F.when(F.col("step") < 0, -F.col("step"))), F.lit(0)).alias("under_steps"),
    )


def selected_attempts(attempts: DataFrame, cell: list[str], attempt: str) -> DataFrame:
    """The lowest attempt of each cell."""
    return attempts.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy(attempt))).where("place = 1").drop("place")


def dispositions(planned: DataFrame, observed: DataFrame, cell: list[str], column: str) -> DataFrame:
    """Planned cells with what was observed, 'missing' where nothing was."""
    return planned.select(*cell).join(observed.select(*cell, column), cell, "left").withColumn(column, F.coalesce(column, F.lit("missing")))


def unambiguous_pairs(left: DataFrame, right: DataFrame, cell: list[str]) -> DataFrame:
    """Cells that stand exactly once on either side, with both values."""
    once = lambda df, name: df.groupBy(*cell).agg(F.count("*").alias("n"), F.min("value").alias(name)).where("n = 1").drop("n")
    return once(left, "left_value").join(once(right, "right_value"), cell)


def paired_change(pairs: DataFrame, group: list[str], within: list[str]) -> DataFrame:
    """The mean per group of the mean right minus left within."""
    inner = pairs.groupBy(*group, *within).agg(F.avg(F.col("right_value") - F.col("left_value")).alias("d"))
    return inner.groupBy(*group).agg(F.avg("d").alias("change"), F.count("*").alias("n_clusters"))


def draws(rows: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, n_draws, any_correct, all_correct) over the draws of a cell."""
    return rows.groupBy(*cell).agg(F.count("*").alias("n_draws"), F.bool_or("correct").alias("any_correct"), F.bool_and("correct").alias("all_correct"))


def novelty(queries: DataFrame, cell: list[str], order: str) -> DataFrame:
    """(cell, order, repeats, n_results, n_novel, n_overlap) of queries with (query_hash, result_ids), in order.

    A result is novel where it first stands in its cell, otherwise it overlaps;
    a query repeats if its hash stood before.
    """
    again = F.row_number().over(Window.partitionBy(*cell, "query_hash").orderBy(order)) > 1
    each = queries.select(*cell, order, F.explode(F.array_distinct("result_ids")).alias("id"))
    first = each.groupBy(*cell, "id").agg(F.min(order).alias("first"))
    counts = each.join(first, [*cell, "id"]).groupBy(*cell, order).agg(F.count("*").alias("n_results"), F.count_if(F.col(order) == F.col("first")).alias("n_novel"))
    joined = queries.withColumn("repeats", again).select(*cell, order, "repeats").join(counts, [*cell, order], "left").fillna(0, ["n_results", "n_novel"])
    return joined.withColumn("n_overlap", F.col("n_results") - F.col("n_novel"))


def evidence_sets(options: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, state): 'complete' if all of some acceptable set was found, 'partial' if any of it, else 'none'.

    ``options`` has (key, option, identity), ``found`` (key, identity).
    """
    have = found.select(*key, "identity").distinct().withColumn("have", F.lit(1))
    per = options.join(have, [*key, "identity"], "left").groupBy(*key, "option").agg(F.count("*").alias("n"), F.count("have").alias("h"))
    return per.groupBy(*key).agg(F.when(F.bool_or(F.col("n") == F.col("h")), "complete").when(F.max("h") > 0, "partial").otherwise("none").alias("state"))


def stage_funnel(events: DataFrame) -> DataFrame:
    """Per stage: known and unknown observations, observed ones and their rate; unknown is not zero."""
    known = F.col("observed").isNotNull()
    grouped = events.groupBy("stage").agg(F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"), F.count_if(F.col("observed")).alias("observed"))
    return grouped.withColumn("observed_rate", rate(F.col("observed"), F.col("known")))


def exact_vectors(labels: DataFrame, cell: list[str], parts: int) -> DataFrame:
    """(cell, vector) of cells with all ``parts`` parts, labels in part order joined by ' | '."""
    grouped = labels.groupBy(*cell).agg(F.sort_array(F.collect_set(F.struct("part", "label"))).alias("v"))
    return grouped.where(F.size("v") == parts).select(*cell, F.array_join(F.transform("v", lambda s: s["label"]), " | ").alias("vector"))


def earliest_missing(rows: DataFrame, stages: list[str]) -> Column:
    """The name of the first stage column that is not true, null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in stages])


def not_worse(pairs: DataFrame) -> Column:
    """Whether n/d of the right side is at least that of the left, by whole numbers; false for zero denominators."""
    return (F.col("right_d") > 0) & (F.col("left_d") > 0) & (F.col("right_n") * F.col("left_d") >= F.col("left_n") * F.col("right_d"))


#: most clusters whose draws one task makes in order
CLUSTERS = 100_000


def cluster_interval(clusters: DataFrame, seed: int, replicates: int = 2000) -> DataFrame:
    """One row (low, high, n_clusters): 95 % interval of sum(n) / sum(d), drawing whole clusters with replacement.

    ``clusters`` has (cluster, n, d), one row per cluster.  The draws are those
    of Python's generator with ``seed``, cluster after cluster in the order of
    their names, so the result can be reproduced anywhere; as each draw depends
    on those before, one task makes them, for at most ``CLUSTERS`` clusters (a
    larger table raises ValueError, see ``poisson_interval``).  Replicates
    without a denominator are left out; null for fewer than two clusters, no row
    for an empty table.
    """
    if rows_up_to(clusters, CLUSTERS) > CLUSTERS:
        raise ValueError("too many clusters for draws in order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(n or 0, d or 0) for batch in batches for n, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        rng, ratios = random.Random(seed), []
        for _ in range(replicates if len(rows) >= 2 else 0):
            drawn = [rng.choice(rows) for _ in rows]
            if whole := sum(d for _, d in drawn):
                ratios.append(sum(n for n, _ in drawn) / whole)
        low, high = (linear_percentile(sorted(ratios), p) for p in (0.025, 0.975)) if ratios else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.float64()), pa.array([high], pa.float64()), pa.array([len(rows)], pa.int64())], ["low", "high", "n_clusters"])

    once = clusters.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return once.coalesce(1).sortWithinPartitions("cluster").mapInArrow(run, "low double, high double, n_clusters long").where("n_clusters > 0")  # an empty table may have a task or none


def linear_percentile(values: list[float], share: float) -> float:
    """The percentile of sorted values with linear interpolation."""
    place = (len(values) - 1) * share
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] * (1 - (place - low)) + values[high] * (place - low)


def poisson_interval(clusters: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """One row (low, high, n_clusters): 95 % interval of sum(n) / sum(d), resampling whole clusters.

    ``clusters`` has (n, d), one row per cluster.  Each cluster draws how often
    it stands in each replicate (a Poisson(1) count by hash, which resamples
    without knowing the number of clusters), so replicates are sums that
    combine map-side.  Null for fewer than two clusters.
    """
    pick = F.pmod(F.xxhash64("cluster", "replicate", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    times = sum(((pick >= s).cast("int") for s in steps), F.lit(0))
    drawn = clusters.select("cluster", "n", "d", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("times", times)
    ratios = drawn.groupBy("replicate").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("d") * F.col("times")).alias("d")).select(F.try_divide(F.col("n").cast("double"), F.col("d").cast("double")).alias("ratio"))
    bounds = ratios.agg(F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    size = clusters.agg(F.count("*").alias("n_clusters"))
    kept = F.col("n_clusters") >= 2
    return bounds.crossJoin(size).select(F.when(kept, F.col("p")[0]).alias("low"), F.when(kept, F.col("p")[1]).alias("high"), "n_clusters")  # one row each
