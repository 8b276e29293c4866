"""Comparison of arms: retained attempts, scores per arm and pair, missing draws, retry lineage and limits.

``outcomes`` has one row per attempt: (attempt_id, arm_id, cell_id, session_id,
prediction, status, support, completion, latency_ms, cost, context_bytes,
tool_calls), and where draws were planned (platform_id, draw).  ``labels`` has
(cell_id, label).  Every attempt counts, failures included; nothing chooses a
winner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.scoring import nullable_rate

TOTALS = ("latency_ms", "cost", "context_bytes", "tool_calls")


def _count_map(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(value))  # one entry per distinct value


def arm_metrics(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per arm: attempts, completion, accuracy, support, statuses and totals; a total that is unknown for an attempt counts as unknown there.

    Accuracy is over the assessed attempts of labelled cells, null if there are
    none.  ``unknown_<total>`` says how many attempts do not state it.
    """
    truth = labels.groupBy("cell_id").agg(F.min("label").alias("label"))
    rows = outcomes.join(truth, "cell_id", "left").withColumn("scored", (F.col("status") == "assessed") & F.col("label").isNotNull())
    main = rows.groupBy("arm_id").agg(
        F.count("*").alias("attempts"), F.count_if("completion").alias("completed"), F.count_if("scored").alias("n_scored"), F.count_if(F.col("scored") & (F.col("prediction") == F.col("label"))).alias("n_correct"),
        *[F.sum(c).alias(c) for c in TOTALS], *[F.count_if(F.col(c).isNull()).alias(f"unknown_{c}") for c in TOTALS],
    )
    scored = main.withColumn("completion", nullable_rate(F.col("completed"), F.col("attempts"))).withColumn("accuracy", nullable_rate(F.col("n_correct"), F.col("n_scored")))
    return scored.join(_count_map(rows, ["arm_id"], "support"), "arm_id").join(_count_map(rows, ["arm_id"], "status").withColumnRenamed("status", "statuses"), "arm_id").drop("completed")


def class_recall(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """(arm_id, label, n, recall): per arm, the share of the assessed attempts of each label that predict it."""
    rows = outcomes.where("status = 'assessed'").join(labels.groupBy("cell_id").agg(F.min("label").alias("label")), "cell_id")
    return rows.groupBy("arm_id", "label").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("recall"))


def pair_metrics(outcomes: DataFrame, pairs: DataFrame, labels: DataFrame, cell: list[str]) -> DataFrame:
    """One row per pair of arms (id, left, right): cells that both have, those with several attempts, equal and different predictions, accuracies.

    ``cell`` names what is matched: the cell, or the cell with platform and
    draw.  A cell with more than one attempt on either side is ambiguous and is
    not compared.  Cells are counted per arm before they meet, so a cell with
    many attempts is one row.
    """
    once = outcomes.groupBy("arm_id", *cell).agg(F.count("*").alias("n"), F.min("prediction").alias("prediction"))
    side = lambda name: once.select(F.col("arm_id").alias(name), *cell, F.col("n").alias(f"n_{name}"), F.col("prediction").alias(f"p_{name}"))
    met = pairs.select("id", "left", "right").join(side("left"), "left").join(side("right"), ["right", *cell]).join(labels.groupBy("cell_id").agg(F.min("label").alias("label")), "cell_id", "left")
    alone = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    same = F.col("p_left") == F.col("p_right")
    known = alone & F.col("label").isNotNull()
    counts = met.groupBy("id", "left", "right").agg(
        F.count("*").alias("matched_cells"), F.count_if(~alone).alias("ambiguous_cells"), F.count_if(alone & same).alias("same_prediction"), F.count_if(alone & ~same).alias("different_prediction"),
        F.count_if(known).alias("n_labelled"), *[F.count_if(known & (F.col(f"p_{x}") == F.col("label"))).alias(f"{x}_correct") for x in ("left", "right")],
    )
    return counts.select("id", "left", "right", "matched_cells", "ambiguous_cells", "same_prediction", "different_prediction", *[nullable_rate(F.col(f"{x}_correct"), F.col("n_labelled")).alias(f"{x}_accuracy") for x in ("left", "right")])


def violations(outcomes: DataFrame, max_attempts: int, limits: dict[str, float]) -> DataFrame:
    """(rule, subject): broken rules of a comparison as rows.

    'retries': a cell of an arm has more than ``max_attempts`` attempts;
    'session': a session serves more than one arm; 'attempt': an attempt id
    stands twice; 'budget': the total of a column of ``limits`` (or 'attempts')
    is exceeded.
    """
    retries = outcomes.groupBy("arm_id", "cell_id").agg(F.count("*").alias("n")).where(F.col("n") > max_attempts).select(F.lit("retries").alias("rule"), F.concat_ws("|", "arm_id", "cell_id").alias("subject"))
    session = outcomes.groupBy("session_id").agg(F.min("arm_id").alias("a"), F.max("arm_id").alias("z")).where("a <> z").select(F.lit("session").alias("rule"), F.col("session_id").alias("subject"))
    attempt = outcomes.groupBy("attempt_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("attempt").alias("rule"), F.col("attempt_id").alias("subject"))
    totals = outcomes.agg(F.count("*").alias("attempts"), *[F.sum(c).alias(c) for c in limits if c != "attempts"])  # one row
    over = totals.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) > most, F.lit(c)) for c, most in limits.items()]))).alias("subject")).select(F.lit("budget").alias("rule"), "subject")
    return retries.unionByName(session).unionByName(attempt).unionByName(over)


def missing_draws(outcomes: DataFrame, planned: DataFrame) -> DataFrame:
    """(arm_id, cell_id, draw): planned draws of which no attempt came."""
    return planned.join(outcomes.select("arm_id", "cell_id", "draw").distinct(), ["arm_id", "cell_id", "draw"], "left_anti")


def retry_lineage(outcomes: DataFrame) -> DataFrame:
    """(attempt_id, root, depth, state): the first attempt behind each retry and how many retries lie between."""
    from evispark.operators.lineage import chains

    return chains(outcomes, "attempt_id", "retry_of")
