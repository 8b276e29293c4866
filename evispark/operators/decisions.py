"""First-match decision tables over answers, as columns.

A table is data: ordered rules, each with a label, a name and the answer sets
that make it fire.  One CASE expression evaluates a table, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO, NI = ("yes", "probably_yes"), ("no", "probably_no"), ("no_information",)
NOU, YU = NO + NI, YES + NI
ANSWERS = ("yes", "probably_yes", "probably_no", "no", "no_information")
LEVELS = ("low", "some_concerns", "high")

# When a question is asked.  Each entry: question -> (any or all, {question: answers}).
ACTIVE = {
    "context-deviations": ("any", {"participants-aware": YU, "personnel-aware": YU}),
    "affected-outcome": ("any", {"context-deviations": YES}),
    "balanced": ("any", {"affected-outcome": YU}),
    "substantial-impact": ("any", {"appropriate-analysis": NOU}),
    "evidence-unbiased": ("any", {"data-available": NOU}),
    "true-value-dependent": ("any", {"evidence-unbiased": NO}),
    "likely-dependent": ("any", {"true-value-dependent": YU}),
    "assessor-aware": ("all", {"method-inappropriate": NOU, "differential": NOU}),
    "influence-possible": ("any", {"assessor-aware": YU}),
    "influence-likely": ("any", {"influence-possible": YU}),
}

# The rules of each domain, first match wins.  (label, rule, any or all, {question: answers})
TABLES = {
    "randomization": [
        ("high", "concealment_failed", "all", {"concealment": NO}),
        ("high", "unknown_concealment_and_imbalance", "all", {"concealment": NI, "baseline-imbalance": YES}),
        ("some_concerns", "some_concerns", "any", {"sequence": NO, "concealment": NI, "baseline-imbalance": YES}),
        ("low", "low", "all", {}),
    ],
    "deviations": [
        ("high", "unbalanced_impact", "all", {"context-deviations": YES, "affected-outcome": YU, "balanced": NOU}),
        ("high", "analysis_substantial_impact", "all", {"appropriate-analysis": NOU, "substantial-impact": YU}),
        ("some_concerns", "some_concerns", "any", {"context-deviations": NI, "affected-outcome": NO, "balanced": YES, "substantial-impact": NO}),
        ("low", "low", "all", {}),
    ],
    "missing": [
        ("low", "low", "any", {"data-available": YES, "evidence-unbiased": YES, "true-value-dependent": NO}),
        ("high", "likely_dependent", "all", {"likely-dependent": YU}),
        ("some_concerns", "some_concerns", "all", {}),
    ],
    "measurement": [
        ("high", "inappropriate_or_differential", "any", {"method-inappropriate": YES, "differential": YES}),
        ("high", "likely_influenced", "all", {"influence-likely": YU}),
        ("some_concerns", "some_concerns", "any", {"differential": NI, "influence-likely": NO}),
        ("low", "low", "all", {}),
    ],
    "selection": [
        ("high", "selective_choice", "any", {"measurements": YES, "analyses": YES}),
        ("some_concerns", "some_concerns", "any", {"prespecified": NOU, "measurements": NI, "analyses": NI}),
        ("low", "low", "all", {}),
    ],
}


def _fires(how: str, sets: dict[str, tuple[str, ...]], answer) -> Column:
    parts = [F.coalesce(answer(q).isin(*allowed), F.lit(False)) for q, allowed in sets.items()]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a | b, parts) if how == "any" else reduce(lambda a, b: a & b, parts)


def judged(rows: DataFrame, table: list, columns: dict[str, str] | None = None) -> DataFrame:
    """rows plus judgement, rule and drivers, by a table of rules.

    ``columns`` maps a question to its answer column (the question's name by
    default).  drivers are the questions of the rule that held, in its order.
    A missing answer makes no condition true.
    """
    answer = lambda q: F.col(f"`{(columns or {}).get(q, q)}`")
    label = rule = drivers = None
    for name, title, how, sets in table:
        on = _fires(how, sets, answer)
        own = F.array_compact(F.array(*[F.when(answer(q).isin(*allowed), F.lit(q)) for q, allowed in sets.items()])) if sets else F.array().cast("array<string>")
        label = F.when(on, name) if label is None else label.when(on, name)
        rule = F.when(on, title) if rule is None else rule.when(on, title)
        drivers = F.when(on, own) if drivers is None else drivers.when(on, own)
    return rows.withColumns({"judgement": label, "rule": rule, "drivers": drivers})


def active(rows: DataFrame, questions: list[str]) -> DataFrame:
    """rows plus ``active``: the questions that are asked, each after those it depends on."""
    on: dict[str, Column] = {}
    for q in questions:
        how, sets = ACTIVE.get(q, ("all", {}))
        parts = [on.get(p, F.lit(True)) & F.coalesce(F.col(f"`{p}`").isin(*allowed), F.lit(False)) for p, allowed in sets.items()]
        on[q] = reduce((lambda a, b: a | b) if how == "any" else (lambda a, b: a & b), parts) if parts else F.lit(True)
    return rows.withColumn("active", F.array_compact(F.array(*[F.when(c, F.lit(q)) for q, c in on.items()])))


def overall(judgements: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, overall, n_some): the worst of exactly ``parts`` judgements; groups with other numbers leave."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("judgement"))
    grouped = judgements.groupBy(*keys).agg(F.max(level).alias("worst"), F.count("*").alias("n"), F.count_if(F.col("judgement") == "some_concerns").alias("n_some"))
    return grouped.where(F.col("n") == parts).select(*keys, F.element_at(F.array(*map(F.lit, LEVELS)), F.col("worst").cast("int")).alias("overall"), "n_some")


def cumulative(rows: DataFrame, many: int = 2) -> DataFrame:
    """overall with ``many`` or more some-concerns parts counted as high."""
    return rows.withColumn("overall", F.when((F.col("overall") == "some_concerns") & (F.col("n_some") >= many), "high").otherwise(F.col("overall")))


def counterfactuals(rows: DataFrame, question: str, table: list, columns: dict[str, str] | None = None) -> DataFrame:
    """Each row whose answer is 'no_information', judged with the answer probably yes and probably no, and whether that matters."""
    name = (columns or {}).get(question, question)
    open_rows = rows.where(F.col(f"`{name}`") == "no_information")
    tried = open_rows.withColumn(name, F.explode(F.array(F.lit("probably_yes"), F.lit("probably_no"))))
    before = judged(open_rows, table, columns).select("row_id", F.col("judgement").alias("now"))
    return judged(tried, table, columns).join(before, "row_id").groupBy("row_id", "now").agg(F.when(F.bool_or(F.col("judgement") != F.col("now")), "sensitive").otherwise("stable").alias("stability"))


def sufficiency(bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sufficiency) by the strongest kind of basis: contradiction, limitation, absence, indirect, direct."""
    kinds = ["contradiction", "limitation", "absence", "indirect_support", "direct_support"]
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    best = bases.where(place > 0).groupBy(*keys).agg(F.min(place).alias("p"))
    return best.select(*keys, F.element_at(F.array(*map(F.lit, kinds)), F.col("p").cast("int")).alias("sufficiency"))
