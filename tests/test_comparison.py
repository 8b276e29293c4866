"""Arms, pairs and limits of a comparison against plain loops."""

import random
from collections import Counter, defaultdict

from evispark.operators import comparison

OUTCOME = "attempt_id string, arm_id string, cell_id string, session_id string, prediction string, status string, support string, completion boolean, latency_ms long, cost double, context_bytes long, tool_calls long, draw int, retry_of string"


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(120):
        arm = rng.choice("abc")
        out.append((f"t{i}", arm, f"c{rng.randint(0, 15)}", f"s{arm}{i}", rng.choice(["low", "high"]), rng.choice(["assessed", "assessed", "failed"]), rng.choice(["direct", "none"]), rng.random() < 0.7, rng.choice([None, 5, 9]), 0.5, 10, i % 4, i % 3, f"t{i - 1}" if i % 5 == 4 else None))
    return out


def test_metrics_equal_plain_loops(spark):
    data, labels = rows(1), {f"c{i}": "low" if i % 2 else "high" for i in range(12)}
    df = spark.createDataFrame(data, OUTCOME)
    truth = spark.createDataFrame(list(labels.items()), "cell_id string, label string")
    got = {r.arm_id: r for r in comparison.arm_metrics(df, truth).collect()}
    recall = {(r.arm_id, r.label): (r.n, r.recall) for r in comparison.class_recall(df, truth).collect()}
    for arm in "abc":
        own = [r for r in data if r[1] == arm]
        scored = [r for r in own if r[5] == "assessed" and r[2] in labels]
        m = got[arm]
        assert (m.attempts, m.n_scored, m.n_correct) == (len(own), len(scored), sum(r[4] == labels[r[2]] for r in scored))
        assert abs(m.completion - sum(r[7] for r in own) / len(own)) < 1e-12 and m.cost == 0.5 * len(own) and m.unknown_latency_ms == sum(r[8] is None for r in own)
        assert m.support == dict(Counter(r[6] for r in own)) and m.statuses == dict(Counter(r[5] for r in own))
        for label in ("low", "high"):
            of = [r for r in scored if labels[r[2]] == label]
            assert recall[arm, label] == (len(of), sum(r[4] == label for r in of) / len(of))
    pair = comparison.pair_metrics(df, spark.createDataFrame([("ab", "a", "b")], "id string, left string, right string"), truth, ["cell_id"]).first()
    cells = defaultdict(lambda: ([], []))
    for r in data:
        if r[1] in "ab":
            cells[r[2]]["ab".index(r[1])].append(r[4])
    matched = {c: v for c, v in cells.items() if v[0] and v[1]}
    alone = {c: (v[0][0], v[1][0]) for c, v in matched.items() if len(v[0]) == len(v[1]) == 1}
    assert (pair.matched_cells, pair.ambiguous_cells, pair.same_prediction, pair.different_prediction) == (len(matched), len(matched) - len(alone), sum(x == y for x, y in alone.values()), sum(x != y for x, y in alone.values()))
    assert comparison.arm_metrics(df.limit(0), truth).count() == 0


def test_limits_draws_and_retries(spark):
    data = [*rows(2), ("t0", "a", "c0", "shared", "low", "failed", "none", False, 1, 1.0, 1, 1, 0, None), ("x", "b", "c0", "shared", "low", "failed", "none", False, 1, 1.0, 1, 1, 0, "gone")]
    df = spark.createDataFrame(data, OUTCOME)
    broken = {(r.rule, r.subject) for r in comparison.violations(df, 3, {"attempts": 100, "cost": 1e9, "context_bytes": 5}).collect()}
    many = {("retries", f"{a}|{c}") for (a, c), n in Counter((r[1], r[2]) for r in data).items() if n > 3}
    assert broken == many | {("session", "shared"), ("attempt", "t0"), ("budget", "attempts"), ("budget", "context_bytes")}
    planned = spark.createDataFrame([("a", "c0", d) for d in range(6)], "arm_id string, cell_id string, draw int")
    assert {r.draw for r in comparison.missing_draws(df, planned).collect()} == set(range(6)) - {r[12] for r in data if r[1] == "a" and r[2] == "c0"}
    lineage = {r.attempt_id: (r.root, r.depth, r.state) for r in comparison.retry_lineage(df).collect()}
    assert lineage["t4"] == ("t3", 1, "rooted") and lineage["x"] == ("x", 0, "orphan")
