"""Orphan references against a plain loop over all rows."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evispark.operators.orphans import SLICE, orphan_counts, orphan_references, signed_deltas

T0 = datetime(2031, 1, 1)
REF = "ref_table string, ref_key string, ref_no long, key string, t timestamp"
TARGET = "ref_table string, key string, started_at timestamp, ended_at timestamp"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def expected(refs, targets):
    out = set()
    for table, ref_key, no, key, t in refs:
        if key is None:
            continue
        own = [(s, e) for tt, k, s, e in targets if tt == table and k == key]
        if not own:
            out.add((ref_key, no, "missing"))
        elif t is not None and not any(s is not None and s <= t and (e is None or t < e) for s, e in own):
            out.add((ref_key, no, "deleted" if any(s is not None and s <= t for s, _ in own) else "late"))
    return out


def found(spark, refs, targets, bucket="day", slice_rows=SLICE):
    rows = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), bucket, slice_rows).collect()
    assert len(rows) == len({(r.ref_key, r.ref_no) for r in rows})
    return {(r.ref_key, r.ref_no, r.status) for r in rows}


def test_each_status_and_edge(spark):
    targets = [("a", "k", at(0), at(10)), ("a", "k", at(50), None), ("a", "zero", at(5), at(5)), ("a", "none", None, None), ("b", "k", at(0), None)]
    refs = [("a", f"r{h}", 1, "k", at(h)) for h in (-1, 0, 9, 10, 49, 50, 99)]
    refs += [("a", "gone", 1, "nowhere", at(1)), ("a", "null", 1, None, at(1)), ("a", "zero", 1, "zero", at(6)), ("a", "none", 1, "none", at(6)), ("a", "timeless", 1, "k", None), ("a", "timeless", 2, "nowhere", None)]
    assert found(spark, refs, targets) == expected(refs, targets) == {
        ("r-1", 1, "late"), ("r10", 1, "deleted"), ("r49", 1, "deleted"), ("gone", 1, "missing"), ("zero", 1, "deleted"), ("none", 1, "late"), ("timeless", 2, "missing"),
    }


hour = st.integers(0, 60)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["h", "h", "h", "x", None]), st.one_of(st.none(), hour)), min_size=1, max_size=30),
    st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("hy"), hour, st.one_of(st.none(), hour)), max_size=12),
)
def test_random_rows_with_a_hot_key(spark, refs, targets):
    refs = [(table, f"r{i}", i, key, at(h)) for i, (table, key, h) in enumerate(refs)]
    targets = [(table, key, at(s), at(e)) for table, key, s, e in targets]
    assert found(spark, refs, targets, "hour") == expected(refs, targets)
    assert found(spark, refs, targets, "day", 2) == expected(refs, targets)


def test_a_key_with_half_of_a_day_is_sliced(spark):
    """No window holds more than a slice, whatever share of the rows one key and day has."""
    refs = [("a", f"r{i}", i, "hot" if i % 2 else f"k{i}", at((i % 24) / 2)) for i in range(4000)]
    targets = [("a", "hot", at(3), at(6)), ("a", "hot", at(8), None), ("a", "k2", at(0), None)]
    assert found(spark, refs, targets, "day", 100) == expected(refs, targets)
    plan = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), "day", 100)
    assert "slice" in plan._jdf.queryExecution().toString()


def test_current_orphans_come_from_signed_counts(spark):
    from evispark.streaming.counts import orphan_counts as kept
    from evispark.streaming.counts import orphan_keys

    refs = [("a", "r", 1, "gone", at(1)), ("a", "r", 2, "gone", at(2)), ("a", "r", 3, "here", at(1)), ("a", "r", 4, "nowhere", at(1)), ("a", "r", 5, None, at(1))]
    targets = [("a", "gone", at(0), at(5)), ("a", "here", at(9), None), ("a", "unasked", at(0), at(1))]
    deltas = signed_deltas(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET))
    assert {(r.key, r.n_references, r.n_existing) for r in orphan_keys(kept(deltas)).collect()} == {("gone", 2, 0), ("nowhere", 1, 0)}


def test_empty_tables_and_clashing_columns(spark):
    refs = spark.createDataFrame([("a", "r", 1, "k", at(0), 9)], REF + ", live int")
    none = spark.createDataFrame([], TARGET)
    assert [r.status for r in orphan_references(refs, none).collect()] == ["missing"]
    assert orphan_references(spark.createDataFrame([], REF), none).count() == 0
    assert orphan_counts(orphan_references(refs, none)).collect()[0].n == 1


@pytest.mark.parametrize("spelling", [" K ", "k", "K\t"])
def test_identities_compare_without_blanks_and_case(spark, spelling):
    from pyspark.sql import functions as F

    from evispark.operators.orphans import normal_identity

    assert spark.createDataFrame([(spelling,)], "s string").select(normal_identity(F.col("s"))).collect()[0][0] == "k"
