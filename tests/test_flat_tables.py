"""The flat tables of the submissions hold every path of both forms."""

import json
from collections import Counter

from evispark.operators import nested
from evispark.queries import general

BODIES = {
    "monarch_plus": {
        "trial_id": "t1", "domain_id": "d1", "expected_revision": 7,
        "answers": [
            {"question_id": "q", "unresolved_premise": "own", "stopping_rationale": "read", "unknowns": ["u0", "u1"], "counterevidence": [1, 0], "bases": [
                {"evidence": "e", "unresolved_premise": "b", "stopping_rationale": "bs"}, {"limitation": {"unresolved_premise": "bl", "stopping_rationale": "bls"}, "context": {"stopping_rationale": "bc"}},
            ]},
            {"question_id": "r", "limitation": {"unresolved_premise": "l0"}, "unresolved_premise": None},
            {"question_id": "s", "limitation": [{"stopping_rationale": "l0"}, {"unresolved_premise": None}]},
        ],
    },
    "an_d2": {"trial_id": "t2", "domain_id": "d2", "expected_revision": 8, "answers": [
        {"limitations": [{"premise": "p0", "stopping_rationale": "s0"}, {"premise": "p1"}], "unknowns": [], "counterevidence": [{"implication": "i", "basis_indexes": [2, 1]}, 3]},
    ]},
}


def stored(spark, folder):
    for form, table in general.SUBMISSIONS.items():
        rows = [(1, json.dumps({"submission": BODIES[form]})), (1, json.dumps({"submission": BODIES[form]})), (2, '{"answers": [')]
        spark.createDataFrame(rows, "submission_id long, body string").write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_every_path_stands_in_a_table(spark, tmp_path):
    sf, (plus, d2) = stored(spark, tmp_path), general.SUBMISSIONS.values()
    rows = lambda query, *columns: Counter(tuple(r[c] for c in columns) for r in query(spark, sf).collect())
    assert rows(general.p3_submissions, "record_table", "submission_id", "dewey", "trial_id", "domain_id", "expected_revision") == Counter([(plus, 1, "0", "t1", "d1", 7), (d2, 1, "0", "t2", "d2", 8)])
    place = ("record_table", "answer_no", "basis_no", "limitation_no", "unresolved_premise", "premise", "stopping_rationale")
    assert rows(general.p3_limitations, *place) == Counter([
        (plus, 0, None, None, "own", None, "read"), (plus, 0, 0, None, "b", None, "bs"), (plus, 0, 1, 0, "bl", None, "bls"), (plus, 0, 1, 0, None, None, "bc"),
        (plus, 1, None, 0, "l0", None, None), (plus, 2, None, 0, None, None, "l0"), (plus, 2, None, 1, None, None, None),
        (d2, 0, None, 0, None, "p0", "s0"), (d2, 0, None, 1, None, "p1", None),
    ])
    assert rows(general.p3_unknowns, "record_table", "answer_no", "unknown_no", "unknown") == Counter([(plus, 0, 0, "u0"), (plus, 0, 1, "u1")])
    found = {(r.record_table, r.counterpoint_no): (r.implication, r.basis_indexes) for r in general.p3_counterpoints(spark, sf).collect()}
    assert found == {(plus, 0): (None, ["1"]), (plus, 1): (None, ["0"]), (d2, 0): ("i", ["2", "1"]), (d2, 1): (None, ["3"])}
    assert ("own", "read") in rows(general.p3_answers, "unresolved_premise", "stopping_rationale")


def test_children_name_their_parents(spark, tmp_path):
    sf = stored(spark, tmp_path)
    parents = {(r.record_table, r.dewey) for query in (general.p3_answers, general.p3_bases) for r in query(spark, sf).collect()}
    for query in (general.p3_limitations, general.p3_counterpoints, general.p3_unknowns):
        assert {(r.record_table, r.parent) for r in query(spark, sf).collect()} <= parents


def test_bodies_are_unwrapped_to_any_number_of_steps():
    body = {"answers": [1]}
    wrapped: object = body
    for step in range(60):
        wrapped = {"submission": wrapped} if step % 20 else {"submission": json.dumps(wrapped)}
    assert nested.read_document(json.dumps(wrapped), "answers") == body
    assert nested.read_document(json.dumps({"a": {"b": {"c": 1}}}), "answers") is None
    assert nested.read_document('"1"', "answers") is None
