"""One type and one last name for each field."""

import json

from evispark.operators import drift


def test_casts_to_the_main_type(spark):
    payloads = [{"n": 1, "b": True, "s": "x", "l": ["p"]}, {"n": 2, "b": False, "s": "y", "l": ["q"]}, {"n": " 3.5", "b": "slow", "s": {"k": 'a"\\'}, "l": "r"}, {"n": "many", "b": "true", "s": 7, "l": None}]
    records = spark.createDataFrame([(i, "a", "f1", json.dumps(p)) for i, p in enumerate(payloads)], "identity int, kind string, file string, payload string")
    table = {r.identity: r for r in drift.consistent_table(records, ["identity"], drift.alias_table(drift.changes(records))).collect()}
    typed = {i: {k: json.loads(v) for k, v in r.typed.items()} for i, r in table.items()}
    assert typed[0] == payloads[0] and typed[1] == payloads[1]
    assert typed[2].keys() == {"n", "s", "l"} and (typed[2]["n"], typed[2]["l"], json.loads(typed[2]["s"])) == (3.5, ["r"], payloads[2]["s"])
    assert typed[3] == {"b": True, "s": "7"}
    assert {i: r.uncast for i, r in table.items()} == {0: {}, 1: {}, 2: {"b": '"slow"'}, 3: {"n": '"many"'}}
    assert all(r.typed.keys() | r.uncast.keys() == r.fields.keys() for r in table.values())


def test_renames_in_file_order(spark):
    moves = [("f2", "x", "y"), ("f5", "y", "x"), ("f2", "p", "z"), ("f4", "p", "b"), ("f1", "m", "n"), ("f3", "n", "o")]
    changed = spark.createDataFrame([("a", f, old, "renamed", new) for f, old, new in moves], "kind string, export_file string, field string, change string, new_field string")
    assert {(r.field, r.name) for r in drift.alias_table(changed).collect()} == {("y", "x"), ("p", "b"), ("m", "o"), ("n", "o")}
