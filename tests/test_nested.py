"""Nested bodies: labels, tables and leaves against a plain walk."""

import json
from pathlib import Path

import pytest

from evispark.operators import nested
from evispark.queries import general

DATA = "/root/testdata/sf0.001"


def unwrap(text):
    try:
        value = json.loads(text)
        while isinstance(value, str) or "answers" not in value:
            value = json.loads(value) if isinstance(value, str) else next(v for v in value.values() if isinstance(v, (dict, str)) and "answers" in str(v))
        return value
    except ValueError:
        return None


def listed(value):
    return [] if value is None else value if isinstance(value, list) else [value]


def leaves(form, sid, body):
    table = general.SUBMISSIONS[form]
    for a, answer in enumerate(listed(body["answers"])):
        for b, basis in enumerate(listed(answer.get("bases"))):
            if basis.get("evidence") is not None:
                yield table, sid, a, "basis", b, basis["evidence"]
            for holder in (basis, basis.get("limitation") or {}, basis.get("context") or {}):
                if form == "monarch_plus" and holder.get("unresolved_premise") is not None:
                    yield table, sid, a, "premise", b, "0"
        if form == "monarch_plus":
            if answer.get("unresolved_premise") is not None:
                yield table, sid, a, "premise", -1, "0"
            for i, limit in enumerate(listed(answer.get("limitation"))):
                if limit.get("unresolved_premise") is not None:
                    yield table, sid, a, "premise", -1, str(i)
        else:
            for c, counter in enumerate(listed(answer.get("counterevidence"))):
                for index in listed(counter.get("basis_indexes")) if isinstance(counter, dict) else [counter]:
                    yield table, sid, a, "counterpoint", c, str(index)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_leaves_equal_a_plain_walk(spark):
    expected = set()
    for form, table in general.SUBMISSIONS.items():
        for row in spark.read.parquet(f"{DATA}/{table}.parquet").collect():
            if body := unwrap(row.body):
                expected |= set(leaves(form, row.submission_id, body))
    rows = [tuple(r) for r in general.p3_found(spark, DATA).collect()]
    assert len(rows) == len(set(rows))
    assert {(t, s, a, c, n, x) for t, s, a, c, n, x in rows} == expected


def test_labels_parents_and_tables(spark):
    body = {"answers": [{"bases": [{"e": "x"}, {"e": None, "d": {"z": True}}]}, {"bases": {"e": 1.5}}]}
    rows = [(1, json.dumps({"outer": {"submission": json.dumps(body)}, "n": 1})), (1, json.dumps(body)), (2, None), (3, '{"answers": [1'), (4, "[]"), (5, "")]
    tree = nested.nodes(spark.createDataFrame(rows, "id int, text string"), "id", "text", "answers", ("answers[].bases",))
    labels = {r.dewey: (r.schema_path, r.ordinals, r.kind, r.value) for r in tree.where("key = 1").collect()}
    assert labels["0.0.0.0.1.1.0"] == ("answers[].bases[].d.z", [0, 1], "boolean", "true")
    assert labels["0.0.1.0.0.0"] == ("answers[].bases[].e", [1, 0], "number", "1.5")
    assert all(label.rpartition(".")[0] in labels for label in labels if "." in label)
    assert {r.key for r in tree.select("key").distinct().collect()} == {1}
    table = nested.flat_table(tree, "answers[].bases[]", {"e": "e", "z": "d.z"}, steps=2).collect()
    assert {(r.parent, tuple(r.positions), r.e, r.z) for r in table} == {("0.0.0", (0, 0), "x", None), ("0.0.0", (0, 1), None, "true"), ("0.0.1", (1, 0), "1.5", None)}


def test_extremes_do_not_crash(spark):
    deep = '{"answers": [{"text": "t", "more": ' + '{"a": [' * 50_000 + "]}" * 50_000 + "}]}"
    wide = json.dumps({"answers": [{"text": "é" * 100_000}] * 3})
    lone = '{"answers": ["\\ud800"]}'
    rows = [(1, deep, "a"), (2, wide, "b"), (3, lone, None)]
    tree = nested.nodes(spark.createDataFrame(rows, "id int, text string, dewey string"), "id", "text", "answers", only=("answers[].text",))
    assert {(r.key, r.n) for r in tree.groupBy("key").agg({"*": "count"}).toDF("key", "n").collect()} == {(1, 4), (2, 8), (3, 3)}
    assert nested.nodes(spark.createDataFrame([], "id int, text string"), "id", "text", "answers").count() == 0


def test_every_level_of_a_deep_record_has_a_label(spark):
    deep = '{"answers": ' + "[" * 1_200 + "7" + "]" * 1_200 + "}"
    tree = nested.nodes(spark.createDataFrame([(1, deep)], "id int, text string"), "id", "text", "answers")
    last = tree.where("kind = 'number'").collect()
    assert tree.count() == 1_202 and [(r.value, len(r.ordinals), r.dewey.count(".")) for r in last] == [("7", 1_200, 1_201)]


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\u00e9", {}, [], {"b": {"c": [[]]}}]}', " [ ] ", '"x"', "3", '{"a":1,"a":2}'])
def test_the_deep_parser_reads_what_the_plain_one_does(text):
    assert nested._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,", "[1 2]", '{"a" 1}', '{"a":}', "[1]]", '{"a":1,}', "[,]", "{1:2}", "tru", '"x', "01"])
def test_the_deep_parser_refuses_what_the_plain_one_does(text):
    with pytest.raises(ValueError):
        nested._parse_deep(text)
    with pytest.raises(ValueError):
        json.loads(text)


@pytest.mark.parametrize("steps", [17, 40])
def test_bodies_are_unwrapped_to_any_number_of_steps(steps):
    body = {"answers": [1]}
    text = json.dumps(body)
    for i in range(steps):
        text = json.dumps({f"w{i}": json.loads(text), "n": i}) if i % 9 else json.dumps({"text": text})
    assert nested.read_document(text, "answers") == body
    assert nested.read_document('{"a": ' * 30_000 + '{"answers": [1]}' + "}" * 30_000, "answers") == body


def test_names_with_dots_keep_their_own_path():
    paths = [p for _, p, *_ in nested.walk({"a.b": 1, "a": {"b": 2}, "c[]": 3, "c": [4], "d\\": 5}, frozenset())]
    assert len(paths) == len(set(paths)) == 8
