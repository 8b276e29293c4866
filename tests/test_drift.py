"""Schema drift against a plain comparison of consecutive files."""

import json
from collections import defaultdict
from pathlib import Path

import pytest

from evispark.operators import drift
from evispark.queries import general

DATA = "/root/testdata/sf0.001"


def json_type(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]


def plain(rows):
    """(kind, file, payload text) rows to changes."""
    files, types, values = defaultdict(set), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for kind, file, payload in rows:
        files[kind].add(file)
        try:
            record = json.loads(payload)
        except (ValueError, TypeError):
            continue
        if not isinstance(record, dict):
            continue
        for field, v in record.items():
            if v is not None:
                types[kind, file, field][json_type(v)] += 1
                values[kind, file, field].add(json.dumps(v, sort_keys=True))
    out = set()
    for kind, names in files.items():
        ordered = sorted(names)
        for before, after in zip(ordered, ordered[1:]):
            fields = [{f: max(sorted(t), key=t.get) for (k, n, f), t in types.items() if (k, n) == (kind, name)} for name in (before, after)]
            gone, new = set(fields[0]) - set(fields[1]), set(fields[1]) - set(fields[0])
            out |= {(kind, after, f, "retyped", "") for f in fields[0].keys() & fields[1].keys() if fields[0][f] != fields[1][f]}
            ranked = []
            for o in gone:
                for n in new:
                    if fields[0][o] == fields[1][n]:
                        own = values[kind, after, n]
                        old = set().union(*(values[kind, f, o] for f in ordered if f < after))
                        if len(own & old) * 2 >= len(own):
                            ranked.append((-len(own & old) / len(own), o, n))
            for _, o, n in sorted(ranked):
                if o in gone and n in new:
                    out.add((kind, after, o, "renamed", n))
                    gone.discard(o)
                    new.discard(n)
            out |= {(kind, after, f, "removed", "") for f in gone} | {(kind, after, f, "added", "") for f in new}
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_changes_equal_a_plain_comparison(spark, scale):
    records = general._payloads(spark, f"/root/testdata/sf{scale}")
    expected = plain([(r.kind, r.file, r.payload) for r in records.collect()])
    rows = [tuple(r) for r in drift.changes(records).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected
    assert {"added", "removed", "renamed", "retyped"} <= {r[3] for r in rows}


def rows(spark, data):
    return spark.createDataFrame([(str(i), k, f, p, "x") for i, (k, f, p) in enumerate(data)], "identity string, kind string, file string, payload string, field string")


def test_small_cases(spark):
    data = [
        ("a", "f1", '{"x": 1, "old": "p", "t": 1, "gone": true}'), ("a", "f1", '{"old": "q", "bad": '), ("a", "f1", None), ("a", "f1", "[1]"),
        ("a", "f2", '{"x": 2, "fresh": "p", "t": "1", "n": null}'), ("a", "f2", '{"x": 2, "fresh": "p", "t": "1"}'),
        ("a", "f3", '{"x": 2, "fresh": "z", "t": "1", "gone": true}'), (None, "f1", '{"x": 1}'), ("b", "f1", '{"only": {"k": 1}}'),
    ]
    found = {tuple(r) for r in drift.changes(rows(spark, data)).collect()}
    assert found == {
        ("a", "f2", "old", "renamed", "fresh"), ("a", "f2", "t", "retyped", ""), ("a", "f2", "gone", "removed", ""), ("a", "f3", "gone", "added", ""),
    }
    assert drift.changes(rows(spark, []).where("kind = 'z'")).count() == 0


def test_consistent_table(spark):
    data = [("a", "f1", '{"old": "p", "t": 1}'), ("a", "f2", '{"fresh": "p", "t": "1"}'), ("a", "f2", '{"fresh'), ("a", "f3", '{"fresh": null}'), ("a", "f3", '{"fresh": "q"}')]
    records = rows(spark, data)
    aliases = drift.alias_table(drift.changes(records))
    assert [tuple(r) for r in aliases.collect()] == [("a", "old", "fresh")]
    table = {r.identity: (r.readable, r.fields) for r in drift.consistent_table(records.select("identity", "kind", "file", "payload"), ["identity"], aliases).collect()}
    assert table == {"0": (True, {"fresh": '"p"', "t": "1"}), "1": (True, {"fresh": '"p"', "t": '"1"'}), "2": (False, {}), "3": (True, {}), "4": (True, {"fresh": '"q"'})}
