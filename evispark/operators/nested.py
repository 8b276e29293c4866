"""Deeply nested semi-structured records as related flat tables.

Each JSON document becomes a set of nodes with a Dewey label: the ordinals on
the way from the root, joined by dots.  The parent of a node is its label
without the last ordinal.  Nodes that share a schema path form one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: about the characters of the nodes in one batch
_BATCH_BYTES = 16 << 20
NODE_FIELDS = "dewey string, schema_path string, ordinals array<int>, kind string, value string"


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


_GAP = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse_json(text: str) -> object:
    """A JSON text of any depth as Python values; ValueError if it is not complete JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """As ``json.loads``, with the open objects and lists on a list instead of the call stack."""
    open_: list[tuple[dict | list, str | None]] = []  # containers with the key that is being filled
    at = _GAP.match(text, 0).end()
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            inner: dict | list = {} if c == "{" else []
            at = _GAP.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key, at = _key(text, at) if c == "{" else (None, at)
                open_.append((inner, key))
                continue
            value, at = inner, at + 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            whole, fraction, power = m.groups()
            value = _WORDS[m.group()] if whole is None else int(whole) if fraction is None and power is None else float(m.group())
            at = m.end()
        else:
            raise ValueError("a value is missing")
        while True:  # the value is whole: put it where it belongs, and close what it closes
            at = _GAP.match(text, at).end()
            if not open_:
                if at != len(text):
                    raise ValueError("text after the value")
                return value
            container, key = open_[-1]
            if isinstance(container, dict):
                container[key] = value
            else:
                container.append(value)
            c, at = text[at : at + 1], _GAP.match(text, at + 1).end()
            if c == ",":
                if isinstance(container, dict):
                    key, at = _key(text, at)
                    open_[-1] = (container, key)
                break
            if c != ("}" if isinstance(container, dict) else "]"):
                raise ValueError("a container does not end")
            value = open_.pop()[0]


def _key(text: str, at: int) -> tuple[str, int]:
    """A member's name, and the place of its value."""
    if text[at : at + 1] != '"':
        raise ValueError("a name is missing")
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = _GAP.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("a colon is missing")
    return key, _GAP.match(text, at + 1).end()


def read_document(text: str | None, root_key: str) -> dict | None:
    """The object that holds ``root_key`` in a JSON text, or None.

    The object may stand in outer objects, and any of them may be encoded as a
    JSON string again, to any number of steps and any depth; the first in the
    text's order counts.  Text that is not complete JSON gives None.
    """
    waiting: list[object] = [] if text is None else [text]
    while waiting:
        value = waiting.pop()
        if isinstance(value, str) and (value is text or value.lstrip()[:1] in ("{", '"')):
            try:
                waiting.append(parse_json(value))
            except ValueError:
                continue
        elif isinstance(value, dict):
            if root_key in value:
                return value
            waiting.extend(v for v in reversed(value.values()) if isinstance(v, (dict, str)))
    return None


def path_name(name: str) -> str:
    """A member's name as it stands in a schema path: a dot, an opening bracket and a backslash of its own are escaped."""
    return re.sub(r"([.\[\\])", r"\\\1", name) if "." in name or "[" in name or "\\" in name else name


def with_ancestors(paths: tuple[str, ...]) -> frozenset[str]:
    """Schema paths with all paths on the way to them."""
    out = {""}
    for path in paths:
        out |= {path, *(path[: m.start()] for m in re.finditer(r"\.|\[\]", path))}
    return frozenset(out)


def walk(document: object, lists: frozenset[str], pointers: bool = False, only: frozenset[str] | None = None) -> Iterator[tuple[str, str, list[int], str, str | None]]:
    """(dewey, schema path, list positions, kind, value) of every node, parents first.

    With ``pointers`` the path is a JSON pointer with the list positions in it.
    With ``only`` nodes at other schema paths are left out, with all below them.

    A member's ordinal is its place in its object, an element's its place in
    its list.  A value that stands in place of a list at a path of ``lists``
    counts as a list of one.  Containers carry no value; a leaf's value is its
    text (true, false and numbers as in JSON), null for null.
    """
    stack: list[tuple[object, str, str, list[int]]] = [(document, "0", "", [])]
    while stack:
        value, dewey, path, at = stack.pop()
        if only is not None and path not in only:
            continue
        if path in lists and not isinstance(value, list) and value is not None:
            value = [value]
        kind = _kind(value)
        if kind == "object":
            yield dewey, path, at, kind, None
            named = (lambda k: f"{path}/{k.replace('~', '~0').replace('/', '~1')}") if pointers else (lambda k: f"{path}.{path_name(k)}" if path else path_name(k))
            stack.extend((v, f"{dewey}.{i}", named(k), at) for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif kind == "array":
            yield dewey, path, at, kind, None
            stack.extend((v, f"{dewey}.{i}", f"{path}/{i}" if pointers else f"{path}[]", [*at, i]) for i, v in reversed(list(enumerate(value))))
        elif kind in ("boolean", "number"):
            yield dewey, path, at, kind, json.dumps(value)
        else:
            yield dewey, path, at, kind, value


def nodes(records: DataFrame, key: str, body: str, root_key: str | None, lists: tuple[str, ...] = (), pointers: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """All nodes of the JSON in ``body``: (key, dewey, schema_path, ordinals, kind, value).

    ``root_key`` None takes the whole text; ``pointers`` and ``only`` (the paths
    that are wanted) as in ``walk``.  A label has one ordinal for each level, so
    the labels of a text nested d levels deep have about d * d characters; they
    leave in batches of bounded size.
    Repeated rows of a key are read once.  A null, unreadable or cut-off body
    gives no nodes, an empty table gives none; columns other than ``key`` and
    ``body`` are ignored, so their names cannot clash.  Lone surrogates, which
    no column can hold, become U+FFFD.
    """
    listed, wanted = frozenset(lists), None if only is None else with_ancestors(only)
    key_type = records.schema[key].dataType.simpleString()

    def whole(text: str | None) -> object:
        try:
            return parse_json(text) if text is not None else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            owners: list[int] = []
            size = 0
            for i, text in enumerate(bodies):
                document = read_document(text, root_key) if root_key is not None else whole(text)
                if document is None:
                    continue
                for node in walk(document, listed, pointers, wanted):
                    owners.append(i)
                    size += len(node[0]) + len(node[1]) + 4 * len(node[2]) + len(node[4] or "") + 32
                    for column, field in zip(out, node):
                        column.append(field)
                    if size >= _BATCH_BYTES:
                        yield _batch(keys, owners, out)
                        out, owners, size = ([], [], [], [], []), [], 0
            if owners:
                yield _batch(keys, owners, out)

    def _batch(keys: pa.Array, owners: list[int], out: tuple[list, ...]) -> pa.RecordBatch:
        clean = [v.encode("utf-8", "replace").decode() if isinstance(v, str) and not v.isascii() else v for v in out[4]]
        columns = [
            keys.take(pa.array(owners, pa.int64())),
            pa.array(out[0], pa.string()),
            pa.array([p.encode("utf-8", "replace").decode() for p in out[1]], pa.string()),
            pa.array(out[2], pa.list_(pa.int32())),
            pa.array(out[3], pa.string()),
            pa.array(clean, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "dewey", "schema_path", "ordinals", "kind", "value"])

    once = records.select(F.col(key).alias("key"), F.col(body).alias("body")).dropDuplicates(["key"])
    return once.mapInArrow(run, f"key {key_type}, {NODE_FIELDS}")


def parent_label(dewey):
    """The label of the parent: the label without its last ordinal."""
    return F.regexp_replace(dewey, r"\.?\d+$", "")


def flat_table(tree: DataFrame, path: str, members: dict[str, str], steps: int = 1) -> DataFrame:
    """One table of the nodes at ``path`` with some of their members as columns.

    Returns (key, dewey, parent, positions, one column per member).  ``parent``
    is the label ``steps`` levels up; ``positions`` are the list positions on
    the way; the path of the root is empty.  ``members`` maps a column to a member path below the node.  Member
    nodes find their row by their label cut to the row's length, so one
    aggregation groups them and no join is needed.
    """
    wanted = {f"{path}.{m}" if path else m: c for c, m in members.items()}
    at = tree.where(F.col("schema_path").isin(path, *wanted))
    depth = {p: 1 + members[c].count(".") + members[c].count("[]") for p, c in wanted.items()}
    label = F.col("dewey")
    for levels in sorted(set(depth.values())):
        cut = F.col("dewey")
        for _ in range(levels):
            cut = parent_label(cut)
        label = F.when(F.col("schema_path").isin(*[p for p, d in depth.items() if d == levels]), cut).otherwise(label)
    rows = at.withColumn("label", label).groupBy("key", "label").agg(
        F.max(F.when(F.col("schema_path") == path, F.col("ordinals"))).alias("positions"),
        *[F.max(F.when(F.col("schema_path") == p, F.col("value"))).alias(c) for p, c in wanted.items()],
    )
    parent = F.col("label")
    for _ in range(steps):
        parent = parent_label(parent)
    return rows.where(F.col("positions").isNotNull()).select(
        "key", F.col("label").alias("dewey"), parent.alias("parent"), "positions", *members
    )
