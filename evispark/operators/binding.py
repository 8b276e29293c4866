"""Bindings of stated values to the evidence that holds them, and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.plans import broadcast_if_small


#: most stated values whose anchors are broadcast
ANCHORS = 200_000


def _words(text) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def _hashes(text) -> Column:
    """A hash of each word."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _threes(items, joined) -> Column:
    """``joined`` of each three neighbours of an array.

    The array is zipped with itself moved by one and two, so it is computed
    three times and not once for every element.
    """
    moved = lambda by: F.slice(items, by + 1, F.greatest(F.size(items), F.lit(1)))
    pairs = F.zip_with(items, moved(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    threes = F.zip_with(pairs, moved(2), lambda p, c: joined(p["a"], p["b"], c))
    return F.slice(threes, 1, F.greatest(F.size(items) - 2, F.lit(0)))


def _runs(hashes) -> Column:
    """A hash of each run of three word hashes."""
    return _threes(hashes, lambda a, b, c: F.xxhash64(a, b, c))


def candidates(values: DataFrame, evidence: DataFrame, keys: list[str], value: list[str], item: list[str]) -> DataFrame:
    """(keys, value, item): pairs of a stated value and an evidence item that may hold it; none that does is left out.

    ``values`` has (keys, value..., text), ``evidence`` (keys, item..., text).
    The words inside a value, without its first and last, which may be parts of
    longer ones, stand in any text that holds it.  So a value meets the items of
    its key that hold three of them in a row, its longest such run; a value of
    three or four words meets those that hold the longest word between.  Only a
    value of one or two words meets all items of its key.
    """
    words = _words(F.col("text"))
    stated = values.where(F.col("text") != "").withColumn("inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    stated = stated.withColumns({"hashes": F.transform("inner", lambda w: F.xxhash64(w)), "sizes": F.transform("inner", F.char_length)})
    length = _threes(F.col("sizes"), lambda a, b, c: a + b + c)
    run = F.array_max(F.zip_with(length, _runs(F.col("hashes")), lambda n, h: F.struct(n.alias("n"), h.alias("h"))))["h"]
    word = F.array_max(F.zip_with("sizes", "hashes", lambda n, h: F.struct(n.alias("n"), h.alias("h"))))["h"]
    stated = stated.select(*keys, *value, F.when(F.size("inner") >= 3, run).when(F.size("inner") >= 1, word).alias("anchor"))
    held = evidence.where(F.col("text").isNotNull()).select(*keys, *item, _hashes(F.col("text")).alias("hashes")).select(*keys, *item, F.explode(F.array_distinct(F.concat("hashes", _runs(F.col("hashes"))))).alias("anchor"))
    anchored = broadcast_if_small(stated.where("anchor is not null"), ANCHORS)
    met = held.join(anchored, [*keys, "anchor"]).select(*keys, *value, *item)
    rest = evidence.select(*keys, *item).join(stated.where("anchor is null").select(*keys, *value), keys).select(*keys, *value, *item)
    return met.unionByName(rest)


def bound(leaves: DataFrame, evidence: DataFrame, keys: list[str], leaf: list[str], order: list[str]) -> DataFrame:
    """(keys, leaf, order): for each leaf the first evidence item of its key whose text holds its value.

    ``leaves`` has (keys, leaf, value), ``evidence`` (keys, order, text).  Only
    ``candidates`` are compared.  Unbound leaves have nulls, see ``defects``;
    the empty value is bound nowhere.
    """
    pairs = candidates(leaves.select(*keys, *leaf, F.col("value").alias("text")), evidence, keys, leaf, order)
    held = pairs.join(leaves.select(*keys, *leaf, "value"), [*keys, *leaf]).join(evidence.select(*keys, *order, "text"), [*keys, *order]).where(F.col("text").contains(F.col("value")))
    first = held.groupBy(*keys, *leaf).agg(F.min(F.struct(*order)).alias("first"))
    return leaves.select(*keys, *leaf).join(first, [*keys, *leaf], "left").select(*keys, *leaf, *[F.col(f"first.{c}").alias(c) for c in order])


def defects(bindings: DataFrame, order: list[str]) -> DataFrame:
    """The leaves that no evidence holds."""
    return bindings.where(F.col(order[0]).isNull()).drop(*order)


def coherent(evidence: DataFrame, parts: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """(keys, item, tuple): items that hold every value of a tuple (relational division).

    ``parts`` has (keys, tuple, values), values an array; ``evidence`` (keys,
    item, text).  An item is compared if it may hold the tuple's longest value.
    A tuple without values is held by none.
    """
    longest = F.array_max(F.transform("values", lambda v: F.struct(F.char_length(v).alias("n"), v.alias("v"))))["v"]
    whole = parts.where((F.size("values") > 0) & ~F.exists("values", lambda v: v.isNull()))
    pairs = candidates(whole.select(*keys, "tuple", longest.alias("text")), evidence, keys, ["tuple"], item)
    met = pairs.join(whole.select(*keys, "tuple", "values"), [*keys, "tuple"]).join(evidence.select(*keys, *item, "text"), [*keys, *item])
    return met.where(F.forall("values", lambda v: F.col("text").contains(v))).select(*keys, *item, "tuple")


def resolved(basis: DataFrame, catalogue: DataFrame, keys: list[str], handle: str) -> DataFrame:
    """basis plus ``n_matches``: how many catalogue rows a handle names; 1 is resolved, 0 unknown, more ambiguous."""
    named = catalogue.groupBy(*keys, handle).agg(F.count("*").alias("n_matches"))
    return basis.join(named, [*keys, handle], "left").fillna(0, ["n_matches"])


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row per record and broken rule; a rule is a condition that must hold, null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))
