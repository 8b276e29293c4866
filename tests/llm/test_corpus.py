"""Leaked items against every window of words."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evispark.llm import leaks
from evispark.llm.lookalikes import one_form_array

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall(one_form_array(pa.array([text])).to_pylist()[0].lower())


def longest(document, item):
    a, b, best = words(document or ""), words(item or ""), 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_runs_equal_a_plain_search(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 13, 14, 40])))) for i in range(30)] + [(30, None), (31, "")]
    documents = [(-1, None), (-2, ""), (-3, "short")]
    for d in range(60):
        own = words(rng.choice(items[:30])[1])
        n = rng.randint(8, len(own)) if len(own) > 8 else len(own)
        at = rng.randint(0, len(own) - n)
        quoted = own[at : at + n]
        if d % 4 == 0 and n > 3:
            quoted.insert(n // 2, "between")
        documents.append((d, ", ".join(rng.choices(vocabulary, k=9)) + " (" + " ".join(quoted).upper() + ") " + " ".join(rng.choices(vocabulary, k=7))))
    found = leaks.leaked_items(spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_words for r in found.collect() if r.n_words}
    expected = {(d, i): n for d, t in documents for i, s in items if (n := longest(t, s)) >= 13}
    assert got == expected and expected


def test_odd_tables(spark):
    text = " ".join(f"word{i}" for i in range(40))
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    same = leaks.leaked_items(documents, spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")).collect()
    assert [(r.n_words, r.similarity, r.altered, r.altered_words) for r in same] == [(40, 1.0, 1.0, 36)]
    assert leaks.leaked_items(documents, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks.leaked_items(documents.limit(0), spark.createDataFrame([(1, text)], "item_id long, text string")).count() == 0


def test_item_blocks_change_nothing(spark):
    documents = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    items = documents.selectExpr("doc_id as item_id", "text")
    keys = ["doc_id", "item_id", "n_words"]  # weights are those of an item's block
    whole = sorted(map(tuple, leaks.leaked_items(documents, items).select(*keys).where("n_words > 0").collect()))
    assert sorted(map(tuple, leaks.leaked_items(documents, items, block_bytes=1_000).select(*keys).where("n_words > 0").collect())) == whole and len(whole) > 30


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = items[rng.integers(0, 200, 500)]
    for _ in range(12):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    prints = np.concatenate([near, rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    for radius in (3, 15):
        got = set(zip(*(x.tolist() for x in leaks.BlockIndex(items, radius).candidates(prints))))
        assert got == {(i, j) for i in range(len(prints)) for j in range(200) if bin(int(prints[i]) ^ int(items[j])).count("1") <= radius}


def test_similarity_equals_sets():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 9, (60, 14)).astype(np.uint64)
    held = leaks.Shingles(words[:10].ravel(), np.repeat(np.arange(10), 14), 2)
    cut = lambda row: {tuple(row[i : i + 2]) for i in range(13)}
    owners = Counter(s for row in words[:10].tolist() for s in cut(row))
    weight = lambda s: max(1, 8 - int(math.log2(owners[s]))) if owners[s] else 8
    got = leaks.similarity(words[:30], words[30:], held)
    for x, y, s in zip(words[:30].tolist(), words[30:].tolist(), got.tolist()):
        assert abs(s - sum(map(weight, cut(x) & cut(y))) / sum(map(weight, cut(x) | cut(y)))) < 1e-9


@pytest.mark.parametrize("every", [8, 10, 12])
def test_altered_passages_are_found(spark, every):
    """Items with one word in eight to twelve altered, planted in documents of the test tables: recall and precision."""
    sf = "/root/testdata/sf0.01"
    rng = random.Random(every)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").orderBy("item_id").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0").orderBy("doc_id").collect()]
    documents = []
    for d, (_, text) in enumerate(items):
        passage = text.split()
        for at in range(rng.randrange(every), len(passage), every):
            passage[at] = f"altered{rng.randrange(999)}"
        around = rng.choice(texts).split()
        at = rng.randint(0, len(around))
        documents.append((d, " ".join(around[:at] + passage + around[at:])))
    documents += [(1000 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_items(frame, spark.createDataFrame(items, "item_id long, text string")).where(f"altered >= {leaks.ALTERED}").collect()}
    planted = {(d, i) for d, (i, _) in enumerate(items)}
    assert len(found & planted) >= 0.9 * len(planted)
    # of the pairs found, those that were not planted share a long part of the item with the document
    others = [(d, i) for d, i in found - planted]
    by_id, by_doc = dict(items), dict(documents)
    pairs = lambda t: {(a, b) for a, b in zip(words(t), words(t)[1:])}
    assert all(len(pairs(by_id[i]) & pairs(by_doc[d])) >= 0.25 * len(pairs(by_id[i])) for d, i in others)
