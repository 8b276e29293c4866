"""Citations are looked up whole."""

import random

from evispark.operators import binding
from evispark.queries import evidence, retrieval

HEAD = "The allocation list was kept by the pharmacy until the last visit of a participant, "
TEXT = f"Intro. {HEAD}and nobody else saw it. Twice said. Twice said."


def stored(spark, folder):
    pages = [("s", 1, TEXT), ("s", 2, None)]
    cited = [(1, "s", 1, f"{HEAD}and nobody else saw it."), (2, "s", 1, f"{HEAD}and everybody saw it."), (3, "s", 1, "Twice said."), (4, "s", 1, None), (5, "s", 2, HEAD), (6, "s", 1, "Intro.")]
    spark.createDataFrame(pages, "source_id string, page int, text string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(cited, "reference_id long, source_id string, page int, citation string").write.parquet(f"{folder}/companion_reference.parquet")
    return str(folder)


def test_evidence_selection_reads_the_whole_citation(spark, tmp_path):
    states = dict(map(tuple, retrieval.evidence_selection(spark, stored(spark, tmp_path)).collect()))
    assert states == {1: "unique", 2: "absent", 3: "ambiguous", 4: "empty", 5: "absent", 6: "unique"}


def test_bindings_compare_whole_citations(spark, tmp_path):
    sf = stored(spark, tmp_path)
    bound = {r.reference_id: r.page for r in evidence.citation_bindings(spark, sf).collect()}
    assert bound == {1: 1, 2: None, 3: 1, 5: 1, 6: 1}
    assert {r.reference_id for r in evidence.citation_defects(spark, sf).collect()} == {2}
    assert {(r.reference_id, r.page) for r in evidence.coherent_anchors(spark, sf).collect()} == {(1, 1), (3, 1), (5, 1), (6, 1)}


def test_bindings_equal_all_pairs(spark):
    """Values of every length, cut anywhere, repeated and hot, against a comparison of all pairs."""
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(30)]
    pages = [("hot" if i % 3 else f"s{i}", i, " ".join(rng.choices(words, k=40)) + rng.choice([".", "\n", ""])) for i in range(40)] + [("hot", 90, None), ("hot", 91, "")]
    leaves = []
    for i in range(120):
        source, _, text = rng.choice(pages[:40])
        at = rng.randrange(len(text))
        leaves.append((source, i, text[at : at + rng.choice([1, 3, 9, 20, 60])]))
    leaves += [("hot", 500, ""), ("hot", 501, "w1é w2é nowhere w3é w4é"), ("none", 502, "w1é")]
    p, v = spark.createDataFrame(pages, "k string, page int, text string"), spark.createDataFrame(leaves, "k string, leaf int, value string")
    got = {(r.k, r.leaf): r.page for r in binding.bound(v, p, ["k"], ["leaf"], ["page"]).collect()}
    assert got == {(k, i): min((n for s, n, t in pages if s == k and t and x and x in t), default=None) for k, i, x in leaves}
    tuples = [(leaves[i][0], i, [leaves[i][2], leaves[i + 1][2]]) for i in range(100)]
    t = spark.createDataFrame(tuples, "k string, tuple int, values array<string>")
    assert {(r.k, r.page, r.tuple) for r in binding.coherent(p, t, ["k"], ["page"]).collect()} == {(k, n, i) for k, i, xs in tuples for s, n, x in pages if s == k and x and all(y in x for y in xs)}
