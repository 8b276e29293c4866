"""Relational operators against plain loops, and retrieval against a full-text engine."""

import random
import sqlite3
from itertools import product

import pytest
from pyspark.sql import functions as F

from evispark.functions import text
from evispark.operators import decisions, intervals, lineage, projections, retrieval, scoring, sets


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PAGES = "source_id string, page int, text string"
CORPUS = [
    ("s1", 1, "Allocation was concealed by the pharmacy; allocations were checked."), ("s1", 2, "Randomised participants received placebo."), ("s2", 1, "The placebo group was larger than the treated group, and placebo was masked."),
    ("s2", 2, ""), ("s3", 1, None), ("s3", 2, "Participants were lost to follow-up. Participants withdrew consent."), ("s3", 3, "Random numbers randomise randomly."), ("s4", 1, "Unrelated appendix text on storage."), ("s4", 2, "More unrelated appendix text."),
]


def engine(rows):
    """A full-text engine over a text column and its searchable form."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(raw, form, tokenize='porter unicode61')")
    for i, r in enumerate(rows):
        form = text.search_text(r[2])
        db.execute("insert into f(rowid, raw, form) values (?, ?, ?)", (i, r[2], form if form != r[2] else ""))
    return db


def expression(query, mode):
    terms = [f'"{t}"' for t in text.query_text(query).split()]
    return {"any": " OR ".join(terms), "all": " AND ".join(terms), "prefix": " OR ".join(f"{t}*" for t in terms), "phrase": '"' + " ".join(t.strip('"') for t in terms) + '"'}[mode]


@pytest.mark.parametrize("mode", ["any", "all", "prefix", "phrase"])
def test_ranking_equals_a_full_text_engine(spark, mode):
    """Accents, full-width and soft-hyphenated forms, phrases, repeated terms and beginnings of one letter on."""
    rows = [*CORPUS, ("s5", 1, "Straße und STRASSE; naïve co-\noperation of ran\u00ad\ndom ｐｌａｃｅｂｏ_groups"), ("s5", 2, "low-dose placebo, low dose placebo; dose low")]
    held = [r for r in rows if r[2] is not None]
    db = engine(held)
    queries = ["allocation pharmacy", "placebo", "placebo placebo group", "participants lost", "random", "r", "ra", "low-dose placebo", "strasse naive", "follow-up", "lost to follow-up", "ｐｌａｃｅｂｏ", "randomised, participants."]
    asked = frame(spark, [(q, mode, q) for q in queries] + [("empty", mode, " . ")], "query_id string, mode string, query string")
    got = retrieval.scores(frame(spark, rows, PAGES), asked).collect()
    for query in queries:
        expected = {(held[i][0], held[i][1]): -score for i, score in db.execute("select rowid, bm25(f) from f where f match ?", (expression(query, mode),))}
        mine = {(r.source_id, r.page): r.score for r in got if r.query_id == query}
        assert mine.keys() == expected.keys(), query
        assert all(abs(mine[k] - expected[k]) < 1e-6 for k in mine), (query, mine, expected)
    assert not any(r.query_id == "empty" for r in got)


def test_ties_follow_the_reading_order(spark):
    found = frame(spark, [("q", s, 1, 1.0) for s in "abcd"] + [("q", "a", 2, 2.0)], "query_id string, source_id string, page int, score double")
    order = retrieval.reading_order(frame(spark, [("a", "other", "x"), ("b", "protocol", "Z"), ("c", "protocol", "y"), ("c", "other", "a")], "source_id string, role string, path string"))
    assert [(r.source_id, r.page, r.source_rank) for r in retrieval.ranked(found, 9, order=order).orderBy("rank").collect()] == [("a", 2, 1), ("c", 1, 1), ("b", 1, 1), ("a", 1, 2), ("d", 1, 1)]


def test_phrases_and_literals(spark):
    phrases = frame(spark, [("p", "phrase", "lost to follow up"), ("q", "phrase", "follow lost")], "query_id string, mode string, query string")
    assert [(r.query_id, r.page, r.n_hits) for r in retrieval.phrase_pages(frame(spark, CORPUS, PAGES), phrases).collect()] == [("p", 2, 2)]  # in both columns
    literal = retrieval.literal_pages(frame(spark, CORPUS, PAGES), frame(spark, [("l", "literal", "PLACEBO"), ("m", "literal", "..."), ("n", "literal", "lacebo"), ("o", "literal", "follow-up.")], "query_id string, mode string, query string")).collect()
    assert {(r.query_id, r.source_id, r.page, len(r.spans)) for r in literal} == {("l", "s1", 2, 1), ("l", "s2", 1, 2), ("o", "s3", 2, 1)}
    assert retrieval.scores(frame(spark, [], PAGES), phrases).count() == 0


def test_cluster_draws_are_those_of_the_seeded_generator(spark):
    rows = [(f"c{i:02}", i % 5, 4 + i % 3) for i in range(12)]
    rng, ratios = random.Random(7), []
    for _ in range(300):
        drawn = [rng.choice(rows) for _ in rows]
        ratios.append(sum(n for _, n, _ in drawn) / sum(d for _, _, d in drawn))
    ratios.sort()
    got = scoring.cluster_interval(frame(spark, rows[::-1], "cluster string, n int, d int").repartition(3), 7, 300).collect()
    cut = lambda p: ratios[int(299 * p)] * (1 - 299 * p % 1) + ratios[int(299 * p) + 1] * (299 * p % 1)
    assert len(got) == 1 and got[0].n_clusters == 12 and abs(got[0].low - cut(0.025)) < 1e-12 and abs(got[0].high - cut(0.975)) < 1e-12
    assert tuple(scoring.cluster_interval(frame(spark, rows[:1], "cluster string, n int, d int"), 7).first()) == (None, None, 1)
    assert scoring.cluster_interval(frame(spark, [], "cluster string, n int, d int"), 7).count() == 0


def test_suggestions_meet_by_deletions(spark):
    words = ["randomization", "randomisation", "placebo", "concealment", "allocation"]
    catalogue = frame(spark, [(w, i) for i, w in enumerate(words)], "word string, n_pages long")
    terms = frame(spark, [(t,) for t in ("randomizaton", "placbeo", "alocation", "conceelmnt", "xyzzy", "ab")], "term string")
    assert {(r.term, r.word, r.distance) for r in retrieval.suggestions(terms, catalogue).collect()} == {("randomizaton", "randomization", 1), ("randomizaton", "randomisation", 2), ("placbeo", "placebo", 1), ("alocation", "allocation", 1), ("conceelmnt", "concealment", 2)}


def test_intervals_equal_sets_of_numbers(spark):
    rng = random.Random(2)
    required = [(k, 1, rng.randint(1, 30)) for k in range(12)]
    delivered = [(rng.randint(0, 13), a := rng.randint(-3, 35), a + rng.randint(-2, 8)) for _ in range(40)] + [(1, None, 4)]
    r = frame(spark, required, "k int, first long, last long")
    d = frame(spark, [(k, a, b) for k, a, b in delivered], "k int, first long, last long")
    lines = {k: set(range(a, b + 1)) for k, a, b in required}
    got = {k: {x for j, a, b in delivered if j == k and a is not None for x in range(a, b + 1)} for k in lines}
    gaps = {}
    for row in intervals.gaps(r, d, ["k"]).collect():
        assert not gaps.setdefault(row.k, set()) & set(range(row.first, row.last + 1))
        gaps[row.k] |= set(range(row.first, row.last + 1))
    assert {k: v for k, v in gaps.items()} == {k: lines[k] - got[k] for k in lines if lines[k] - got[k]}
    states = {row.k: (row.state, row.n_covered) for row in intervals.coverage(r, d, ["k"]).collect()}
    assert states == {k: ("delivered" if lines[k] <= got[k] else "partial" if lines[k] & got[k] else "unobserved", len(lines[k] & got[k])) for k in lines}
    assert [tuple(x) for x in intervals.merged(frame(spark, [(1, 1, 3), (1, 4, 5), (1, 2, 2), (1, 8, 7), (1, 9, 9)], "k int, first int, last int"), ["k"]).orderBy("first").collect()] == [(1, 1, 5, 3), (1, 9, 9, 1)]


def test_chains_of_any_length_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100, 102), (101, 100), (102, 101), (103, 100), (200, 999), (201, 200), (None, 1), (5, 4)]
    got = {r.k: (r.root, r.depth, r.state) for r in lineage.chains(frame(spark, rows, "k int, parent int"), "k", "parent").collect()}
    expected = {i: (0, i, "rooted") for i in range(70)} | {i: (None, None, "cycle") for i in (100, 101, 102, 103)} | {200: (200, 0, "orphan"), 201: (200, 1, "orphan")}
    assert got == expected
    assert lineage.depths(frame(spark, rows, "k int, parent int"), "k", "parent").count() == 70
    assert lineage.chains(frame(spark, [], "k int, parent int"), "k", "parent").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from evispark.plans import lineage as plans

    class Context:
        master = "spark://host:7077"

        def __getattr__(self, _):
            return lambda *a: self

        def isDefined(self):  # noqa: N802
            return False

        _jsc = property(lambda self: self)

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError):
        plans.shared_folder(Session())


def test_packing_and_prefix(spark):
    items = frame(spark, [("a", i, w) for i, w in enumerate([5, 4, 3, 20, 1, None])] + [("b", 0, 9)], "k string, i int, w int")
    packed = {(r.k, r.i): r.sheet for r in intervals.packed(items, ["k"], ["i"], "w", 10).collect()}
    assert packed == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("a", 5): 3, ("b", 0): 0}
    assert [r.i for r in intervals.byte_prefix(items.where("k = 'a' and w is not null"), ["k"], ["i"], "w", 12).orderBy("i").collect()] == [0, 1, 2]
    many = frame(spark, [("a", i, 1) for i in range(40)] + [("b", 7, 50)], "k string, i int, w int")
    assert {(r.k, r.i, r.running) for r in intervals.byte_prefix(many, ["k"], ["i"], "w", 25, F.floor(F.col("i") / 10)).collect()} == {("a", i, i + 1) for i in range(25)}


def test_chains_with_cycles_and_branches(spark):
    rows = frame(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("lost", "nowhere")], "k string, p string")
    assert {tuple(r) for r in lineage.depths(rows, "k", "p").collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 2)}
    assert {r.k for r in lineage.leaves(rows, "k", "p").collect()} == {"c", "d", "lost"}
    assert [tuple(r) for r in lineage.branches(rows, "k", "p").collect()] == [("b", 2)]


def test_calls_pair_in_order(spark):
    events = [("t", 0, "thread.started", None), ("t", 1, "item.started", "c"), ("t", 2, "item.completed", "c"), ("t", 3, "item.started", "c"), ("t", 4, "thread.started", None), ("t", 5, "item.completed", "c"), ("u", 1, "item.completed", "z")]
    got = {tuple(r) for r in lineage.call_pairs(frame(spark, events, "transcript string, ordinal int, type string, call_id string")).collect()}
    assert got == {("t", 1, "c", 1, 2), ("t", 1, "c", 3, None), ("t", 2, "c", None, 5), ("u", 0, "z", None, 1)}


def reference_judgement(domain, answers):
    yes, no, ni = {"yes", "probably_yes"}, {"no", "probably_no"}, {"no_information"}
    a = answers.get
    if domain == "randomization":
        if a("concealment") in no or (a("concealment") in ni and a("baseline-imbalance") in yes):
            return "high"
        return "some_concerns" if a("sequence") in no or a("concealment") in ni or a("baseline-imbalance") in yes else "low"
    if a("measurements") in yes or a("analyses") in yes:
        return "high"
    return "some_concerns" if a("prespecified") in no | ni or ni & {a("measurements"), a("analyses")} else "low"


@pytest.mark.parametrize("domain, questions", [("randomization", ["sequence", "concealment", "baseline-imbalance"]), ("selection", ["prespecified", "measurements", "analyses"])])
def test_every_answer_path(spark, domain, questions):
    rows = [dict(zip(questions, x)) for x in product([*decisions.ANSWERS, None], repeat=3)]
    df = spark.createDataFrame([tuple(r[q] for q in questions) for r in rows], ", ".join(f"`{q}` string" for q in questions))
    for row in decisions.judged(df, decisions.TABLES[domain]).collect():
        answers = {q: row[q] for q in questions}
        assert row.judgement == reference_judgement(domain, answers), answers
        assert row.drivers is not None


def test_overall_of_every_vector(spark):
    rows = [(i, d, j) for i, v in enumerate(product(decisions.LEVELS, repeat=5)) for d, j in enumerate(v)]
    got = {r.i: (r.overall, r.n_some) for r in decisions.overall(frame(spark, rows, "i int, d int, judgement string"), ["i"], 5).collect()}
    for i, v in enumerate(product(decisions.LEVELS, repeat=5)):
        assert got[i] == (max(v, key=decisions.LEVELS.index), v.count("some_concerns"))
    assert decisions.overall(frame(spark, rows[:3], "i int, d int, judgement string"), ["i"], 5).count() == 0


def test_bootstrap_brackets_the_ratio(spark):
    clusters = frame(spark, [(i, i % 3, 3) for i in range(200)], "cluster long, n long, d long")
    low, high, n = scoring.poisson_interval(clusters, 400).first()
    assert low < 199 / 600 < high and high - low < 0.1 and n == 200
    assert tuple(scoring.poisson_interval(clusters.limit(1), 50).first()) == (None, None, 1)


def test_rates_and_agreement_of_nothing(spark):
    none = frame(spark, [], "label string, prediction string")
    assert tuple(scoring.agreement(none).first()) == (0, 0, 0.0, None) and scoring.confusion(none).count() == 0
    row = frame(spark, [(0, 0)], "n int, d int").select(scoring.rate(F.col("n"), F.col("d")), scoring.nullable_rate(F.col("n"), F.col("d"))).first()
    assert tuple(row) == (0.0, None)


def test_sets_and_leaves(spark):
    a, b = frame(spark, [(1,), (1,), (2,), (None,)], "x int"), frame(spark, [(2,), (3,)], "x int")
    assert {tuple(r) for r in sets.set_difference(a, b).collect()} == {(1, "missing"), (None, "missing"), (3, "extra")}
    assert {tuple(r) for r in sets.multiset_difference(a, b, ["x"]).collect()} == {(1, 2), (None, 1), (3, -1)}
    rows = frame(spark, [("r", '{"a": {"b": [1, {"c": "x"}]}, "form": {"d": 2}, "e": null}'), ("bad", "{")], "id string, body string")
    assert {tuple(r) for r in projections.leaf_table(rows, "id", "body", ("form",)).collect()} == {("r", "/a/b/0", "1"), ("r", "/a/b/1/c", "x"), ("r", "/e", None)}


def test_streamed_counts(spark, tmp_path):
    from evispark.streaming import orphan_counts, orphan_keys

    schema = "ref_table string, key string, reference int, existence int"
    steps = [[("t", "a", 1, 0), ("t", "b", 1, 0), ("t", "b", 0, 1), ("t", None, 1, 0)], [("t", "a", 0, 1), ("t", "b", 0, -1)], [("t", "b", -1, 0)]]
    seen = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    for i in range(len(steps)):
        counts = orphan_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / f"[0-{i}]")))
        query = counts.writeStream.outputMode("complete").format("memory").queryName(f"orphans{i}").start()
        query.processAllAvailable()
        query.stop()
        seen.append({r.key for r in orphan_keys(spark.table(f"orphans{i}")).collect()})
    assert seen == [{"a"}, {"b"}, set()]
