"""Abusive content: own sentences, labels, spellings, the label model, odd cases."""

import numpy as np
import pyarrow as pa
import pytest

from evispark.llm import abuse, queries
from tests.llm.abuse_sentences import ABUSIVE, CLEAN, FRESH_ABUSIVE, FRESH_CLEAN

SF = "/root/testdata/sf0.01"


def disguised(text):
    return any(v & abuse.VOTE["disguised"] for v in abuse.passages(pa.array([text]))["votes"].tolist())


def meaning(text):
    """The classes of all tokens together."""
    return int(np.bitwise_or.reduce(abuse.read_tokens(pa.array([text]))["bits"]))


@pytest.mark.parametrize("shown, meant", [("b.a.s.t.a.r.d", "bastard"), ("h a l f w i t", "halfwit"), ("1mb3c1le", "imbecile"), ("stupiiiid", "stupid"), ("wo#thless", "worthless"), ("u5el355", "useless"), ("ｉ​diоt", "idiot"), ("WH0R3", "whore"), ("s t u p i d c l o w n", "stupid"), ("f*cking", "fucking"), ("a" + "b" * 80 + "astard", "")])
def test_spellings_are_undone(shown, meant):
    bits = meaning(f"He is a {shown} here.")
    assert bits & abuse.word_bits(meant) == abuse.word_bits(meant)


def test_long_tokens_are_undone():
    run = "stupid" * 14  # 84 letters
    assert meaning(f"You {run} clown") & abuse.BIT["disguised"] or abuse.undisguised(run + "1d10t")


@pytest.mark.parametrize("clean", ["Allocation F84206/35 used **sealed** envelopes; n=12.", "idiopathic anal fissures in 13 cocktail parties", "p = 0.05 on the RIS36 scale", "Schedule a b c d e f was followed."])
def test_ordinary_text_stays(clean):
    assert not disguised(clean)


def test_sentences_and_pieces():
    found = abuse.passages(pa.array(["One two. Three!  Four\n\nFive six? seven", None, "", "w " * 300]))
    assert found["owner"].tolist() == [0] * 5 + [3] * 3 and found["lengths"].tolist() == [2, 1, 1, 2, 1, 128, 128, 44]


def test_label_model_recovers_accuracies():
    """Votes drawn from known rates: the model tells sound voters from noisy ones, and its posteriors are calibrated."""
    rng = np.random.default_rng(3)
    n = 60_000
    truth = rng.random(n) < 0.02
    votes = np.zeros(n, np.int64)
    rates = {"insult_en": (0.7, 0.0005), "contempt_noun": (0.6, 0.001), "you_insult": (0.5, 0.004), "clinical": (0.02, 0.3)}
    for name, (yes, no) in rates.items():
        votes |= np.where(rng.random(n) < np.where(truth, yes, no), abuse.VOTE[name], 0)
    patterns, counts = np.unique(votes, return_counts=True)
    table = abuse.LabelModel(patterns, counts).table()
    posterior = np.array([table[v] for v in votes.tolist()])
    assert abs(posterior.mean() - truth.mean()) < 0.006
    assert posterior[truth].mean() > 0.8 and posterior[~truth].mean() < 0.005
    lone = {name: table[abuse.VOTE[name]] for name in rates}
    assert lone["insult_en"] > lone["you_insult"] > lone["clinical"] and 0.05 < lone["you_insult"] < 0.95
    assert table.get(abuse.VOTE["you_insult"] | abuse.VOTE["clinical"], 0) < lone["you_insult"]


def marked(spark, abusive, clean):
    """(abusive sentences, those found, all marked) by the classifier of the test tables."""
    rows = [(-1 - i, t, y) for i, (t, y) in enumerate([(t, 1) for s in abusive.values() for t in s] + [(t, 0) for s in clean.values() for t in s])]
    own = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id for r in abuse.score_documents(corpus.unionByName(own)).where("review and doc_id < 0").collect()}
    return sum(y for *_, y in rows), sum(y for i, _, y in rows if i in found), len(found)


def test_development_sentences(spark):
    """What the voters and settings were developed with: no measure of new texts."""
    n, hits, all_marked = marked(spark, ABUSIVE, CLEAN)
    assert hits >= 0.9 * n and hits >= 0.9 * all_marked


def test_fresh_sentences(spark):
    """Scored once after development: about half are found, nearly all marked ones are abusive (see README)."""
    n, hits, all_marked = marked(spark, FRESH_ABUSIVE, FRESH_CLEAN)
    assert hits >= 0.4 * n and hits >= 0.9 * all_marked


def test_scores_on_held_out_labels(spark):
    scored = {r.doc_id: r.review for r in queries.p9_scores(spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(scored) == documents.count()
    agreed = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").groupBy("doc_id").avg("toxic").collect()
    votes = [(scored[r[0]], r[1] > 0.5) for r in agreed if r[1] != 0.5]
    assert sum(a == b for a, b in votes) / len(votes) >= 0.9  # raters err, too
    flagged = [truth for review, truth in votes if review]
    assert sum(flagged) >= 0.9 * len(flagged)
    assert sum(flagged) >= 0.6 * sum(truth for _, truth in votes)


def test_texts_without_content_score_zero(spark):
    bad = "You stupid worthless idiot, I will kill you."
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, bad, "x"), (4, bad, "x"), (5, "word " * 50_000 + ". " + bad, "x")], "doc_id long, text string, score string")
    rows = [(r.doc_id, r.score > 0, r.review) for r in abuse.score_documents(df).collect()]
    assert sorted(rows) == [(1, False, False), (2, False, False), (3, False, False), (4, True, True), (4, True, True), (5, True, True)]
    assert abuse.score_documents(df.limit(0)).count() == 0
