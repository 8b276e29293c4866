"""One form, pieces and tokens against the standard library and other tokenizers."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import lookalikes, pieces, tokens

marks = st.sampled_from("̧̣́̈̂각Aeé가ﬁｅ‍ а")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text(marks, max_size=12)), max_size=6))
def test_one_form_equals_folding_and_composing(texts):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    expected = [t if t is None else unicodedata.normalize("NFC", "".join(map(lookalikes._folded, t))) for t in texts]
    found = lookalikes.one_form_array(pa.array(texts, pa.string())).to_pylist()
    assert found == expected
    assert lookalikes.one_form_array(pa.array(found, pa.string())).to_pylist() == found


def test_what_is_folded_and_what_is_not():
    same = [("Ｓhе​ café ﬁ", "She café fi"), ("non‑stop µ", "non-stop μ"), ("ｔ­ｗо", "two")]
    for a, b in same:
        x, y = lookalikes.one_form_array(pa.array([a, b])).to_pylist()
        assert x == y
    for a, b in [("x²", "x2"), ("e", "é"), ("a", "A"), ("α", "a"), ("1", "l"), ("a–b", "a-b"), ("a\nb", "a b"), ("a  b", "a b")]:
        x, y = lookalikes.one_form_array(pa.array([a, b])).to_pylist()
        assert x != y


def test_look_alike_pairs(spark):
    rows = [("f", "1", "abc"), ("f", "2", "аbc"), ("f", "2", "аbc"), ("f", "10", "abc"), ("g", "1", "аbc"), ("f", "3", None), ("f", "4", ""), ("f", "5", "​"), ("f", "6", "ABC"), ("f", None, "аbc")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "field string, key string, text string, form string")
    found = {tuple(r) for r in lookalikes.look_alike_pairs(df).collect()}
    assert found == {("f", "1", "2"), ("f", "10", "2"), ("f", "4", "5")}
    assert lookalikes.look_alike_pairs(df.where("key = 'none'")).count() == 0


def test_identical_copies_make_no_pairs(spark):
    df = spark.range(3000).selectExpr("'f' as field", "cast(id as string) as key", "case when id = 7 then 'tеxt' else 'text' end as text")
    assert lookalikes.look_alike_pairs(df).count() == 2999


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab .\n!é"), max_size=300), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_and_overlap(text, limit, overlap):
    cut = pieces.cut(text, limit, overlap)
    assert (cut == []) == (text == "")
    assert not cut or (cut[0][0] == 0 and cut[-1][1] == len(text))
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert c == max(a, b - overlap) and d > b
    assert all(0 < b - a <= limit for a, b in cut)


def test_boundaries_are_taken_by_strength():
    text = "One two three. Four five six.\nSeven eight.\n\nNine ten eleven twelve."
    assert [text[a:b] for a, b in pieces.cut(text, 45, 0)] == [text[:44], text[44:]]
    words = "word " * 30
    assert all(words[b - 1] == " " for _, b in pieces.cut(words, 42, 10))
    assert pieces.cut("x" * 100, 40, 10) == [(0, 30), (20, 60), (50, 90), (80, 100)]


def test_split_items(spark):
    df = spark.createDataFrame([("a", "x" * 9000, 1), ("b", "", 1), ("c", None, 1), ("d", "short", 1), ("d", "short", 1)], "id string, text string, piece_no int")
    rows = pieces.split_items(df, ["id"], "text").collect()
    assert [(r.id, r.piece_no, r.end - r.start) for r in rows if r.id == "a"] == [("a", 0, 3800), ("a", 1, 4000), ("a", 2, 1600)]
    assert sum(r.id == "d" for r in rows) == 2 and {r.id for r in rows} == {"a", "d"}
    with pytest.raises(ValueError):
        pieces.split_items(df, ["id"], "text", 10, 10)


@pytest.fixture(scope="module")
def encoder():
    path, pattern = tokens.default_vocabulary()
    with open(path, "rb") as f:
        return tokens.BytePairEncoder(f.read(), pattern)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_another_encoder(encoder, text):
    import public_tokenizers as public
    import tiktoken

    text = text.encode("utf-8", "ignore").decode()
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    ids = encoder.encode(text)
    assert ids == other.encode_ordinary(text)
    names = {v: k for k, v in encoder.ranks.items()}
    assert b"".join(names[i] for i in ids).decode() == text  # exact round trip


def test_long_words_and_corpus(spark, encoder):
    assert encoder.encode("a" * 20_000) and len(encoder.encode("ab" * 10_000)) > 100
    df = spark.createDataFrame([(1, "Hello <|endoftext|>", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello <|endoftext|>", "x")], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert rows[2] == rows[3] == [] and rows[1] == encoder.encode("Hello <|endoftext|>") and 50256 not in rows[1]
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
