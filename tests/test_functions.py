"""Text and arithmetic functions: goldens and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.functions import arithmetic, text


def test_readable_form():
    assert text.readable("a\r\nb\x0bc ​– “q”  \n\xa0x\t y \n") == 'a\nb c - "q"\n x y\n'
    assert text.readable("") == ""


def test_line_bounds_lose_nothing():
    long = "word " * 900 + "y" * 4500
    bounded = text.bounded_lines(long)
    assert bounded.replace("\n", "") == long and max(map(len, bounded.split("\n"))) <= 2000
    assert text.bounded_lines("short\nlines\n") == "short\nlines\n"


@pytest.mark.parametrize("page, query, spans", [
    ("Die Straße.", "STRASSE", [(4, 10)]), ("grade 30; grade 3", "grade 3", [(10, 17)]), ("_grade 3_", "grade 3", [(1, 8)]),
    ("exam\xad\nple", "example", [(0, 9)]), ("1-\n2", "1-2", [(0, 4)]), ("1.2\nIntroduction", "1.2 introduction", [(0, 16)]), ("abc", "", []),
])
def test_literal_spans(page, query, spans):
    assert text.literal_spans(page, query) == spans


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_spans_stay_in_order(value):
    form = text.Searchable(value)
    assert len(form.text) == len(form.starts) == len(form.ends)
    assert all(0 <= a < b <= len(value) for a, b in zip(form.starts, form.ends))
    assert form.starts == sorted(form.starts)


def test_wording_and_numbers():
    assert text.contains_wording("a well-\nknown effect", "well-known") and text.contains_wording("well\nknown", "well known") and not text.contains_wording("x", "")
    assert text.contains_number("n = 3.5 (45%)", "3.5") and not text.contains_number("13.5", "3.5") and not text.contains_number("3.51", "3.5") and not text.contains_number("-3", "3") and not text.contains_number("45%", "45")
    assert text.unique_match("one Two one", "two") == ("Two", None)
    assert [text.unique_match("a b a", x)[1] for x in ("a", "z", "")] == ["ambiguous", "absent", "empty"]


@pytest.mark.parametrize("a, b, d", [("abcd", "acbd", 1), ("ca", "abc", 3), ("randomizaton", "randomization", 1), ("", "ab", 2), ("same", "same", 0)])
def test_osa(a, b, d):
    assert text.osa_distance(a, b, 5) == d
    assert text.osa_distance(a, b, 0) == min(d, 1)


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control"), ("generalizations", "gener"), ("oscillators", "oscil"), ("randomised", "randomis"), ("rate", "rate"), ("cease", "ceas")])
def test_porter_stems(word, stem):
    assert text.stem(word) == stem


def test_stems_equal_a_full_text_engine():
    import sqlite3

    words = "allocation allocated concealment participants analyses conditional rationality triplicate formative electrical hopefulness goodness revival allowance inference airliner adjustable defensible irritant replacement adoption homologous effective bowdlerize falling feed sensational digitizer operator feudalism decisiveness callousness formality sensitivity".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        assert db.execute("select term from v").fetchall() == [(text.stem(w),)], w


def test_columns(spark):
    df = spark.createDataFrame([("Grade 3\n", "grade 3"), (None, "x"), ("", "")], "t string, q string")
    rows = df.select(text.column("search_text")(F.col("t")).alias("s"), text.column("literal_spans")(F.col("t"), F.col("q")).alias("l"), text.column("unique_match")(F.col("t"), F.col("q")).alias("u"), text.column("stemmed_tokens")(F.col("t")).alias("k")).collect()
    assert rows[0].s == "grade 3" and rows[0].l == [(0, 7)] and rows[0].u.wording == "Grade 3" and rows[0].k == ["grade", "3"]
    assert rows[1].s is None and rows[1].l is None and rows[2].s == "" and rows[2].l == []


@pytest.mark.parametrize("expression, inputs, result", [
    ("82.4 - (81.1 * 42 + 100) / 43", {}, "0.86046511627906976744186047"), ("(1.18*44+6*10)/50", {}, "2.2384"),
    ("(mean * observed + added) / (observed + 1)", {"mean": "12.5", "observed": "7", "added": "-4"}, "10.4375"),
    ("(3 / 40) * 100", {}, "7.500"), ("-(-2) + .5 * (+4)", {}, "4.0"), ("0.1 + 0.2", {}, "0.3"), ("1 / 3", {}, "0.3333333333333333333333333333"), ("left - right", {"left": "-2.50", "right": "1.25"}, "-3.75"), ("2 - 3 - 4 * -2", {}, "7"), ("8/4/2", {"unused": "1"}, "1"),
])
def test_expressions(expression, inputs, result):
    assert arithmetic.calculate(expression, inputs)["result"] == result


@pytest.mark.parametrize("expression, inputs", [
    ("1 / 0", {}), ("0 / 0", {}), ("", {}), ("1 +", {}), ("unknown + 1", {}), ("NaN", {}), ("value", {"value": "NaN"}), ("value", {"value": "1e100"}), ("1e100", {}), ("1_000", {}), ("0x10", {}), ("True", {}), ("'1'", {}), ("open('file')", {}),
    ("value.real", {"value": "1"}), ("[1][0]", {}), ("2 ** 3", {}), ("8 // 2", {}), ("5 % 2", {}), ("1; 2", {}), ("1 # x", {}), ("lambda: 1", {}), ("1" * 65, {}), ("1+" * 256 + "1", {}), ("+" * 65 + "1", {}), ("value", {"value": "1" * 65}), ("value", {"value": " 1"}),
    ("1", {"bad-name": "2"}), ("1", {f"v{i}": "1" for i in range(17)}), ("*".join(["9" * 64] * 5), {}), ("*".join(["0." + "0" * 61 + "1"] * 5), {}), ("(1", {}), ("1)", {}), ("1 2", {}), ("()", {}),
])
def test_refused_expressions(expression, inputs):
    with pytest.raises(ValueError):
        arithmetic.calculate(expression, inputs)


def test_derived_values():
    assert arithmetic.calculate("a/b", {"a": "1", "b": "3"}) == {"result": "0.3333333333333333333333333333", "inexact": True, "rounded": True}
    assert arithmetic.derived("sum", ["1.10", "2.2"]) == "3.3" and arithmetic.derived("difference", ["1", "3"]) == "-2" and arithmetic.derived("ratio", ["1", "8"]) == "0.125"
