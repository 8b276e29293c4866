"""Functions of texts, numbers and files on stated examples; the SQL is a table of the expected values."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import arithmetic, windows
from evispark.functions import text as T
from evispark.operators import projections as P
from evispark.sources import documents
from evispark.sources.shipping import ship


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _table(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of values; a line feed is written as chr(10)."""
    cell = lambda v: _literal(v).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)}) as t({columns})"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    ship(spark.sparkContext)
    return spark.createDataFrame(rows, schema)


_SUMS = [
    (1, "82.4 - (81.1 * 42 + 100) / 43", {}, "0.86046511627906976744186047", True), (2, "(mean * observed + added) / (observed + 1)", {"mean": "12.5", "observed": "7", "added": "-4"}, "10.4375", False), (3, "(3 / 40) * 100", {}, "7.500", False),
    (4, "-(-2) + .5 * (+4)", {}, "4.0", False), (5, "1 / 3", {}, "0.3333333333333333333333333333", True), (6, "left - right", {"left": "-2.50", "right": "1.25"}, "-3.75", False), (7, "1 / 0", {}, None, None), (8, "2 ** 3", {}, None, None), (9, "value", {"value": "1e100"}, None, None),
]


def arithmetic_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, [row[:3] for row in _SUMS], "id int, expression string, inputs map<string,string>")
    return rows.select("id", arithmetic.column()(F.col("expression"), F.col("inputs")).alias("c")).select("id", "c.result", "c.inexact", F.col("c.refused").isNotNull().alias("refused"))


_FORMS = [(1, "“Straße—co\u00ad\nop” ﬁt", '"straße-coop" fit'), (2, "Ｆｕｌｌ   width\u200b", "full width"), (3, "low-\ndose 12-\n34", "lowdose 12-34"), (4, "e\u0301t\u00e9 naïve", "été naïve"), (5, "", ""), (6, None, None)]


def search_form_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [row[:2] for row in _FORMS], "id int, said string").select("id", F.replace(T.column("search_text")("said"), F.lit("ß"), F.lit("ss")).alias("form"))


_QUERIES = [(1, "  (Randomised), participants. ", "randomised participants"), (2, "low-dose “placebo”", "low-dose placebo"), (3, "...", ""), (4, None, None)]


def query_form_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [row[:2] for row in _QUERIES], "id int, said string").select("id", T.column("query_text")("said").alias("form"))


_CONTAINED = [
    (1, "Grade 30; grade 3.", "grade 3", True, True), (2, "Grade 30 only", "grade 3", True, False), (3, "a p of 0.05 was set", "0.05", True, True), (4, "a p of 0.051 was set", "0.05", True, False), (5, "fell by -5%", "5", True, False), (6, "low-\ndose arm", "low-dose", True, True), (7, "nothing here", "dose", False, False), (8, "x", "", False, False),
]


def containment_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, [row[:3] for row in _CONTAINED], "id int, said string, phrase string")
    return rows.select("id", T.column("contains_wording")("said", "phrase").alias("wording"), T.column("contains_number")("said", "phrase").alias("number"))


_MATCHES = [(1, "One Dose. Two doses.", "one dose", "One Dose", None), (2, "dose, dose", "dose", None, "ambiguous"), (3, "dose", "arm", None, "absent"), (4, "dose", "\u200b", None, "empty"), (5, "Fünf “Arme”", 'fünf "arme"', "Fünf “Arme”", None)]


def unique_match_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, [row[:3] for row in _MATCHES], "id int, said string, phrase string")
    return rows.select("id", T.column("unique_match")("said", "phrase").alias("m")).select("id", "m.wording", "m.reason")


_DISTANCES = [(1, "randomization", "randomisation", 1), (2, "placebo", "placbeo", 1), (3, "abc", "abc", 0), (4, "kitten", "sitting", 3), (5, "ca", "abc", 3), (6, "a", "abcdefgh", 4)]


def distance_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Distances up to 3; 4 stands for anything larger."""
    return _frame(spark, [row[:3] for row in _DISTANCES], "id int, a string, b string").select("id", T.column("osa_distance")("a", "b").alias("distance"))


_STEMS = [(1, "Allocations allocated relational", "alloc alloc relat"), (2, "ponies caresses hopping hoping", "poni caress hop hope"), (3, "Zürich's naïve_groups 3rd", "zurich s naiv group 3rd"), (4, "", "")]


def stem_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [row[:2] for row in _STEMS], "id int, said string").select("id", F.array_join(T.column("stemmed_tokens")("said"), " ").alias("stems"))


_PASSAGE = [(1, "first line\nthe dose was low\nlast line", "dose", 1, 0, 37, 1, 3), (2, "x\n" * 300 + "dose\n" + "y\n" * 300, "dose", 1, 346, 857, 174, 427), (3, "no hit", "dose", 0, None, None, None, None)]


def passage_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first passage around a query's words: whole lines that fit 512 bytes."""
    rows = _frame(spark, [row[:3] for row in _PASSAGE], "id int, said string, query string")
    found = rows.select("id", windows.passages_udf()(F.col("said"), F.col("query")).alias("p"))
    first = F.get("p", F.lit(0))
    return found.select("id", F.size("p").alias("n"), first["start"].alias("start"), first["end"].alias("end_place"), first["first_line"].alias("first_line"), first["last_line"].alias("last_line"))


_JSON = [(1, '{"b": [1, 2.50, true], "a": "é"}', '{"a":"é","b":[1,2.5,true]}'), (2, " [ ] ", "[]"), (3, '{"a": ', None), (4, None, None), (5, '{"z":{"y":null,"x":{}}}', '{"z":{"x":{},"y":null}}')]


def canonical_json_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [row[:2] for row in _JSON], "id int, said string").select("id", P.canonical_json()("said").alias("canonical"))


_KEYS = [(1, "studyFirstSubmitDateStruct", "Study first submit date"), (2, "nctId", "Nct id"), (3, "armGroup2Label", "Arm group2 label"), (4, "title", "Title"), (5, "Struct", "Struct")]


def label_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, [row[:2] for row in _KEYS], "id int, name string").select("id", P.label_words(F.col("name")).alias("label"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def _letter() -> bytes:
    """A document of a paragraph with a note, a table with a header row, and two notes."""
    cell = lambda t: f"<w:tc>{_P.format(t)}</w:tc>"
    body = f"<w:p><w:r><w:t>Hello</w:t><w:footnoteReference w:id='2'/></w:r></w:p><w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr>{cell('Arm')}{cell('N')}</w:tr><w:tr>{cell('A')}{cell('5')}</w:tr></w:tbl>"
    notes = f"<w:footnote w:id='-1'>{_P.format('line')}</w:footnote><w:footnote w:id='2'>{_P.format('A note.')}</w:footnote>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        held.writestr("word/document.xml", f"<w:document xmlns:w='{_W}'><w:body>{body}</w:body></w:document>")
        held.writestr("word/footnotes.xml", f"<w:footnotes xmlns:w='{_W}'>{notes}</w:footnotes>")
    return out.getvalue()


_FILES = [
    ("a.txt", "txt", "\ufeffLine one \r\nline  two".encode(), "Line one\nline two", False), ("b.json", "json", b'{"officialTitle": "T", "tags": ["x", true]}', "- Official title: T\n# Tags\n\n- x\n- true", False), ("c.json", "json", b'{"x": NaN}', None, True),
    ("d.docx", "docx", _letter(), "Hello[FOOTNOTE 2]\n[TABLE 1 START]\nHEADER: | Arm | N |\nROW 2: | A | 5 |\n[TABLE 1 END]\n[FOOTNOTES]\nFOOTNOTE 2: A note.", False), ("e.docx", "docx", b"no zip", None, True),
]


def file_examples(spark: SparkSession, sf: str) -> DataFrame:
    files = _frame(spark, [row[:3] for row in _FILES], "path string, format string, content binary")
    return documents.pages(files).select("path", "page", "text", F.col("error").isNotNull().alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        arithmetic_examples, search_form_examples, query_form_examples, containment_examples, unique_match_examples, distance_examples, stem_examples, passage_examples, canonical_json_examples, label_examples, file_examples,
    )
}
ORACLE = {
    "arithmetic_examples": _table("id, result, inexact, refused", [(i, r, x, r is None) for i, _, _, r, x in _SUMS]),
    "search_form_examples": _table("id, form", [(i, f and f.replace("ß", "ss")) for i, _, f in _FORMS]),
    "query_form_examples": _table("id, form", [(i, f) for i, _, f in _QUERIES]),
    "containment_examples": _table("id, wording, number", [(i, w, n) for i, _, _, w, n in _CONTAINED]),
    "unique_match_examples": _table("id, wording, reason", [(i, w, r) for i, _, _, w, r in _MATCHES]),
    "distance_examples": _table("id, distance", [(i, d) for i, _, _, d in _DISTANCES]),
    "stem_examples": _table("id, stems", [(i, s) for i, _, s in _STEMS]),
    "passage_examples": _table("id, n, start, end_place, first_line, last_line", [(i, *rest) for i, _, _, *rest in _PASSAGE]),
    "canonical_json_examples": _table("id, canonical", [(i, c) for i, _, c in _JSON]),
    "label_examples": _table("id, label", [(i, c) for i, _, c in _KEYS]),
    "file_examples": _table("path, page, text, failed", [(p, 1, t, f) for p, _, _, t, f in _FILES]),
}
