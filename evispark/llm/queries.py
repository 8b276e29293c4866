"""Queries of the text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import abuse, leaks, lookalikes, pieces, spans, tokens
from evispark.queries.general import nodes_of
from evispark.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def _span_records(spark: SparkSession, sf: str) -> DataFrame:
    """(rec, record_table, source_id, record_no, text) of pages and references as one set."""
    pages = load(spark, sf, "pages").select(F.lit("pages").alias("record_table"), "source_id", F.col("page").cast("long").alias("record_no"), "text")
    cited = load(spark, sf, "companion_reference").select(F.lit("companion_reference").alias("record_table"), F.lit("").alias("source_id"), F.col("reference_id").alias("record_no"), F.col("citation").alias("text"))
    both = pages.unionByName(cited).where(F.char_length("text") >= spans.SPAN)
    return both.withColumn("rec", F.unhex(F.md5(F.to_json(F.struct("record_table", "source_id", "record_no")))))  # 128 bits of the key


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.exact_spans(_span_records(spark, sf).select("rec", "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    records = _span_records(spark, sf).select("rec", "record_table", "source_id", "record_no")
    return records.join(_spans(spark, sf).select("rec").distinct(), "rec", "left_semi").drop("rec").distinct()


def p1_shared(spark: SparkSession, sf: str) -> DataFrame:
    records = _span_records(spark, sf).groupBy("rec", "record_table", "source_id", "record_no").agg(F.max(F.char_length("text")).alias("n_chars"))
    return records.join(spans.shared_characters(_spans(spark, sf)), "rec").drop("rec")


def p1_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that two records share with edits: chains of several exact stretches, one row each."""
    records = _span_records(spark, sf).select("rec", "record_table", "source_id", "record_no").distinct()
    found = spans.passages(spans.shared_matches(_span_records(spark, sf).select("rec", "text"))).groupBy("rec_a", "rec_b", "passage").agg(
        F.count("*").alias("n_stretches"), F.sum(F.col("end_a") - F.col("start_a")).alias("n_exact"), F.bool_or("star").alias("star"),
        *[g(c).alias(c) for c, g in (("start_a", F.min), ("end_a", F.max), ("start_b", F.min), ("end_b", F.max))],
    ).where("n_stretches > 1")
    for side in "ab":
        found = found.join(records.select(*[F.col(c).alias(f"{c}_{side}") for c in ("rec", "record_table", "source_id", "record_no")]), f"rec_{side}")
    return found.drop("rec_a", "rec_b", "passage")


def p5_items(spark: SparkSession, sf: str) -> DataFrame:
    """(item_kind, source_id, page, window_id, text) of the pages and windows that can exceed the limit.

    A window is a part of its page, so only pages above the limit are read whole.
    """
    pages = load(spark, sf, "pages").where(F.char_length("text") > 4000).select("source_id", "page", "text").dropDuplicates(["source_id", "page"])
    asked = load(spark, sf, "source_window").select("window_id", F.col("source_identity").alias("source_id"), "page", "start_line", "end_line").dropDuplicates(["window_id"])
    cut = asked.join(pages, ["source_id", "page"]).withColumn("text", pieces.line_range(F.col("text"), F.col("start_line"), F.col("end_line"))).where(F.char_length("text") > 4000)
    columns = ["item_kind", "source_id", F.col("page").cast("long").alias("page"), "window_id", "text"]
    return pages.withColumns({"item_kind": F.lit("page"), "window_id": F.lit(0).cast("long")}).select(*columns).unionByName(cut.withColumn("item_kind", F.lit("window")).select(*columns))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["item_kind", "source_id", "page", "window_id"]
    return pieces.split_items(p5_items(spark, sf), keys, "text", with_text=False).where("piece_no = 1").select(*keys)


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_items(p5_items(spark, sf), ["item_kind", "source_id", "page", "window_id"], "text")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(field, key, text) of problem 6."""
    cited = load(spark, sf, "companion_reference").select(F.lit("citation").alias("field"), F.col("reference_id").cast("string").alias("key"), F.col("citation").alias("text"))
    pages = load(spark, sf, "pages").select(F.lit("page_text").alias("field"), F.concat("source_id", F.lit(":"), F.col("page").cast("string")).alias("key"), "text")
    said = nodes_of(spark, sf, "an_d2").where("schema_path = 'answers[].justification' and kind = 'string'").select(
        F.lit("justification").alias("field"), F.concat(F.col("key").cast("string"), F.lit(":"), F.col("ordinals")[0].cast("string")).alias("key"), F.col("value").alias("text")
    )
    return cited.unionByName(pages).unionByName(said)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_texts(spark, sf))


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).dropDuplicates(["field", "key"]).select("field", "key", lookalikes.one_form(F.col("text")).alias("text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf, "documents"), "doc_id", "text")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(load(spark, sf, "documents"), load(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    verbatim = leaks.leaked_items(load(spark, sf, "documents"), load(spark, sf, "eval_items"), altered=None)
    return verbatim.where(F.col("n_words") >= leaks.WINDOW).select("doc_id", "item_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(load(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).where("review").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents")
    scored = abuse.score_documents(documents, keep=("source",))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("review").alias("n_review"), F.avg(F.col("review").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_shared, p1_passages, p5_found, p5_pieces, p6_found, p6_texts, p7_ids, p8_found, p8_leaks, p9_found, p9_scores, p9_rates)}
_SPANS = """
with r as (select 'pages' as record_table, source_id, cast(page as bigint) as record_no, any_value(text) as x from pages where length(text) >= 200 group by source_id, page
           union all select 'companion_reference', '', reference_id, any_value(citation) from companion_reference where length(citation) >= 200 group by reference_id),
w as (select record_table, source_id, record_no, i, md5(substring(x, i, 200)) as h from (select *, unnest(range(1, length(x) - 198)) as i from r)),
s as (select h from w group by h having count(distinct (record_table, source_id, record_no)) > 1),
m as (select record_table, source_id, record_no, i from w where h in (select h from s))
"""
ORACLE: dict[str, str] = {
    "p1_found": _SPANS + "select distinct record_table, source_id, record_no from m",
    "p1_shared": _SPANS
    + """, g as (select *, i - lag(i + 200) over (partition by record_table, source_id, record_no order by i) as gap from m)
select record_table, source_id, record_no, length(x) as n_chars, count(*) filter (where gap is null or gap > 0) as n_spans,
       cast(sum(case when gap is null or gap > 0 then 200 else 200 + gap end) as bigint) as n_shared
from g join r using (record_table, source_id, record_no) group by record_table, source_id, record_no, length(x)""",
    "p5_found": """
with p as (select source_id, page, any_value(text) as text from pages group by source_id, page),
w as (select window_id, any_value(source_identity) as source_id, any_value(page) as page, any_value(start_line) as a, any_value(end_line) as b from source_window group by window_id),
cut as (select w.window_id, p.source_id, p.page, array_to_string(list_slice(string_split(p.text, chr(10)), greatest(w.a, 1), w.b), chr(10)) as text
        from w join p on p.source_id = w.source_id and p.page = w.page where w.b >= greatest(w.a, 1))
select 'page' as item_kind, source_id, cast(page as bigint) as page, cast(0 as bigint) as window_id from p where length(text) > 4000
union all
select 'window', source_id, cast(page as bigint), window_id from cut where length(text) > 4000
""",
}
