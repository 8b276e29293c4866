"""Retrieval queries over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import intervals
from evispark.operators import navigation as N
from evispark.operators import projections as P
from evispark.operators import retrieval as R
from evispark.sources import load

#: a batch of up to eight independent requests
REQUESTS = [
    ("q1", "any", "allocation concealment envelopes pharmacy"), ("q2", "all", "serious adverse events placebo"), ("q3", "prefix", "random stratif"),
    ("q4", "any", "baseline differed between arms fasting glucose"), ("q5", "all", "walking distance"), ("q6", "any", "protocol amendment"),
]
PHRASES = [("p1", "phrase", "lost to follow up"), ("p2", "phrase", "handled by multiple imputation"), ("p3", "phrase", "sealed opaque envelopes")]
RECIPE = "pages.v1"
WORDS = ["alocation", "randmised", "pharmasy", "placeob", "particpants", "statisticains", "envelopse"]


def _requests(spark: SparkSession, rows=REQUESTS) -> DataFrame:
    return spark.createDataFrame(rows, "query_id string, mode string, query string")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("source_id", "page", "text").dropDuplicates(["source_id", "page"])


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_PAGES = "pg as (select source_id, page, any_value(text) as text from pages group by 1, 2)"
_WORDS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"
_TOK = f"{_PAGES}, pt as (select source_id, page, {_WORDS} as terms from pg where text is not null), tok as (select source_id, page, generate_subscripts(terms, 1) - 1 as pos, unnest(terms) as term, len(terms) as length from pt)"
_CORP = "corp as (select count(*) as n, avg(len(terms)) as avgdl from pt)"
_ORDER = """so as (select source_id, min({k: coalesce(list_position(['main_article', 'registry', 'supplement', 'sap', 'protocol', 'other'], json_extract_string(payload, '$.role')) - 1, 5), p: lower(json_extract_string(payload, '$.logical_path'))}) as o from source_index group by 1)"""


def _bm25(requests, limit: int, letters: int = 1) -> str:
    return f"""
with {_TOK}, {_CORP}, {_ORDER},
req(query_id, mode, query) as (values {_values(requests)}),
qt as (select query_id, mode, generate_subscripts(t, 1) as phrase, unnest(t) as term, len(t) as n_phrases from (select query_id, mode, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: length(x) >= {letters}) as t from req)),
hits as (select q.query_id, q.mode, q.n_phrases, q.phrase, t.source_id, t.page, t.length, count(*) as tf
         from tok t join qt q on (q.mode = 'prefix' and starts_with(t.term, q.term)) or (q.mode <> 'prefix' and t.term = q.term) group by all),
df as (select query_id, phrase, count(*) as df from hits group by 1, 2),
sc as (select query_id, mode, n_phrases, source_id, page, count(*) as n_matched,
              sum((case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) as score
       from hits join df using (query_id, phrase), corp group by 1, 2, 3, 4, 5),
ok as (select query_id, mode, source_id, page, round(score, 4) as score, n_matched, o from sc left join so using (source_id) where mode <> 'all' or n_matched = n_phrases),
top as (select *, row_number() over (partition by query_id order by score desc, o.k nulls last, o.p nulls last, source_id, page) as rank from ok qualify rank <= {limit})
"""


def _order(spark: SparkSession, sf: str) -> DataFrame:
    """The reading order of the sources."""
    rows = load(spark, sf, "source_index").select("source_id", F.get_json_object("payload", "$.role").alias("role"), F.get_json_object("payload", "$.logical_path").alias("path"))
    return R.reading_order(rows)


def _ranked(spark: SparkSession, sf: str, rows=REQUESTS, stemmed: bool = True, limit: int = 100) -> DataFrame:
    return R.ranked(R.scores(_pages(spark, sf), _requests(spark, rows), stemmed), limit, order=_order(spark, sf))


def search(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of both columns, ranked; there is no SQL for stems, the tests compare with a full-text engine."""
    return _ranked(spark, sf).select("query_id", "mode", "source_id", "page", "score", "n_matched", "rank", "source_rank")


def search_unstemmed(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, stemmed=False).select("query_id", "mode", "source_id", "page", "score", "n_matched", "rank", "source_rank")


def search_page_two(spark: SparkSession, sf: str) -> DataFrame:
    return R.result_page(_ranked(spark, sf, stemmed=False), 10, 10).select("query_id", "source_id", "page", "rank", "truncated")


def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return R.phrase_pages(_pages(spark, sf), _requests(spark, PHRASES), stemmed=False)


def search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return R.literal_pages(_pages(spark, sf), _requests(spark, PHRASES))


def search_receipt(spark: SparkSession, sf: str) -> DataFrame:
    """One receipt per query: its session identity, cursor and what it returned."""
    spec = F.to_json(F.struct("mode", "query", "query_id"))
    sessions = _requests(spark).select("query_id", P.identity(spec).alias("session"))
    hits = _ranked(spark, sf, stemmed=False).groupBy("query_id").agg(F.count("*").alias("n_returned"), F.max("rank").alias("last_rank"))
    joined = sessions.join(hits, "query_id", "left").fillna(0, ["n_returned"])
    return joined.select("query_id", "session", R.cursor(F.col("session"), 10).alias("cursor"), "n_returned", (F.col("n_returned") == 0).alias("no_hits"), F.coalesce(F.col("last_rank") == 100, F.lit(False)).alias("broad"))


def term_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_feedback(_pages(spark, sf), _requests(spark), stemmed=False)


def feedback_sources(spark: SparkSession, sf: str) -> DataFrame:
    return R.feedback_sources(R.term_feedback(_pages(spark, sf), _requests(spark), stemmed=False), _ranked(spark, sf, stemmed=False))


def spelling_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return R.spelling_catalogue(_pages(spark, sf))


def spelling_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    terms = spark.createDataFrame([(w,) for w in WORDS], "term string")
    return R.suggestions(terms, R.spelling_catalogue(_pages(spark, sf)))


def reading_leads(spark: SparkSession, sf: str) -> DataFrame:
    return R.reading_leads(_pages(spark, sf), _requests(spark), stemmed=False, order=_order(spark, sf)).select("query_id", "source_id", "page", "score", "rank")


def line_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.lines(_pages(spark, sf)).groupBy("source_id", "page").agg(F.count("*").alias("n_lines"), F.max("start").alias("last_start"), F.max(F.char_length("line")).alias("longest"))


def match_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return R.match_clusters(_pages(spark, sf), _requests(spark, PHRASES))


def navigation(spark: SparkSession, sf: str) -> DataFrame:
    return N.navigation(_pages(spark, sf))


def selected_lines(spark: SparkSession, sf: str) -> DataFrame:
    windows = load(spark, sf, "source_window").select("window_id", F.col("source_identity").alias("source_id"), "page", "start_line", "end_line").dropDuplicates(["window_id"])
    return R.select_lines(_pages(spark, sf), windows).select("window_id", F.md5("text").alias("text_hash"), F.char_length("text").alias("n_chars"))


def preview_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.windows_within(_pages(spark, sf), 512)


def search_continuation(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "search_evidence_provenance").select(F.col("session_identity").alias("session"), "rank", "evidence_identity").dropDuplicates(["session", "rank"])
    return R.continuations(rows.select("session", "rank"), rows.where("evidence_identity is not null and phase <> 'review'").select("session", "rank"))


def evidence_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each reference's whole citation has one exact place on its page: unique, ambiguous, absent or empty; a null citation is empty, a null page holds nothing."""
    cited = load(spark, sf, "companion_reference").select("reference_id", "source_id", "page", "citation").dropDuplicates(["reference_id"])
    met = cited.join(_pages(spark, sf), ["source_id", "page"])
    found = T.column("unique_match")(F.coalesce("text", F.lit("")), F.coalesce("citation", F.lit("")))
    return met.select("reference_id", found.alias("m")).select("reference_id", F.coalesce("m.reason", F.lit("unique")).alias("state"))


def source_page_read(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "companion_reference").select("source_id", "page").distinct()
    return _pages(spark, sf).join(asked, ["source_id", "page"], "left_semi").select("source_id", "page", F.char_length("text").alias("n_chars"))


def projection_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The stated projection hash of a source stands in for the hash of its bytes, which no table holds."""
    known = load(spark, sf, "source_index").select("source_id", F.get_json_object("payload", "$.projection_hash").alias("sha256"), F.get_json_object("payload", "$.media_type").alias("media_type"))
    return P.projection_hash(_pages(spark, sf), known.where("sha256 is not null and media_type is not null"), RECIPE)


def projection_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source's stated projection hash is that of its pages."""
    stated = load(spark, sf, "source_index").select("source_id", F.get_json_object("payload", "$.projection_hash").alias("projection_hash")).distinct()
    return P.reproduced(projection_hashes(spark, sf), stated)


def readable_pages(spark: SparkSession, sf: str) -> DataFrame:
    form = T.column("bounded_lines")(T.column("readable")(F.col("text")))
    return _pages(spark, sf).select("source_id", "page", F.md5(form).alias("readable_hash"), F.char_length(form).alias("n_chars"))


def search_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each page with its searchable form where it differs, else the empty text."""
    form = T.column("search_text")(F.col("text"))
    return _pages(spark, sf).select("source_id", "page", F.when(form != F.col("text"), form).otherwise("").alias("normalized_text"))


def context_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each source packed greedily into sheets of at most 65,536 bytes."""
    sized = _pages(spark, sf).where("source_id is not null").select("source_id", "page", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return intervals.packed(sized, ["source_id"], ["page"], "n_bytes", 65_536).groupBy("source_id", "sheet").agg(F.count("*").alias("n_pages"), F.sum("n_bytes").alias("n_bytes"))


def main_report_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages of each source until 20,000 bytes."""
    sized = _pages(spark, sf).where("source_id is not null").select("source_id", "page", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return intervals.byte_prefix(sized, ["source_id"], ["page"], "n_bytes", 20_000, F.floor(F.col("page") / 200))


_HASHES = f"""with {_PAGES}, kn as (select source_id, min({{a: json_extract_string(payload, '$.projection_hash'), m: json_extract_string(payload, '$.media_type')}}) as k from source_index where json_extract_string(payload, '$.projection_hash') is not null and json_extract_string(payload, '$.media_type') is not null group by 1),
ag as (select source_id, string_agg('"sha256:' || sha256(coalesce(text, '')) || '"', ',' order by page) as hs, count(*) as page_count from pg group by 1),
ph as (select source_id, page_count, 'sha256:' || sha256('{{"media_type":"' || k.m || '","page_hashes":[' || hs || '],"recipe":"{RECIPE}","source_sha256":"' || k.a || '"}}') as projection_hash from ag join kn using (source_id))
"""
_LINES = f"with {_PAGES}, ln as (select source_id, page, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select source_id, page, string_split(text, chr(10)) as l from pg where text is not null))"
QUERIES = {
    f.__name__: f
    for f in (
        search, search_unstemmed, search_page_two, search_phrase, search_literal, search_receipt, term_feedback, feedback_sources, spelling_catalogue, spelling_suggestions,
        reading_leads, line_table, match_clusters, navigation, selected_lines, preview_lines, search_continuation, evidence_selection, source_page_read, projection_hashes, projection_checks,
        readable_pages, search_forms, context_sheets, main_report_prefix,
    )
}
ORACLE = {
    "search_unstemmed": _bm25(REQUESTS, 100) + "select query_id, mode, source_id, page, score, n_matched, rank, row_number() over (partition by query_id, source_id order by rank) as source_rank from top",
    "search_page_two": _bm25(REQUESTS, 100) + "select query_id, source_id, page, rank, truncated from (select *, max(rank) over (partition by query_id) > 20 as truncated from top) where rank between 11 and 20",
    "search_phrase": f"""with {_TOK}, req(query_id, mode, query) as (values {_values(PHRASES)}),
q as (select query_id, generate_subscripts(t, 1) - 1 as ord, unnest(t) as term, len(t) as n_terms from (select query_id, regexp_extract_all(lower(query), '[a-z0-9]+') as t from req)),
runs as (select query_id, source_id, page, pos - ord as start, n_terms, count(*) as n from tok join q using (term) group by all having count(*) = n_terms)
select query_id, source_id, page, count(*) as n_hits from runs group by 1, 2, 3""",
    "search_receipt": _bm25(REQUESTS, 100) + """, h as (select query_id, count(*) as n_returned, max(rank) as last_rank from top group by 1)
select r.query_id, 'sha256:' || sha256('{"mode":"' || mode || '","query":"' || query || '","query_id":"' || r.query_id || '"}') as session,
       'sc_' || substring('sha256:' || sha256('{"mode":"' || mode || '","query":"' || query || '","query_id":"' || r.query_id || '"}'), 8, 16) || '_10' as cursor,
       coalesce(n_returned, 0) as n_returned, coalesce(n_returned, 0) = 0 as no_hits, coalesce(last_rank = 100, false) as broad from req r left join h on h.query_id = r.query_id""",
    "term_feedback": f"""with {_TOK}, req(query_id, mode, query) as (values {_values(REQUESTS)}),
q as (select query_id, generate_subscripts(t, 1) - 1 as phrase, unnest(t) as term from (select query_id, regexp_extract_all(lower(query), '[a-z0-9]+') as t from req))
select query_id, source_id, phrase, count(distinct page) as n_pages from tok join q using (term) group by 1, 2, 3""",
    "feedback_sources": _bm25(REQUESTS, 100) + """, fb as (select distinct query_id, source_id from tok join (select distinct query_id, term from qt) using (term)), hit as (select distinct query_id, source_id, 0 as h from top)
select query_id, source_id, row_number() over (partition by query_id order by coalesce(h, 1), source_id) as place from fb left join hit using (query_id, source_id) qualify place <= 64""",
    "spelling_catalogue": f"""with {_PAGES}, w as (select distinct source_id, page, word from (select source_id, page, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as word from pg) where regexp_full_match(word, '[a-z]{{5,40}}'))
select word, count(*) as n_pages, min(struct_pack(s := source_id, p := page)).s as source_id, min(struct_pack(s := source_id, p := page)).p as page from w group by 1""",
    "reading_leads": _bm25([(q, "any", t) for q, _, t in REQUESTS], 4, 5) + "select query_id, source_id, page, score, rank from top",
    "line_table": _LINES + ", s as (select *, sum(length(line) + 1) over (partition by source_id, page order by line_no rows between unbounded preceding and 1 preceding) as start from ln) select source_id, page, count(*) as n_lines, cast(coalesce(max(start), 0) as bigint) as last_start, max(length(line)) as longest from s group by 1, 2",
    "match_clusters": _LINES + f""", req(query_id, mode, query) as (values {_values(PHRASES)}),
q as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from req),
hit as (select distinct query_id, source_id, page, line_no from (select source_id, page, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from ln) join q using (term)),
isl as (select *, line_no - row_number() over (partition by query_id, source_id, page order by line_no) as g from hit),
grp as (select query_id, source_id, page, min(line_no) as first_line, max(line_no) as last_line, count(*) as n_lines from isl group by query_id, source_id, page, g)
select query_id, source_id, page, row_number() over (partition by query_id, source_id, page order by first_line) as cluster, first_line, last_line, n_lines from grp""",
    "selected_lines": f"""with {_PAGES}, w as (select window_id, any_value(source_identity) as source_id, any_value(page) as page, any_value(start_line) as a, any_value(end_line) as b from source_window group by 1),
c as (select window_id, array_to_string(list_slice(string_split(text, chr(10)), a, b), chr(10)) as t from w join pg using (source_id, page) where a >= 1 and b >= a and text is not null)
select window_id, md5(t) as text_hash, length(t) as n_chars from c where trim(replace(t, chr(10), ' ')) <> ''""",
    "preview_lines": _LINES + ", s as (select *, sum(octet_length(encode(line)) + 1) over (partition by source_id, page order by line_no rows unbounded preceding) as b from ln) select source_id, page, count(*) as n_lines, cast(max(b) as bigint) as n_bytes from s where b <= 512 group by 1, 2",
    "search_continuation": "with r as (select session_identity as session, rank, any_value(evidence_identity) as e, any_value(phase) as phase from search_evidence_provenance group by 1, 2) select session, min(rank) as next_rank from r where not (e is not null and coalesce(phase <> 'review', false)) group by 1",
    "source_page_read": f"with {_PAGES} select source_id, page, length(text) as n_chars from pg where (source_id, page) in (select source_id, page from companion_reference)",
    "projection_hashes": _HASHES + "select source_id, projection_hash, page_count from ph",
    "projection_checks": _HASHES + ", sd as (select distinct source_id, json_extract_string(payload, '$.projection_hash') as stated from source_index) select sd.source_id, case when ph.projection_hash is null then 'missing' when ph.projection_hash = stated then 'same' else 'differs' end as state from sd left join ph on ph.source_id = sd.source_id",
    "main_report_prefix": f"with {_PAGES}, s as (select source_id, page, coalesce(octet_length(encode(text)), 0) as n_bytes from pg where source_id is not null) select source_id, page, n_bytes, running from (select *, cast(sum(n_bytes) over (partition by source_id order by page rows unbounded preceding) as bigint) as running from s) where running <= 20000",
}
