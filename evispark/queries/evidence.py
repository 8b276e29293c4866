"""Queries of passages, bindings and record checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import windows
from evispark.operators import binding, decisions, navigation, projections
from evispark.operators import retrieval as R
from evispark.queries import general
from evispark.queries.retrieval import _order, _pages, _requests
from evispark.sources import load


def search_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of each query's best ten pages, ranked by page and place."""
    asked, pages = _requests(spark), _pages(spark, sf)
    hits = R.ranked(R.scores(pages, asked), 10, order=_order(spark, sf)).select("query_id", "source_id", "page", "rank")
    met = hits.join(pages, ["source_id", "page"]).join(F.broadcast(asked.select("query_id", "query")), "query_id")  # at most eight requests
    found = met.select("query_id", "source_id", "page", "rank", F.posexplode(windows.passages_udf()(F.col("text"), F.col("query"))).alias("cluster", "p"))
    return found.select("query_id", "source_id", "page", "rank", "cluster", "p.*")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "companion_reference").where("citation is not null").groupBy("reference_id").agg(F.min("source_id").alias("source_id"), F.min("citation").alias("citation"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, reference_id, values): every sentence and line of each citation."""
    parts = F.filter(F.split("citation", r"\. |\n"), lambda part: part != "")
    return _cited(spark, sf).select("source_id", "reference_id", parts.alias("values")).where(F.size("values") > 0)


def leaf_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """For each sentence of a citation the first page of its source that holds it."""
    leaves = _sentences(spark, sf).select("source_id", "reference_id", F.posexplode("values").alias("part_no", "value"))
    return binding.bound(leaves, _pages(spark, sf), ["source_id"], ["reference_id", "part_no"], ["page"])


def leaf_defects(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences that no page of their source holds."""
    return binding.defects(leaf_bindings(spark, sf), ["page"])


def coherent_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """For each citation the first page that holds all its sentences, in whatever order, and how many pages do."""
    held = binding.coherent(_pages(spark, sf), _sentences(spark, sf).withColumnRenamed("reference_id", "tuple"), ["source_id"], ["page"])
    return held.groupBy("source_id", F.col("tuple").alias("reference_id")).agg(F.min("page").alias("page"), F.count("*").alias("n_pages"))


def citation_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """For each reference the first page of its source that holds the whole citation."""
    leaves = _cited(spark, sf).select("source_id", "reference_id", F.col("citation").alias("value")).where("value <> ''")
    return binding.bound(leaves, _pages(spark, sf), ["source_id"], ["reference_id"], ["page"])


def citation_defects(spark: SparkSession, sf: str) -> DataFrame:
    """The references whose whole citation no page of their source holds."""
    return binding.defects(citation_bindings(spark, sf), ["page"])


def resolved_sources(spark: SparkSession, sf: str) -> DataFrame:
    handle = F.concat(F.lit("sh_"), F.substring("source_id", 8, 16)).alias("handle")
    asked = load(spark, sf, "companion_reference").select("reference_id", "trial_id", handle).distinct()
    known = load(spark, sf, "source_index").select("trial_id", "source_id").distinct().select("trial_id", handle)
    return binding.resolved(asked, known, ["trial_id"], "handle")


def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "canonical_records").groupBy("identity").agg(*[F.min(c).alias(c) for c in ("payload_hash", "batch_id", "trial_id", "recorded_at", "deleted_at")])
    rules = {
        "hash_format": F.col("payload_hash").rlike("^sha256:[0-9a-f]{64}$"), "batch_known": F.col("batch_id").isNotNull(), "trial_known": F.col("trial_id").isNotNull(),
        "lives_forward": F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("recorded_at")),
    }
    return binding.violations(rows, ["identity"], rules)


def window_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_window").select("window_id", "start_line", "end_line", "page").distinct()
    return binding.violations(rows, ["window_id"], {"starts": F.col("start_line") >= 1, "ordered": F.col("end_line") >= F.col("start_line"), "paged": F.col("page") >= 1})


def registry_sections(spark: SparkSession, sf: str) -> DataFrame:
    """First and last line of each numbered section of a page."""
    cut = R.lines(_pages(spark, sf))
    heading = F.when(F.col("line").rlike(r"^\d+\.\d+ \S"), F.col("line"))
    w = F.last(heading, ignorenulls=True)

    carried = cut.withColumn("section", w.over(Window.partitionBy("source_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return carried.where("section is not null").groupBy("source_id", "page", "section").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def flow_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Unread windows below headings of participant flow in the supplements."""
    listed = load(spark, sf, "source_index").where(F.get_json_object("payload", "$.role") == "supplement").select("source_id").distinct()
    pages = _pages(spark, sf).join(listed, "source_id", "left_semi")
    reads = load(spark, sf, "source_window").select(F.col("source_identity").alias("source_id"), "page", F.col("start_line").cast("long").alias("first"), F.col("end_line").cast("long").alias("last"))
    return navigation.flow_captions(navigation.navigation(pages), pages, reads)


def answer_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest kind of basis of each answer of both forms."""
    rows = general.p3_bases(spark, sf).select("record_table", "submission_id", "answer_no", F.col("role").alias("kind"))
    return decisions.sufficiency(rows, ["record_table", "submission_id", "answer_no"])


def answer_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Digest, bytes and counts of each answer, without its prose."""
    answers = general.p3_answers(spark, sf)
    counts = general.p3_bases(spark, sf).groupBy("record_table", "submission_id", "answer_no").agg(F.count("*").alias("n_bases"))
    joined = answers.join(counts, ["record_table", "submission_id", "answer_no"], "left").fillna(0, ["n_bases"])
    return joined.select("record_table", "submission_id", "answer_no", F.sha2("justification", 256).alias("digest"), F.octet_length("justification").alias("n_bytes"), "n_bases")


def assessment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per submission its answers by question, as a map."""
    rows = general.p3_answers(spark, sf)
    return rows.groupBy("record_table", "submission_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("question_id", "answer")))).alias("answers"))


def scrubbed_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of the source payloads without identities and paths."""
    rows = load(spark, sf, "source_index").select(F.concat_ws("|", "source_id", "payload").alias("row"), "payload").distinct()
    kept = projections.leaf_table(rows, "row", "payload", ("logical_path", "projection_hash", "id"))
    return kept.select(F.split("row", r"\|")[0].alias("source_id"), "path", "value").distinct()


def support_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Bases by form and kind, with and without evidence."""
    return general.p3_bases(spark, sf).groupBy("record_table", "role").agg(F.count("*").alias("n"), F.count("evidence").alias("n_supported"), F.count("unresolved_premise").alias("n_open"))


def default_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and event type whether it was seen, false where it never was."""
    kinds = ["view", "click", "purchase", "signup", "error"]
    seen = load(spark, sf, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_set(F.struct("event_type", F.lit(True)))).alias("m"))
    return seen.select("user_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(False)).alias(k) for k in kinds])


def import_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per phase the rows that came, those delivered again, and those without evidence."""
    rows = load(spark, sf, "search_evidence_provenance").groupBy("session_identity", "rank").agg(F.count("*").alias("n"), F.min("phase").alias("phase"), F.min("evidence_identity").alias("e"))
    return rows.groupBy("phase").agg(F.sum("n").alias("records"), F.count("*").alias("imported"), F.sum(F.col("n") - 1).alias("ignored"), F.count_if(F.col("e").isNull()).alias("without_evidence"), F.count_distinct("session_identity").alias("searches"))


QUERIES = {
    f.__name__: f
    for f in (
        search_passages, leaf_bindings, leaf_defects, coherent_anchors, citation_bindings, citation_defects, resolved_sources, record_violations, window_violations, registry_sections, flow_headings,
        answer_sufficiency, answer_observations, assessment_summary, scrubbed_leaves, support_mix, default_flags, import_counts,
    )
}
_PG = "pg as (select source_id, page, any_value(text) as text from pages group by 1, 2)"
_CITED = "ci as (select reference_id, min(source_id) as source_id, min(citation) as citation from companion_reference where citation is not null group by 1)"
_PARTS = f"with {_PG}, {_CITED}, sp as (select source_id, reference_id, list_filter(string_split_regex(citation, '\\. |\\n'), lambda x: x <> '') as v from ci), lf as (select source_id, reference_id, generate_subscripts(v, 1) - 1 as part_no, unnest(v) as value from sp)"
_BOUND = _PARTS + ", bd as (select lf.source_id, lf.reference_id, lf.part_no, min(page) as page from lf left join pg on pg.source_id = lf.source_id and contains(pg.text, lf.value) group by 1, 2, 3)"
_WHOLE = f"with {_PG}, {_CITED}, bd as (select ci.source_id, ci.reference_id, min(page) as page from ci left join pg on pg.source_id = ci.source_id and contains(pg.text, ci.citation) where ci.citation <> '' group by 1, 2)"
_LN = f"with {_PG}, ln as (select source_id, page, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select source_id, page, string_split(text, chr(10)) as l from pg where text is not null))"
ORACLE = {
    **{k: general._P3_TABLES[k] for k in ("support_mix", "answer_observations")},
    "leaf_bindings": _BOUND + " select source_id, reference_id, part_no, page from bd",
    "leaf_defects": _BOUND + " select source_id, reference_id, part_no from bd where page is null",
    "coherent_anchors": _PARTS + ", co as (select lf.source_id, pg.page, reference_id from lf join pg on pg.source_id = lf.source_id where text is not null group by 1, 2, 3 having bool_and(contains(text, value))) select source_id, reference_id, min(page) as page, count(*) as n_pages from co group by 1, 2",
    "citation_bindings": _WHOLE + " select source_id, reference_id, page from bd",
    "citation_defects": _WHOLE + " select source_id, reference_id from bd where page is null",
    "resolved_sources": "with k as (select trial_id, 'sh_' || substring(source_id, 8, 16) as handle, count(*) as n from (select distinct trial_id, source_id from source_index) group by 1, 2), a as (select distinct reference_id, trial_id, 'sh_' || substring(source_id, 8, 16) as handle from companion_reference) select reference_id, a.trial_id, a.handle, coalesce(n, 0) as n_matches from a left join k on k.trial_id = a.trial_id and k.handle = a.handle",
    "record_violations": "with r as (select identity, min(payload_hash) as h, min(batch_id) as b, min(trial_id) as t, min(recorded_at) as ra, min(deleted_at) as da from canonical_records group by 1) select identity, 'hash_format' as rule from r where not coalesce(regexp_matches(h, '^sha256:[0-9a-f]{64}$'), false) union all select identity, 'batch_known' from r where b is null union all select identity, 'trial_known' from r where t is null union all select identity, 'lives_forward' from r where not coalesce(da is null or da > ra, false)",
    "window_violations": "with w as (select distinct window_id, start_line as a, end_line as b, page as p from source_window) select window_id, 'starts' as rule from w where not coalesce(a >= 1, false) union all select window_id, 'ordered' from w where not coalesce(b >= a, false) union all select window_id, 'paged' from w where not coalesce(p >= 1, false)",
    "registry_sections": _LN + ", c as (select *, last_value(case when regexp_matches(line, '^\\d+\\.\\d+ \\S') then line end ignore nulls) over (partition by source_id, page order by line_no rows unbounded preceding) as section from ln) select source_id, page, section, min(line_no) as first_line, max(line_no) as last_line from c where section is not null group by 1, 2, 3",
    "scrubbed_leaves": "with lv as (select distinct source_id, '/' || k as path, json_extract_string(payload, '$.' || k) as value from (select source_id, payload, unnest(json_keys(payload)) as k from source_index)) select source_id, path, value from lv where path not in ('/logical_path', '/projection_hash', '/id')",
    "default_flags": "select user_id, " + ", ".join(f"bool_or(event_type = '{k}') as {k}" for k in ("view", "click", "purchase", "signup", "error")) + " from events group by 1",
    "import_counts": "with r as (select session_identity, rank, count(*) as n, min(phase) as phase, min(evidence_identity) as e from search_evidence_provenance group by 1, 2) select phase, cast(sum(n) as bigint) as records, count(*) as imported, cast(sum(n - 1) as bigint) as ignored, count(*) filter (where e is null) as without_evidence, count(distinct session_identity) as searches from r group by 1",
}
