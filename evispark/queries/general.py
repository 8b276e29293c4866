"""Queries of the general data problems: orphans, nested bodies, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import drift, nested, orphans
from evispark.sources import load
from evispark.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]

#: paths at which the submission forms allow one value in place of a list
FORM_LISTS = ("answers", "answers[].bases", "answers[].counterevidence", "answers[].counterevidence[].basis_indexes", "answers[].limitation", "answers[].limitations")
SUBMISSIONS = {"monarch_plus": "monarch_plus_rejected_submissions", "an_d2": "an_d2_rejected_counterpoints"}


_BASIS, _COUNTER = "answers[].bases[]", "answers[].counterevidence[]"
_OPEN = ("unresolved_premise", "premise", "stopping_rationale")
#: the schema paths that the tables read
FORM_PATHS = (
    "trial_id", "domain_id", "expected_revision", *(f"answers[].{m}" for m in ("question_id", "answer", "justification", "unknowns[]", *_OPEN)),
    *(f"{_BASIS}.{m}" for m in ("evidence", "kind", "use", "role", *_OPEN)), f"{_COUNTER}.implication", f"{_COUNTER}.basis_indexes[]",
    *(f"{of}.{name}{end}.{m}" for of in ("answers[]", _BASIS) for name in ("limitation", "limitations", "context") for end in ("", "[]") for m in _OPEN),
)


def _references(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, sf, "search_evidence_provenance").groupBy("session_identity", "rank").agg(
        F.min("recorded_at").alias("t"), F.min(orphans.normal_identity(F.col("evidence_identity"))).alias("key")
    )
    pages = load(spark, sf, "pages").where("source_id is not null").groupBy("source_id", "page").agg(F.min("captured_at").alias("t"))
    return found.select(
        F.lit("search_evidence_provenance").alias("ref_table"), F.col("session_identity").alias("ref_key"), F.col("rank").cast("long").alias("ref_no"), "key", "t"
    ).unionByName(
        pages.select(F.lit("pages").alias("ref_table"), F.col("source_id").alias("ref_key"), F.col("page").cast("long").alias("ref_no"), F.col("source_id").alias("key"), "t")
    )


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    canonical = load(spark, sf, "canonical_records").select(
        F.lit("search_evidence_provenance").alias("ref_table"), orphans.normal_identity(F.col("identity")).alias("key"), F.col("recorded_at").alias("started_at"), F.col("deleted_at").alias("ended_at")
    )
    index = load(spark, sf, "source_index").select(F.lit("pages").alias("ref_table"), F.col("source_id").alias("key"), F.col("indexed_at").alias("started_at"), F.col("deleted_at").alias("ended_at"))
    return canonical.unionByName(index)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = orphans.orphan_references(_references(spark, sf), _targets(spark, sf))
    return found.select("ref_table", "ref_key", "ref_no", "status", F.date_format("t", "yyyy-MM").alias("period"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(orphans.orphan_references(_references(spark, sf), _targets(spark, sf)))


def p2_orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The report after the last change: keys with references and without existence, from the signed deltas."""
    return counts.orphan_keys(counts.orphan_counts(orphans.signed_deltas(_references(spark, sf), _targets(spark, sf))))


_P2 = """
with refs as (
  select 'search_evidence_provenance' as ref_table, session_identity as ref_key, cast(rank as bigint) as ref_no,
         min(lower(trim(evidence_identity))) as key, min(recorded_at) as t
  from search_evidence_provenance group by session_identity, rank
  union all
  select 'pages', source_id, cast(page as bigint), source_id, min(captured_at) from pages where source_id is not null group by source_id, page
), targets as (
  select 'search_evidence_provenance' as ref_table, lower(trim(identity)) as key, recorded_at as s, deleted_at as e from canonical_records
  union all select 'pages', source_id, indexed_at, deleted_at from source_index
), judged as (
  select r.ref_table, r.ref_key, r.ref_no, r.t, count(x.key) as known,
         count(case when x.s <= r.t then 1 end) as begun,
         count(case when x.s <= r.t and (x.e is null or r.t < x.e) then 1 end) as live
  from refs r left join targets x on x.ref_table = r.ref_table and x.key = r.key
  where r.key is not null group by 1, 2, 3, 4
), orphans as (
  select ref_table, ref_key, ref_no, case when known = 0 then 'missing' when begun > 0 then 'deleted' else 'late' end as status,
         strftime(t, '%Y-%m') as period
  from judged where live = 0)
"""


def nodes_of(spark: SparkSession, sf: str, form: str) -> DataFrame:
    return nested.nodes(load(spark, sf, SUBMISSIONS[form]), "submission_id", "body", "answers", FORM_LISTS, only=FORM_PATHS)


def _tables(spark: SparkSession, sf: str) -> list[tuple[str, str, DataFrame]]:
    """(record table, form, nodes) of both submission tables."""
    return [(table, form, nodes_of(spark, sf, form)) for form, table in SUBMISSIONS.items()]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    path, at = F.col("schema_path"), F.col("ordinals")
    base = "answers[].bases[]"
    basis_premise = [f"{base}.{p}unresolved_premise" for p in ("", "limitation.", "context.")]
    answer_premise = ["answers[].unresolved_premise", "answers[].limitation[].unresolved_premise"]
    leaves = []
    for table, form, tree in _tables(spark, sf):
        child = F.when(path == f"{base}.evidence", "basis")
        if form == "monarch_plus":
            child = child.when(path.isin(*basis_premise, *answer_premise), "premise")
        else:
            child = child.when(path == "answers[].counterevidence[].basis_indexes[]", "counterpoint").when((path == "answers[].counterevidence[]") & ~F.col("kind").isin("object", "array"), "counterpoint")
        number = F.when(path.isin(*answer_premise), -1).otherwise(F.get(at, F.lit(1)))
        target = F.when(path == answer_premise[1], F.get(at, F.lit(1)).cast("string")).when(F.col("child") == "premise", "0").otherwise(F.col("value"))
        leaves.append(
            tree.where(F.col("kind") != "null").withColumn("child", child).where(F.col("child").isNotNull())
            .select(
                F.lit(table).alias("record_table"), F.col("key").cast("long").alias("submission_id"), F.get(at, F.lit(0)).cast("long").alias("answer_no"),
                "child", number.cast("long").alias("child_no"), target.alias("target"),
            )
        )
    return leaves[0].unionByName(leaves[1]).distinct()


def p3_answers(spark: SparkSession, sf: str) -> DataFrame:
    members = ("question_id", "answer", "justification", "unresolved_premise", "stopping_rationale")
    out = []
    for table, _, tree in _tables(spark, sf):
        rows = nested.flat_table(tree, "answers[]", {m: m for m in members}, steps=2)
        out.append(rows.select(F.lit(table).alias("record_table"), F.col("key").alias("submission_id"), "dewey", "parent", F.col("positions")[0].alias("answer_no"), *members))
    return out[0].unionByName(out[1])


def p3_bases(spark: SparkSession, sf: str) -> DataFrame:
    members = {"evidence": "evidence", "kind_name": "kind", "use_name": "use", "role_name": "role", "unresolved_premise": "unresolved_premise", "limitation_premise": "limitation.unresolved_premise", "context_premise": "context.unresolved_premise"}
    out = []
    for table, _, tree in _tables(spark, sf):
        rows = nested.flat_table(tree, "answers[].bases[]", members, steps=2)
        out.append(rows.select(F.lit(table).alias("record_table"), F.col("key").alias("submission_id"), "dewey", "parent", F.col("positions")[0].alias("answer_no"), F.col("positions")[1].alias("basis_no"), "evidence", F.coalesce("kind_name", "use_name", "role_name").alias("role"), F.coalesce("unresolved_premise", "limitation_premise", "context_premise").alias("unresolved_premise")))
    return out[0].unionByName(out[1])


def _both(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of both forms, with their record table."""
    trees = [tree.withColumn("record_table", F.lit(table)) for table, _, tree in _tables(spark, sf)]
    return trees[0].unionByName(trees[1])


def p3_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per readable submission; its label is that of the root."""
    members = {m: m for m in ("trial_id", "domain_id", "expected_revision")}
    out = []
    for table, _, tree in _tables(spark, sf):
        rows = nested.flat_table(tree, "", members, steps=0)
        out.append(rows.select(F.lit(table).alias("record_table"), F.col("key").alias("submission_id"), "dewey", "trial_id", "domain_id", F.col("expected_revision").cast("long").alias("expected_revision")))
    return out[0].unionByName(out[1])


def p3_limitations(spark: SparkSession, sf: str) -> DataFrame:
    """Every limitation of both forms: elements of a list, objects of a basis, and premises or rationales that stand on an answer or basis itself.

    ``holder`` is the schema path at which it stands.  ``parent`` is the label
    of its answer or basis; what stands on that itself has its label and no
    limitation_no.  An answer or basis without a premise and rationale of its
    own gives no row.
    """
    members = ("unresolved_premise", "premise", "stopping_rationale")
    basis = "answers[].bases[]"
    own = ["answers[]", basis]
    lists = [f"{of}.{name}[]" for of in own for name in ("limitation", "limitations", "context")]
    objects = [f"{of}.{name}" for of in own for name in ("limitation", "limitations", "context")]
    holders = [*own, *lists, *objects]
    path, at = F.col("schema_path"), F.col("ordinals")
    is_member = path.isin(*[f"{h}.{m}" for h in holders for m in members])
    # an object's row needs its node, an answer's or basis's own row only its members
    is_node = path.isin(*lists) | (path.isin(*objects) & ~F.col("kind").isin("array", "null"))
    found = _both(spark, sf).where(is_member | is_node).withColumns({
        "holder": F.when(is_member, F.regexp_replace(path, r"\.[^.]+$", "")).otherwise(path),
        "label": F.when(is_member, nested.parent_label(F.col("dewey"))).otherwise(F.col("dewey")),
        "member": F.when(is_member, F.regexp_extract(path, r"([^.]+)$", 1)),
    })
    rows = found.groupBy("record_table", "key", "label", "holder").agg(
        F.max(at).alias("at"), *[F.max(F.when(F.col("member") == m, F.col("value"))).alias(m) for m in members],
        F.max(F.when(~is_member & ~F.col("kind").isin("object", "null"), F.col("value"))).alias("bare"),
    )
    holder, label = F.col("holder"), F.col("label")
    on_basis, in_list = holder.startswith(basis), holder.isin(*lists)
    parent = F.when(in_list, nested.parent_label(nested.parent_label(label))).when(holder.isin(*objects), nested.parent_label(label)).otherwise(label)
    kept = rows.where(~holder.isin(*own) | F.coalesce(*members).isNotNull())
    return kept.select(
        "record_table", F.col("key").alias("submission_id"), label.alias("dewey"), parent.alias("parent"), "holder",
        F.get("at", F.lit(0)).alias("answer_no"), F.when(on_basis, F.get("at", F.lit(1))).alias("basis_no"),
        F.when(in_list, F.element_at("at", -1)).when(holder.isin(*objects), F.lit(0)).alias("limitation_no"),
        "unresolved_premise", F.coalesce("premise", "bare").alias("premise"), "stopping_rationale",
    )


def p3_counterpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Every counterpoint of both forms; a bare number is itself one index."""
    path, label = F.col("schema_path"), F.col("dewey")
    element = "answers[].counterevidence[]"
    index = (path == f"{element}.basis_indexes[]") | ((path == element) & (F.col("kind") == "number"))
    own = F.when(path == element, label).when(path == f"{element}.implication", nested.parent_label(label)).otherwise(nested.parent_label(nested.parent_label(label)))
    rows = _both(spark, sf).where(path.isin(element, f"{element}.implication", f"{element}.basis_indexes[]")).withColumn("own", own)
    return rows.groupBy(
        "record_table", F.col("key").alias("submission_id"), F.col("own").alias("dewey"), nested.parent_label(nested.parent_label(F.col("own"))).alias("parent"),
        F.col("ordinals")[0].alias("answer_no"), F.col("ordinals")[1].alias("counterpoint_no"),
    ).agg(
        F.max(F.when(path == f"{element}.implication", F.col("value"))).alias("implication"),
        F.transform(F.array_sort(F.collect_list(F.when(index & (F.col("kind") == "number"), F.struct(F.coalesce(F.get("ordinals", F.lit(2)), F.lit(0)).alias("i"), F.col("value").alias("x"))))), lambda s: s["x"]).alias("basis_indexes"),
    )


def p3_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of an answer's unknowns."""
    rows = _both(spark, sf).where("schema_path = 'answers[].unknowns[]'")
    parent = nested.parent_label(nested.parent_label(F.col("dewey")))
    return rows.select("record_table", F.col("key").alias("submission_id"), "dewey", parent.alias("parent"), F.col("ordinals")[0].alias("answer_no"), F.col("ordinals")[1].alias("unknown_no"), F.col("value").alias("unknown"))


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "canonical_records").select("identity", drift.normal_kind(F.col("kind")).alias("kind"), F.col("export_file").alias("file"), "payload")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(_payloads(spark, sf))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    records = _payloads(spark, sf)
    return drift.consistent_table(records, ["identity"], drift.alias_table(drift.changes(records)))


def _leaves_sql(table: str, premises: bool) -> str:
    """SQL of the leaves of one submission table."""
    item = lambda of, name, i: f"case json_type({of}, '$.{name}') when 'ARRAY' then json_extract({of}, '$.{name}[' || {i} || ']') else json_extract({of}, '$.{name}') end"
    size = lambda of, name: f"cast(case json_type({of}, '$.{name}') when 'ARRAY' then json_array_length({of}, '$.{name}') when 'OBJECT' then 1 when 'UBIGINT' then 1 else 0 end as bigint)"
    each = lambda of, name: f"unnest(range({size(of, name)}))"
    head = f"""
select * from (with raw as (select submission_id, any_value(body) as body from {table} group by 1), v0 as (select submission_id, cast(body as json) as j from raw where json_valid(body)),
v1 as (select submission_id, case when json_type(j) = 'VARCHAR' then cast(json_extract_string(j, '$') as json) else j end as j from v0),
v2 as (select submission_id, coalesce(json_extract(j, '$.submission'), j) as j from v1),
a as (select submission_id, i as answer_no, json_extract(j, '$.answers[' || i || ']') as a from (select submission_id, j, {each("j", "answers")} as i from v2)),
b as (select submission_id, answer_no, i as n, {item("a", "bases", "i")} as b from (select *, {each("a", "bases")} as i from a)),
"""
    basis = f"select distinct '{table}' as record_table, submission_id, answer_no, 'basis' as child, n as child_no, json_extract_string(b, '$.evidence') as target from b where json_extract_string(b, '$.evidence') is not null"
    if premises:
        any_of = " or ".join(f"json_extract_string(b, '$.{p}unresolved_premise') is not null" for p in ("", "limitation.", "context."))
        return head + f"""
l as (select submission_id, answer_no, i as n, {item("a", "limitation", "i")} as l from (select *, {each("a", "limitation")} as i from a))
{basis}
union all select '{table}', submission_id, answer_no, 'premise', n, '0' from b where {any_of}
union all select distinct '{table}', submission_id, answer_no, 'premise', -1, target from (
  select submission_id, answer_no, '0' as target from a where json_extract_string(a, '$.unresolved_premise') is not null
  union all select submission_id, answer_no, cast(n as varchar) from l where json_extract_string(l, '$.unresolved_premise') is not null))"""
    return head + f"""
c as (select submission_id, answer_no, i as n, {item("a", "counterevidence", "i")} as c from (select *, {each("a", "counterevidence")} as i from a)),
x as (select submission_id, answer_no, n, case json_type(c) when 'OBJECT' then {item("c", "basis_indexes", "i")} else c end as x from (select *, unnest(range(case json_type(c) when 'OBJECT' then {size("c", "basis_indexes")} else 1 end)) as i from c))
{basis}
union all select distinct '{table}', submission_id, answer_no, 'counterpoint', n, cast(x as varchar) from x where json_type(x) <> 'NULL')"""


_P3 = _leaves_sql(SUBMISSIONS["monarch_plus"], True) + " union all " + _leaves_sql(SUBMISSIONS["an_d2"], False)


def _items(of: str, name: str) -> str:
    """The elements of a member as a list; an object or number in place of a list is a list of one."""
    return f"case json_type({of}, '$.{name}') when 'ARRAY' then from_json(json_extract({of}, '$.{name}'), '[\"JSON\"]') when 'OBJECT' then [json_extract({of}, '$.{name}')] when 'UBIGINT' then [json_extract({of}, '$.{name}')] else [] end"


def _text(of: str, name: str) -> str:
    """The text of a member that is no object and no list."""
    return f"case when json_type({of}, '$.{name}') in ('OBJECT', 'ARRAY') then null else json_extract_string({of}, '$.{name}') end"


def _place(of: str, name: str) -> str:
    return f"(list_position(json_keys({of}), '{name}') - 1)"


_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE')"
_BODIES = f"""
with raw as (select '{SUBMISSIONS["monarch_plus"]}' as record_table, submission_id, any_value(body) as body from {SUBMISSIONS["monarch_plus"]} group by all
  union all select '{SUBMISSIONS["an_d2"]}', submission_id, any_value(body) from {SUBMISSIONS["an_d2"]} group by all),
v0 as (select record_table, submission_id, cast(body as json) as j from raw where json_valid(body)),
v1 as (select record_table, submission_id, case when json_type(j) = 'VARCHAR' then cast(json_extract_string(j, '$') as json) else j end as j from v0),
v2 as (select record_table, submission_id, coalesce(json_extract(j, '$.submission'), j) as j from v1),
v as (select record_table, submission_id, j, {_items("j", "answers")} as held from v2 where json_extract(j, '$.answers') is not null),
a as (select record_table, submission_id, generate_subscripts(held, 1) - 1 as answer_no, unnest(held) as a, '0.' || {_place("j", "answers")} as stem from v),
an as (select record_table, submission_id, cast(answer_no as int) as answer_no, a, stem || '.' || answer_no as dewey from a),
b0 as (select *, {_items("a", "bases")} as held, dewey || '.' || {_place("a", "bases")} as stem from an),
b as (select record_table, submission_id, answer_no, dewey as parent, cast(generate_subscripts(held, 1) - 1 as int) as basis_no, unnest(held) as b, stem from b0),
ba as (select record_table, submission_id, stem || '.' || basis_no as dewey, parent, answer_no, basis_no, {_text("b", "evidence")} as evidence, coalesce({_text("b", "kind")}, {_text("b", "use")}, {_text("b", "role")}) as role,
       coalesce({_text("b", "unresolved_premise")}, {_text("b", "limitation.unresolved_premise")}, {_text("b", "context.unresolved_premise")}) as unresolved_premise from b)
"""
_MEMBERS = ("question_id", "answer", "justification", "unresolved_premise", "stopping_rationale")
_P3_TABLES = {
    "p3_submissions": _BODIES + f"select record_table, submission_id, '0' as dewey, {_text('j', 'trial_id')} as trial_id, {_text('j', 'domain_id')} as domain_id, cast({_text('j', 'expected_revision')} as bigint) as expected_revision from v",
    "p3_answers": _BODIES + "select record_table, submission_id, dewey, '0' as parent, answer_no, " + ", ".join(f"{_text('a', m)} as {m}" for m in _MEMBERS) + " from an",
    "p3_bases": _BODIES + "select * from ba",
    "p3_unknowns": _BODIES
    + f""", u0 as (select *, case json_type(a, '$.unknowns') when 'ARRAY' then from_json(json_extract(a, '$.unknowns'), '["JSON"]') else [] end as held, dewey || '.' || {_place("a", "unknowns")} as stem from an)
select record_table, submission_id, stem || '.' || unknown_no as dewey, dewey as parent, answer_no, unknown_no, case when json_type(u) in ('OBJECT', 'ARRAY') then null else json_extract_string(u, '$') end as unknown
from (select record_table, submission_id, answer_no, dewey, stem, cast(generate_subscripts(held, 1) - 1 as int) as unknown_no, unnest(held) as u from u0)""",
    "p3_counterpoints": _BODIES
    + f""", c0 as (select *, {_items("a", "counterevidence")} as held, dewey || '.' || {_place("a", "counterevidence")} as stem from an),
c as (select record_table, submission_id, answer_no, dewey as parent, stem, cast(generate_subscripts(held, 1) - 1 as int) as counterpoint_no, unnest(held) as c from c0)
select record_table, submission_id, stem || '.' || counterpoint_no as dewey, parent, answer_no, counterpoint_no, case when json_type(c) = 'OBJECT' then {_text("c", "implication")} end as implication,
  case when json_type(c) = 'OBJECT' then list_transform(list_filter({_items("c", "basis_indexes")}, lambda x: json_type(x) in {_NUMBERS}), lambda x: cast(x as varchar)) when json_type(c) in {_NUMBERS} then [cast(c as varchar)] else [] end as basis_indexes from c""",
    "support_mix": _BODIES + "select record_table, role, count(*) as n, count(evidence) as n_supported, count(unresolved_premise) as n_open from ba group by 1, 2",
    "answer_observations": _BODIES
    + f""", n as (select record_table, submission_id, answer_no, count(*) as n from ba group by 1, 2, 3), t as (select *, {_text("a", "justification")} as said from an)
select record_table, submission_id, answer_no, sha256(said) as digest, octet_length(encode(said)) as n_bytes, coalesce(n, 0) as n_bases from t left join n using (record_table, submission_id, answer_no)""",
}
_P4 = """
with r as (select replace(lower(trim(kind)), '-', '_') as kind, export_file as file, payload from canonical_records),
fs as (select kind, file, row_number() over (partition by kind order by file) as seq from (select distinct kind, file from r)),
ok as (select kind, file, payload from r where json_valid(payload) and json_type(case when json_valid(payload) then payload end) = 'OBJECT'),
kv as (select kind, file, field, json_extract(payload, '$."' || field || '"') as v from (select kind, file, payload, unnest(json_keys(payload)) as field from ok)),
ty as (select kind, seq, field, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as type, cast(v as varchar) as v from kv join fs using (kind, file) where json_type(v) <> 'NULL'),
pr as (select kind, seq, field, type from (select kind, seq, field, type, row_number() over (partition by kind, seq, field order by count(*) desc, type) as p from ty group by 1, 2, 3, 4) where p = 1),
new as (select a.* from pr a left join pr b on a.kind = b.kind and a.field = b.field and b.seq = a.seq - 1 where b.kind is null and a.seq > 1),
gone as (select a.kind, a.seq + 1 as seq, a.field, a.type from pr a left join pr b on a.kind = b.kind and a.field = b.field and b.seq = a.seq + 1 join fs on fs.kind = a.kind and fs.seq = a.seq + 1 where b.kind is null),
ret as (select b.kind, b.seq, b.field from pr a join pr b on a.kind = b.kind and a.field = b.field and b.seq = a.seq + 1 and a.type <> b.type),
pairs as (select g.kind, g.seq, g.field as old, n.field as fresh from gone g join new n on g.kind = n.kind and g.seq = n.seq and g.type = n.type),
hits as (select p.kind, p.seq, old, fresh, count(*) as n, count(*) filter (where exists (select 1 from ty o where o.kind = p.kind and o.field = p.old and o.seq < p.seq and o.v = d.v)) as h
         from pairs p join (select distinct kind, seq, field, v from ty) d on d.kind = p.kind and d.seq = p.seq and d.field = p.fresh group by 1, 2, 3, 4),
ren as (select * from (select *, row_number() over (partition by kind, seq, old order by h / n desc, fresh) as a, row_number() over (partition by kind, seq, fresh order by h / n desc, old) as b from hits where h >= 0.5 * n) where a = 1 and b = 1),
ch as (select kind, seq, field, 'added' as change, '' as new_field from new where (kind, seq, field) not in (select kind, seq, fresh from ren)
       union all select kind, seq, field, 'removed', '' from gone where (kind, seq, field) not in (select kind, seq, old from ren)
       union all select kind, seq, field, 'retyped', '' from ret
       union all select kind, seq, old, 'renamed', fresh from ren)
select kind, file as export_file, field, change, new_field from ch join fs using (kind, seq)
"""
QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_counts, p2_orphan_keys, p3_found, p3_submissions, p3_answers, p3_bases, p3_limitations, p3_counterpoints, p3_unknowns, p4_found, p4_records)
}
ORACLE: dict[str, str] = {
    "p2_found": _P2 + "select ref_table, ref_key, ref_no, status, period from orphans",
    "p3_found": _P3,
    **{k: v for k, v in _P3_TABLES.items() if k.startswith("p3_")},
    "p4_found": _P4,
    "p2_orphan_keys": _P2
    + """, r as (select ref_table, key, count(*) as n_references from refs where key is not null group by 1, 2),
x as (select ref_table, key, count(*) filter (where s is not null and (e is null or e > s)) - count(*) filter (where e > s) as n_existing from targets where key is not null group by 1, 2)
select r.ref_table, r.key, n_references, coalesce(n_existing, 0) as n_existing from r left join x on x.ref_table = r.ref_table and x.key = r.key where coalesce(n_existing, 0) <= 0""",
    "p2_counts": _P2 + "select ref_table, period, status, count(*) as n from orphans group by 1, 2, 3",
}
