"""Queries of the relational operators: joins, windows, scoring, intervals, sets, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import decisions as D
from evispark.operators import comparison, flow, intervals, lineage, scoring, sets
from evispark.operators import projections as P
from evispark.sources import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that states the same over whole tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _level(column: str):
    return F.element_at(F.array(*map(F.lit, D.LEVELS)), (F.col(column) % 3 + 1).cast("int"))


def _sql_level(column: str) -> str:
    return f"(['low', 'some_concerns', 'high'])[cast({column} % 3 + 1 as int)]"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _level("o_orderkey").alias("label"), _level("o_custkey").alias("prediction"))


_SQL_PAIRS = f"p as (select o_orderkey, o_custkey, o_orderstatus, {_sql_level('o_orderkey')} as label, {_sql_level('o_custkey')} as prediction from orders)"


# --- aggregation and scoring


@query("select user_id, count(*) filter (where event_type = 'purchase') as n, count(*) filter (where event_type = 'click') as d, case when count(*) filter (where event_type = 'click') = 0 then 0.0 else round(count(*) filter (where event_type = 'purchase') * 1.0 / count(*) filter (where event_type = 'click'), 6) end as rate, case when count(*) filter (where event_type = 'click') = 0 then null else round(count(*) filter (where event_type = 'purchase') * 1.0 / count(*) filter (where event_type = 'click'), 6) end as nullable_rate from events group by 1")
def rates(spark: SparkSession, sf: str) -> DataFrame:
    n, d = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click")
    counted = load(spark, sf, "events").groupBy("user_id").agg(n.alias("n"), d.alias("d"))
    return counted.select("user_id", "n", "d", F.round(scoring.rate(F.col("n"), F.col("d")), 6).alias("rate"), F.round(scoring.nullable_rate(F.col("n"), F.col("d")), 6).alias("nullable_rate"))


@query(f"with {_SQL_PAIRS}, c as (select label, prediction, count(*) as n from p group by 1, 2), u as (select label as x from c union select prediction from c) select a.x as label, b.x as prediction, coalesce(n, 0) as n from u a cross join u b left join c on c.label = a.x and c.prediction = b.x")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confusion(_pairs(spark, sf))


@query(f"with {_SQL_PAIRS}, l as (select label, count(*) as n, count(*) filter (where label = prediction) as h from p group by 1) select cast(sum(n) as bigint) as n, cast(sum(h) as bigint) as correct, round(sum(h) / sum(n), 6) as accuracy, round(avg(h / n), 6) as balanced_accuracy from l")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.agreement(_pairs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("accuracy", "balanced_accuracy")})


@query(f"with {_SQL_PAIRS}, l as (select label, count(*) as n from p group by 1) select (select label from l order by n desc, label desc limit 1) as majority, round(max(n) / sum(n), 6) as majority_share, round(coalesce(sum(n) filter (where label = 'low'), 0) / sum(n), 6) as always_share from l")
def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.baselines(_pairs(spark, sf), "low").withColumns({c: F.round(c, 6) for c in ("majority_share", "always_share")})


@query("with s as (select o_orderstatus, o_custkey % 3 - o_orderkey % 3 as d from orders) select o_orderstatus, count(*) as n, count(*) filter (where d = 0) as exact, count(*) filter (where d > 0) as overcalls, cast(coalesce(sum(d) filter (where d > 0), 0) as bigint) as over_steps, count(*) filter (where d < 0) as undercalls, cast(coalesce(sum(-d) filter (where d < 0), 0) as bigint) as under_steps from s group by 1")
def ordinal_errors(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.ordinal_errors(_pairs(spark, sf), list(D.LEVELS), ["o_orderstatus"])


@query("select event_type, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.975), 6) as p975 from events group by 1")
def linear_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.975)))
    return load(spark, sf, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p975"))])


@query("select user_id, count(*) as attempts, count(distinct event_type) as cases, count(*) - count(distinct event_type) as retries, count(*) filter (where value > 1) as known_cost, count(*) filter (where value is null or value <= 1) as unknown_cost, round(sum(value) filter (where value > 1), 2) as cost from events group by 1")
def attempt_accounting(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").withColumn("cost", F.when(F.col("value") > 1, F.col("value")))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.count_distinct("event_type").alias("cases"), (F.count("*") - F.count_distinct("event_type")).alias("retries"),
        F.count("cost").alias("known_cost"), F.count_if(F.col("cost").isNull()).alias("unknown_cost"), F.round(F.sum(F.col("cost").cast("decimal(20,6)")), 2).cast("double").alias("cost"),
    )


@query("select rater, toxic, count(*) as n, count(distinct doc_id) as n_documents from labels group by 1, 2")
def adjudication(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").groupBy("rater", "toxic").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))


@query("with e as (select event_type as stage, case when value < 2 then null else value > 10 end as o from events) select stage, count(o) as known, count(*) - count(o) as unknown, count(*) filter (where o) as observed, case when count(o) = 0 then 0.0 else round(count(*) filter (where o) / count(o), 6) end as observed_rate from e group by 1")
def stage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") >= 2, F.col("value") > 10).alias("observed"))
    return scoring.stage_funnel(rows).withColumn("observed_rate", F.round("observed_rate", 6))


@query("with u as (select user_id, bool_or(event_type = 'view') as v, bool_or(event_type = 'click') as c, bool_or(event_type = 'signup') as s, bool_or(event_type = 'purchase') as p from events group by 1) select user_id, case when not v then 'view' when not c then 'click' when not s then 'signup' when not p then 'purchase' end as stage from u")
def earliest_missing_stage(spark: SparkSession, sf: str) -> DataFrame:
    stages = ["view", "click", "signup", "purchase"]
    seen = load(spark, sf, "events").groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == s).alias(s) for s in stages])
    return seen.select("user_id", scoring.earliest_missing(seen, stages).alias("stage"))


@query("select session_identity, min(rank) filter (where evidence_identity is not null) as best_rank from search_evidence_provenance group by 1")
def best_rank(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "search_evidence_provenance").groupBy("session_identity").agg(F.min(F.when(F.col("evidence_identity").isNotNull(), F.col("rank"))).alias("best_rank"))


@query("with l as (select user_id, event_type as part, case when count(*) > 20 then 'high' else 'low' end as label from events group by 1, 2) select user_id, string_agg(label, ' | ' order by part) as vector from l group by 1 having count(*) = 5")
def exact_vectors(spark: SparkSession, sf: str) -> DataFrame:
    labels = load(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("part")).agg(F.when(F.count("*") > 20, "high").otherwise("low").alias("label"))
    return scoring.exact_vectors(labels, ["user_id"], 5)


@query("select n_draws, any_correct, all_correct, count(*) as n from (select o_custkey, count(*) as n_draws, bool_or(o_orderstatus = 'F') as any_correct, bool_and(o_orderstatus = 'F') as all_correct from orders group by 1) group by 1, 2, 3")
def draws(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("correct"))
    return scoring.draws(rows, ["o_custkey"]).groupBy("n_draws", "any_correct", "all_correct").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, grouping(l_returnflag) + 0 as pooled_flag, count(*) as n, cast(sum(l_linenumber) as bigint) as lines from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    return rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("pooled_flag"), F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")
    )


@query()
def cluster_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Share of found evidence with whole trials drawn."""
    clusters = load(spark, sf, "search_evidence_provenance").where("trial_id is not null").groupBy(F.col("trial_id").alias("cluster")).agg(F.count("evidence_identity").alias("n"), F.count("*").alias("d"))
    return scoring.cluster_interval(clusters, 7)


@query()
def poisson_interval(spark: SparkSession, sf: str) -> DataFrame:
    clusters = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count("*").alias("d"))
    return scoring.poisson_interval(clusters)


@query("with d as (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as d from events) select user_id, cast(sum(case when d >= 0 then round(d / 1000.0) end) as bigint) as elapsed_ms from d group by 1")
def elapsed(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = load(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).alias("d"))
    return d.groupBy("user_id").agg(F.sum(F.when(F.col("d") >= 0, F.round(F.col("d") / 1000.0))).cast("bigint").alias("elapsed_ms"))


@query("with p as (select l_orderkey, sum(l_linenumber) as parts from lineitem group by 1) select o_orderkey, cast(coalesce(case when o_orderstatus = 'O' then o_custkey end, parts) as bigint) as metric from orders left join p on l_orderkey = o_orderkey")
def fallback_metric(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_linenumber").alias("parts"))
    rows = load(spark, sf, "orders").join(parts, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")), "parts").alias("metric"))


@query("select session_identity, count(distinct rank) = max(rank) as complete, max(rank) as last_rank from search_evidence_provenance group by 1")
def session_complete(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "search_evidence_provenance").groupBy("session_identity").agg((F.count_distinct("rank") == F.max("rank")).alias("complete"), F.max("rank").alias("last_rank"))


@query("with a as (select l_shipdate < timestamp '1997-01-01' as old, l_suppkey, count(*) filter (where l_returnflag = 'A') as n, count(*) as d from lineitem group by 1, 2) select b.l_suppkey, b.n as left_n, c.n as right_n, (b.d > 0 and c.d > 0 and c.n * b.d >= b.n * c.d) as not_worse from a b join a c on b.l_suppkey = c.l_suppkey and b.old and not c.old")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    old = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")
    rows = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(old & (F.col("l_returnflag") == "A")).alias("left_n"), F.count_if(old).alias("left_d"), F.count_if(~old & (F.col("l_returnflag") == "A")).alias("right_n"), F.count_if(~old).alias("right_d")
    )
    return rows.where("left_d > 0 and right_d > 0").select("l_suppkey", "left_n", "right_n", scoring.not_worse(rows).alias("not_worse"))


@query("select user_id, count(distinct event_type) = 1 as one_session, list_sort(list(distinct event_type)) as tools, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as tokens from events group by 1")
def trace_facts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("user_id").agg(
        (F.count_distinct("event_type") == 1).alias("one_session"), F.array_sort(F.collect_set("event_type")).alias("tools"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens")
    )


_ATTEMPTS = """o as (select cast(o_orderkey as varchar) as attempt_id, o_orderpriority as arm_id, cast(o_custkey as varchar) as cell_id, o_orderstatus as prediction, case when o_totalprice > 50000 then 'assessed' else 'failed' end as status, o_totalprice as cost from orders),
lb as (select cast(c_custkey as varchar) as cell_id, case when c_nationkey % 2 = 0 then 'O' else 'F' end as label from customer)"""


def _outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders read as attempts of arms (priorities) at cells (customers), with a label per cell."""
    rows = load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("attempt_id"), F.col("o_orderpriority").alias("arm_id"), F.col("o_custkey").cast("string").alias("cell_id"), F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderstatus").alias("prediction"),
        F.when(F.col("o_totalprice") > 50000, "assessed").otherwise("failed").alias("status"), F.lit("direct").alias("support"), F.lit(True).alias("completion"), F.lit(1).alias("latency_ms"), F.col("o_totalprice").alias("cost"), F.lit(1).alias("context_bytes"), F.lit(1).alias("tool_calls"),
    )
    labels = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F").alias("label"))
    return rows, labels


@query(f"with {_ATTEMPTS} select arm_id, count(*) as attempts, count(*) filter (where status = 'assessed' and label is not null) as n_scored, round(count(*) filter (where status = 'assessed' and label = prediction) / nullif(count(*) filter (where status = 'assessed' and label is not null), 0), 6) as accuracy, round(sum(cost) / 1000, 1) as cost from o left join lb using (cell_id) group by 1")
def comparison_arms(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.arm_metrics(*_outcomes(spark, sf)).select("arm_id", "attempts", "n_scored", F.round("accuracy", 6).alias("accuracy"), F.round(F.col("cost") / 1000, 1).alias("cost"))


@query(f"with {_ATTEMPTS} select arm_id, label, count(*) as n, round(avg(case when prediction = label then 1.0 else 0.0 end), 6) as recall from o join lb using (cell_id) where status = 'assessed' group by 1, 2")
def comparison_recall(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.class_recall(*_outcomes(spark, sf)).withColumn("recall", F.round("recall", 6))


@query(f"""with {_ATTEMPTS}, e as (select arm_id, cell_id, count(*) as n, min(prediction) as p from o group by 1, 2), pr as (select distinct arm_id from o),
m as (select l.arm_id as "left", r.arm_id as "right", l.n = 1 and r.n = 1 as alone, l.p as pl, r.p as p2, label from e l join e r on r.cell_id = l.cell_id and l.arm_id < r.arm_id left join lb on lb.cell_id = l.cell_id)
select "left", "right", count(*) as matched_cells, count(*) filter (where not alone) as ambiguous_cells, count(*) filter (where alone and pl = p2) as same_prediction, count(*) filter (where alone and pl <> p2) as different_prediction,
round(count(*) filter (where alone and pl = label) / nullif(count(*) filter (where alone and label is not null), 0), 6) as left_accuracy, round(count(*) filter (where alone and p2 = label) / nullif(count(*) filter (where alone and label is not null), 0), 6) as right_accuracy from m group by 1, 2""")
def comparison_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows, labels = _outcomes(spark, sf)
    arms = rows.select("arm_id").distinct()
    pairs = F.broadcast(arms.select(F.col("arm_id").alias("left"))).join(F.broadcast(arms.select(F.col("arm_id").alias("right"))), F.col("left") < F.col("right")).withColumn("id", F.concat_ws("|", "left", "right"))  # a plan of a few arms
    return comparison.pair_metrics(rows, pairs, labels, ["cell_id"]).drop("id").withColumns({c: F.round(c, 6) for c in ("left_accuracy", "right_accuracy")})


@query(f"with {_ATTEMPTS} select 'retries' as rule, arm_id || '|' || cell_id as subject from o group by arm_id, cell_id having count(*) > 6 union all select 'budget', 'attempts' from o having count(*) > 1000")
def comparison_violations(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.violations(_outcomes(spark, sf)[0], 6, {"attempts": 1000, "tool_calls": 10**12})


# --- joins


@query("select count(*) as n, count(distinct page) as n_pages from pages where source_id in (select source_id from source_index where deleted_at is null)")
def scope_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    scope = load(spark, sf, "source_index").where("deleted_at is null").select("source_id")
    return load(spark, sf, "pages").join(scope, "source_id", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("page").alias("n_pages"))


@query("select distinct session_identity, rank from search_evidence_provenance s where not exists (select 1 from companion_reference c where c.trial_id = s.trial_id and c.page = s.rank)")
def unassigned_evidence(spark: SparkSession, sf: str) -> DataFrame:
    taken = load(spark, sf, "companion_reference").select("trial_id", F.col("page").alias("rank"))
    return load(spark, sf, "search_evidence_provenance").join(taken, ["trial_id", "rank"], "left_anti").select("session_identity", "rank").distinct()


@query("with s as (select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) select s.o_custkey, s.o_orderstatus, c.c_mktsegment from s join customer c on c.c_custkey = s.o_custkey")
def selected_attempts(spark: SparkSession, sf: str) -> DataFrame:
    chosen = scoring.selected_attempts(load(spark, sf, "orders"), ["o_custkey"], "o_orderkey")
    return chosen.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_custkey", "o_orderstatus", "c_mktsegment")


@query("with o as (select o_custkey, min(o_orderstatus) as s from orders group by 1) select c_custkey, coalesce(s, 'missing') as disposition from customer left join o on o_custkey = c_custkey")
def planned_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    seen = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("disposition"))
    return scoring.dispositions(load(spark, sf, "customer"), seen, ["c_custkey"], "disposition")


@query("select r_name, e.event_type, d, count(x.event_id) as n from region cross join (select distinct event_type from events) e cross join (select unnest([1, 2, 3]) as d) left join events x on x.event_type = e.event_type and x.user_id % 5 = r_regionkey and x.event_id % 3 + 1 = d group by 1, 2, 3")
def cross_plan(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    plan = load(spark, sf, "region").select("r_regionkey", "r_name").crossJoin(F.broadcast(events.select("event_type").distinct())).crossJoin(F.broadcast(spark.range(1, 4).select(F.col("id").alias("d"))))  # a plan of arms, cases and draws
    seen = events.groupBy(F.col("event_type"), (F.col("user_id") % 5).cast("int").alias("r_regionkey"), (F.col("event_id") % 3 + 1).alias("d")).agg(F.count("*").alias("n"))
    return plan.join(seen, ["event_type", "r_regionkey", "d"], "left").select("r_name", "event_type", "d", F.coalesce("n", F.lit(0)).alias("n"))


_PAIRED = "l as (select o_custkey, min(o_orderkey) as v from orders where o_orderstatus = 'O' group by 1 having count(*) = 1), r as (select o_custkey, min(o_orderkey) as v from orders where o_orderstatus = 'F' group by 1 having count(*) = 1)"


@query(f"with {_PAIRED} select c_mktsegment, round(avg(d), 4) as change, count(*) as n_clusters from (select c_mktsegment, c_nationkey, avg(r.v - l.v) as d from l join r using (o_custkey) join customer on c_custkey = o_custkey group by 1, 2) group by 1")
def paired_change(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("value"))
    pairs = scoring.unambiguous_pairs(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), ["o_custkey"])
    joined = pairs.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
    return scoring.paired_change(joined, ["c_mktsegment"], ["c_nationkey"]).withColumn("change", F.round("change", 4))


@query("with o as (select l_orderkey as k, l_linenumber as option, unnest([l_suppkey % 10, l_partkey % 10]) as id from lineitem), f as (select distinct o_orderkey as k, unnest([o_custkey % 10, o_orderkey % 10]) as id from orders), x as (select o.k, option, count(*) as n, count(f.id) as h from o left join f on f.k = o.k and f.id = o.id group by 1, 2) select k, case when bool_or(n = h) then 'complete' when max(h) > 0 then 'partial' else 'none' end as state from x group by 1")
def evidence_sets(spark: SparkSession, sf: str) -> DataFrame:
    options = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("option"), F.explode(F.array(F.col("l_suppkey") % 10, F.col("l_partkey") % 10)).alias("identity"))
    found = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10)).alias("identity"))
    return scoring.evidence_sets(options, found, ["k"])


@query("with n as (select trial_id, upper(regexp_extract(citation || ' ' || coalesce(registry_id, ''), 'NCT[0-9]{8}')) as nct, count(*) as n from companion_reference where regexp_matches(citation || ' ' || coalesce(registry_id, ''), 'NCT[0-9]{8}') group by 1, 2), t as (select *, rank() over (partition by trial_id order by n desc) as r from n) select trial_id, case when count(*) = 1 then min(nct) end as registry_id from t where r = 1 group by 1")
def registry_identity(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", "citation", F.coalesce("registry_id", F.lit("")))
    named = load(spark, sf, "companion_reference").select("trial_id", F.regexp_extract(text, "(NCT[0-9]{8})", 1).alias("nct")).where("nct <> ''")
    counts = named.groupBy("trial_id", "nct").agg(F.count("*").alias("n"))
    first = counts.withColumn("r", F.rank().over(Window.partitionBy("trial_id").orderBy(F.desc("n")))).where("r = 1")
    return first.groupBy("trial_id").agg(F.when(F.count("*") == 1, F.min("nct")).alias("registry_id"))


@query("with h as (select distinct source_id, 'sh_' || substring(source_id, 8, 16) as handle, trial_id from source_index) select trial_id, handle, case when count(*) = 1 then min(source_id) end as source_id, count(*) as n from h group by 1, 2")
def handles(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_index").select("trial_id", F.concat(F.lit("sh_"), F.substring("source_id", 8, 16)).alias("handle"), "source_id").distinct()
    return rows.groupBy("trial_id", "handle").agg(F.when(F.count("*") == 1, F.min("source_id")).alias("source_id"), F.count("*").alias("n"))


@query("select s.l_orderkey, s.started, c.completed from (select l_orderkey, count(*) as started from lineitem where l_linestatus = 'O' group by 1) s left join (select l_orderkey, count(*) as completed from lineitem where l_linestatus = 'F' group by 1) c using (l_orderkey) where c.completed is null")
def started_not_completed(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    started = rows.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("started"))
    return started.join(rows.where("l_linestatus = 'F'").select("l_orderkey"), "l_orderkey", "left_anti").withColumn("completed", F.lit(None).cast("bigint"))


@query("with q as (select user_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as request from (select user_id, list(event_type order by event_id) as a from events where event_type in ('view', 'click', 'signup') group by 1)), r as (select user_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as result from (select user_id, list(value order by event_id) as a from events where event_type not in ('view', 'click', 'signup') group by 1)) select user_id, pos, request, result from q left join r using (user_id, pos)")
def batch_zip(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events")
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    asked = rows.where("event_type in ('view', 'click', 'signup')").select("user_id", n.alias("pos"), F.col("event_type").alias("request"))
    got = rows.where("event_type not in ('view', 'click', 'signup')").select("user_id", n.alias("pos"), F.col("value").alias("result"))
    return asked.join(got, ["user_id", "pos"], "left")


# --- windows and chains


@query("with s as (select user_id, event_id, event_type as h, list_distinct([cast(json_extract_string(props, '$.k') as bigint), event_id % 10]) as ids from events), e as (select user_id, event_id, unnest(ids) as id from s), f as (select user_id, id, min(event_id) as first from e group by 1, 2), n as (select e.user_id, e.event_id, count(*) as n_results, count(*) filter (where e.event_id = first) as n_novel from e join f using (user_id, id) group by 1, 2) select s.user_id, s.event_id, row_number() over (partition by s.user_id, h order by s.event_id) > 1 as repeats, n_results, n_novel, n_results - n_novel as n_overlap from s join n using (user_id, event_id)")
def query_novelty(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("query_hash"), F.array(F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id") % 10).alias("result_ids"))
    return scoring.novelty(rows, ["user_id"], "event_id")


_CHAIN = "c as (select o_orderkey as k, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent, o_custkey from orders)"


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lag("o_orderkey").over(w).alias("parent"))


@query(f"with {_CHAIN} select k from c where k not in (select parent from c where parent is not null)")
def chain_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.leaves(_chain(spark, sf), "k", "parent").select("k")


@query("select o_orderkey as k, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as root, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as depth from orders")
def chain_depths(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.depths(_chain(spark, sf), "k", "parent")


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def chain_branches(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.branches(load(spark, sf, "orders"), "o_orderkey", "o_custkey")


@query("with s as (select o_custkey, o_orderkey, o_orderstatus as s, o_orderpriority as p, o_totalprice > 150000 as big, lag(o_orderstatus) over w as s0, lag(o_orderpriority) over w as p0, lag(o_totalprice > 150000) over w as big0 from orders window w as (partition by o_custkey order by o_orderkey)) select o_custkey, o_orderkey, case when big and not big0 then ['large'] else [] end as added, case when big0 and not big then ['large'] else [] end as removed, list_filter([case when p <> p0 then 'priority' end, case when s <> s0 then 'status' end], lambda x: x is not null) as changed from s where s0 is not null")
def changed_paths(spark: SparkSession, sf: str) -> DataFrame:
    base = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    values = F.when(F.col("o_totalprice") > 150000, F.map_concat(base, F.create_map(F.lit("large"), F.lit("yes")))).otherwise(base)
    return lineage.changed_paths(load(spark, sf, "orders").select("o_custkey", "o_orderkey", values.alias("v")), ["o_custkey"], "o_orderkey", "v")


@query("with c as (select *, case when o_orderstatus is distinct from lag(o_orderstatus) over w or row_number() over w = 1 then o_orderkey end as m from orders window w as (partition by o_custkey order by o_orderkey)) select o_custkey, o_orderkey, last_value(m ignore nulls) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as since from c")
def last_change(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.last_change(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus").select("o_custkey", "o_orderkey", "since")


def transcript(events: DataFrame) -> DataFrame:
    """The events table read as tool-call transcripts."""
    kind = F.when(F.col("event_type") == "signup", "thread.started").when(F.col("event_type") == "click", "item.started").when(F.col("event_type") == "purchase", "item.completed").otherwise("turn.completed")
    return events.select((F.col("user_id") % 50).alias("transcript"), F.col("event_id").alias("ordinal"), kind.alias("type"), (F.col("user_id") % 5).alias("call_id"))


@query("with e as (select user_id % 50 as transcript, event_id as ordinal, event_type as t, user_id % 5 as call_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id % 50 order by event_id rows unbounded preceding) as thread from events), c as (select *, row_number() over (partition by transcript, thread, call_id, t order by ordinal) as n from e where t in ('click', 'purchase')) select transcript, cast(thread as bigint) as thread, call_id, max(ordinal) filter (where t = 'click') as started, max(ordinal) filter (where t = 'purchase') as completed from c group by transcript, thread, call_id, n")
def call_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.call_pairs(transcript(load(spark, sf, "events")))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderpriority, o_orderstatus, o_totalprice desc, o_orderkey) = 1")
def priority_choice(spark: SparkSession, sf: str) -> DataFrame:
    return sets.closest(load(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus", F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select identity, max(recorded_at) as recorded_at from canonical_records group by 1 order by 2 desc, 1 limit 20")
def newest_records(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "canonical_records").groupBy("identity").agg(F.max("recorded_at").alias("recorded_at")).orderBy(F.desc("recorded_at"), "identity").limit(20)


@query("select user_id, list_slice(list(event_type order by event_id), 1, 3) as actions from events group by 1")
def bounded_recovery(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    kept = load(spark, sf, "events").withColumn("n", n).where("n <= 3")
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda s: s["event_type"]).alias("actions"))


# --- intervals


_WIN = "win as (select source_identity as source_id, page, cast(start_line as bigint) as f, cast(end_line as bigint) as l from (select distinct window_id, source_identity, page, start_line, end_line from source_window) where start_line <= end_line)"
_ISL = f"with {_WIN}, m as (select *, max(l) over (partition by source_id, page order by f, l rows between unbounded preceding and 1 preceding) as reach from win), i as (select *, sum(case when reach is null or f > reach + 1 then 1 else 0 end) over (partition by source_id, page order by f, l rows unbounded preceding) as island from m), mg as (select source_id, page, min(f) as first, max(l) as last, count(*) as n from i group by source_id, page, island)"


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_window").select("window_id", "source_identity", "page", "start_line", "end_line").distinct()
    return rows.select(F.col("source_identity").alias("source_id"), "page", F.col("start_line").cast("bigint").alias("first"), F.col("end_line").cast("bigint").alias("last"))


def _required(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each page, as one range."""
    pages = load(spark, sf, "pages").where("text is not null and source_id is not null").groupBy("source_id", "page").agg(F.max(F.size(F.split("text", "\n", -1))).cast("bigint").alias("last"))
    return pages.select("source_id", "page", F.lit(1).cast("bigint").alias("first"), "last")


@query(_ISL + " select source_id, page, first, last, n from mg")
def merged_windows(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(_windows(spark, sf), ["source_id", "page"])


_COVER = _ISL + """, rq as (select source_id, page, max(len(string_split(text, chr(10)))) as n from pages where text is not null and source_id is not null group by 1, 2),
cv as (select source_id, page, rq.n, coalesce(sum(case when first is not null then greatest(0, least(last, rq.n) - greatest(first, 1) + 1) end), 0) as c from rq left join mg using (source_id, page) group by 1, 2, 3),
st as (select source_id, page, case when c >= n then 'delivered' when c > 0 then 'partial' else 'unobserved' end as state, cast(c as bigint) as n_covered from cv)"""


@query(_COVER + " select source_id, page, state, n_covered from st")
def line_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.coverage(_required(spark, sf), _windows(spark, sf), ["source_id", "page"])


@query(_COVER + " select source_id, case when bool_and(state = 'delivered') then 'read_complete' else 'partially_read' end as reading from st group by 1")
def reading_status(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.all_covered(intervals.coverage(_required(spark, sf), _windows(spark, sf), ["source_id", "page"]), ["source_id"])


@query(_ISL + """, rq as (select source_id, page, max(len(string_split(text, chr(10)))) as n from pages where text is not null and source_id is not null group by 1, 2),
ln as (select source_id, page, unnest(range(1, n + 1)) as line from rq),
op as (select ln.source_id, ln.page, line from ln where not exists (select 1 from mg where mg.source_id = ln.source_id and mg.page = ln.page and line between first and last)),
g as (select *, line - row_number() over (partition by source_id, page order by line) as k from op)
select source_id, page, min(line) as first, max(line) as last from g group by source_id, page, k""")
def read_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gaps(_required(spark, sf), _windows(spark, sf), ["source_id", "page"])


# --- sets


@query("select trial_id from companion_reference union select trial_id from source_index")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return sets.union_distinct(load(spark, sf, "companion_reference").select("trial_id"), load(spark, sf, "source_index").select("trial_id"))


@query("select user_id, event_type, min(event_id) as first from events group by 1, 2")
def ordered_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return sets.first_occurrences(load(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("select source_id, 'missing' as side from (select source_id from source_index except select source_id from pages) union all select source_id, 'extra' from (select source_id from pages except select source_id from source_index)")
def source_sets(spark: SparkSession, sf: str) -> DataFrame:
    return sets.set_difference(load(spark, sf, "source_index").select("source_id"), load(spark, sf, "pages").select("source_id"))


@query("with a as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1) select coalesce(a.k, b.k) as k, coalesce(a.n, 0) - coalesce(b.n, 0) as excess from a full join b on a.k = b.k where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def row_set_check(spark: SparkSession, sf: str) -> DataFrame:
    return sets.multiset_difference(load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("select md5(text) as fingerprint, count(distinct source) as n_splits from documents where text is not null group by 1 having count(distinct source) > 1")
def split_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return sets.split_leaks(load(spark, sf, "documents").where("text is not null").select(F.md5("text").alias("fingerprint"), "source"), "fingerprint", "source")


@query("select evidence_identity, trial_id, count(*) as n from search_evidence_provenance where evidence_identity is not null group by 1, 2 having count(*) > 1")
def duplicate_values(spark: SparkSession, sf: str) -> DataFrame:
    return sets.duplicates(load(spark, sf, "search_evidence_provenance").where("evidence_identity is not null"), ["evidence_identity", "trial_id"])


@query("with a as (select c_nationkey as k, count(*) % 3 as v from customer group by 1), b as (select s_nationkey as k, count(*) % 3 as v from supplier group by 1) select coalesce(a.k, b.k) as k, a.v as value_a, b.v as value_b from a full join b on a.k = b.k where a.v is distinct from b.v")
def key_differences(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t, c: load(spark, sf, t).groupBy(F.col(c).alias("k")).agg((F.count("*") % 3).alias("v"))
    return sets.key_differences(side("customer", "c_nationkey"), side("supplier", "s_nationkey"), ["k"], "v")


# --- participant flow and decisions

_FLOW = "fl as (select l_orderkey, l_linenumber, l_suppkey % 50 as arm, l_returnflag as unit, cast(l_quantity as bigint) * 10 as randomized, case when l_linenumber % 4 <> 0 then cast(l_quantity as bigint) * 10 - l_partkey % 7 end as observed, case when l_linenumber % 3 = 0 then l_partkey % 7 end as unavailable, case when l_linenumber % 2 = 0 then l_partkey % 9 end as imputed from lineitem)"


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = load(spark, sf, "lineitem"), F.col("l_quantity").cast("bigint") * 10
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("arm"), F.col("l_returnflag").alias("unit"), n.alias("randomized"),
        F.when(F.col("l_linenumber") % 4 != 0, n - F.col("l_partkey") % 7).alias("observed"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 7).alias("unavailable"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 9).alias("imputed"), F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )


@query(f"with {_FLOW}, f0 as (select *, first_value(randomized) over w as r0, first_value(observed) over w as o0, first_value(unavailable) over w as u0, coalesce(randomized - observed, unavailable) as missing from fl window w as (partition by arm, unit order by l_orderkey, l_linenumber)) select l_orderkey, l_linenumber, missing, case when randomized = 0 then 0.0 else round(missing / randomized, 6) end as missing_fraction, (randomized is distinct from r0 or observed is distinct from o0 or unavailable is distinct from u0) as conflict from f0")
def flow_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return flow.reconciled(_flow(spark, sf), ["arm", "unit"], "seq").select("l_orderkey", "l_linenumber", "missing", F.round("missing_fraction", 6).alias("missing_fraction"), "conflict")


@query(f"with {_FLOW}, f0 as (select *, coalesce(randomized - observed, unavailable) as missing, coalesce(imputed > unavailable or imputed > randomized or imputed > randomized - observed, false) as qc from fl) select l_orderkey, l_linenumber, qc as quantity_conflict, case when not qc then missing end as missing from f0")
def flow_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return flow.quantity_conflicts(flow.reconciled(_flow(spark, sf), ["arm", "unit"], "seq")).select("l_orderkey", "l_linenumber", "quantity_conflict", "missing")


def _answer(column):
    return F.element_at(F.array(*map(F.lit, D.ANSWERS)), (column % 5 + 1).cast("int"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shares = {"sequence": k, "concealment": c, "baseline-imbalance": k + c, "method-inappropriate": k, "differential": c, "assessor-aware": k + c, "influence-possible": k + 2 * c, "influence-likely": k + 3 * c, "prespecified": k, "measurements": c, "analyses": k + c}
    return load(spark, sf, "orders").select(k.alias("row_id"), *[_answer(v).alias(q) for q, v in shares.items()])


_ANS = "a as (select o_orderkey as row_id, o_orderkey % 5 as s, o_custkey % 5 as c, (o_orderkey + o_custkey) % 5 as b from orders)"
_RND = "case when c in (2, 3) then 'high' when c = 4 and b in (0, 1) then 'high' when s in (2, 3) or c = 4 or b in (0, 1) then 'some_concerns' else 'low' end"
_SEL = "case when c in (0, 1) or b in (0, 1) then 'high' when s in (2, 3, 4) or c = 4 or b = 4 then 'some_concerns' else 'low' end"


@query(f"with {_ANS} select row_id, {_RND} as judgement, case when c in (2, 3) then 'concealment_failed' when c = 4 and b in (0, 1) then 'unknown_concealment_and_imbalance' when s in (2, 3) or c = 4 or b in (0, 1) then 'some_concerns' else 'low' end as rule from a")
def decision_randomization(spark: SparkSession, sf: str) -> DataFrame:
    return D.judged(_answers(spark, sf), D.TABLES["randomization"]).select("row_id", "judgement", "rule")


@query(f"with {_ANS}, j as (select row_id, {_RND} as r, {_SEL} as l from a) select row_id, case when r = 'high' or l = 'high' then 'high' when r = 'some_concerns' or l = 'some_concerns' then 'some_concerns' else 'low' end as overall, (r = 'some_concerns')::int + (l = 'some_concerns')::int as n_some from j")
def decision_overall(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf)
    both = [D.judged(rows, D.TABLES[d]).select("row_id", "judgement") for d in ("randomization", "selection")]
    return D.overall(both[0].unionByName(both[1]), ["row_id"], 2)


@query(f"with {_ANS}, m as (select row_id, s in (2, 3, 4) and c in (2, 3, 4) as x, b in (0, 1, 4) as y, (o_orderkey + 2 * o_custkey) % 5 in (0, 1, 4) as z from a join orders on o_orderkey = row_id) select row_id, ['method-inappropriate', 'differential'] || case when x then ['assessor-aware'] else [] end || case when x and y then ['influence-possible'] else [] end || case when x and y and z then ['influence-likely'] else [] end as active from m")
def active_questions(spark: SparkSession, sf: str) -> DataFrame:
    return D.active(_answers(spark, sf), ["method-inappropriate", "differential", "assessor-aware", "influence-possible", "influence-likely"]).select("row_id", "active")


@query(f"with {_ANS}, t as (select row_id, s, b, {_RND} as now from a where c = 4), u as (select row_id, now, {_RND} as j from (select row_id, now, s, b, unnest([1, 2]) as c from t)) select row_id, now, case when bool_or(j <> now) then 'sensitive' else 'stable' end as stability from u group by 1, 2")
def counterfactual_receipt(spark: SparkSession, sf: str) -> DataFrame:
    return D.counterfactuals(_answers(spark, sf).withColumn("row_id", F.col("row_id")), "concealment", D.TABLES["randomization"])


# --- projections, predicates and scalar functions


@query("with s as (select distinct trial_id, source_id, json_extract_string(payload, '$.role') as role, json_extract_string(payload, '$.logical_path') as path from source_index), r as (select *, coalesce(list_position(['main_article', 'registry', 'supplement', 'sap', 'protocol', 'other'], role) - 1, 5) as k from s) select trial_id, source_id, row_number() over (partition by trial_id order by k, lower(path), source_id) as place from r")
def listed_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_index").select("trial_id", "source_id", F.get_json_object("payload", "$.role").alias("role"), F.get_json_object("payload", "$.logical_path").alias("path")).distinct()
    return P.listed_sources(rows, ["trial_id"]).select("trial_id", "source_id", "place")


_STEM = "regexp_replace(f, '(.)[.][^.]*$', '\\1')"
_ROLE = "case when contains(st, 'disclosure') then 'other' when contains(st, 'protocol') then 'protocol' when contains(st, 'sap') or contains(st, 'analysis') then 'sap' when contains(st, 'supp') or contains(st, 'appendix') then 'supplement' when contains(st, 'registry') or contains(st, 'nct') then 'registry' when regexp_matches(f, '.[.]pdf$') then 'main_article' else 'other' end"


@query(f"with s as (select distinct source_id, json_extract_string(payload, '$.logical_path') as path from source_index), n as (select source_id, path, lower(list_last(string_split(path, '/'))) as f from s), m as (select *, {_STEM} as st from n) select source_id, path, {_ROLE} as role from m")
def inferred_roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_index").select("source_id", F.get_json_object("payload", "$.logical_path").alias("path")).distinct()
    return rows.select("source_id", "path", P.role_of_path(F.col("path")).alias("role"))


_LEAF = "lv as (select distinct source_id, '/' || replace(replace(k, '~', '~0'), '/', '~1') as path, json_extract_string(payload, '$.' || k) as value from (select source_id, payload, unnest(json_keys(payload)) as k from source_index))"


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "source_index").select(F.concat_ws("|", "source_id", "payload").alias("row"), "payload").distinct()
    return P.leaf_table(rows, "row", "payload").select(F.split("row", r"\|")[0].alias("source_id"), "path", "value").distinct()


@query(f"with {_LEAF} select source_id, path, value from lv")
def leaf_table(spark: SparkSession, sf: str) -> DataFrame:
    return _leaves(spark, sf)


@query(f"with {_LEAF} select distinct source_id, path from lv where contains(value, '/') or contains(value, chr(92))")
def private_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return P.private_leaves(_leaves(spark, sf), "source_id").distinct()


@query("select reference_id, list_filter([case when registry_id is null then 'registry_id' end, case when locator is null then 'locator' end, case when locator_kind is null then 'locator_kind' end], lambda x: x is not null) as missing from (select distinct reference_id, registry_id, locator, locator_kind from companion_reference)")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "companion_reference").select("reference_id", "registry_id", "locator", "locator_kind").distinct()
    return rows.select("reference_id", P.missing_fields(["registry_id", "locator", "locator_kind"]).alias("missing"))


@query("select event_id, case when value > 60 then 'value' when cast(json_extract_string(props, '$.k') as int) > 90 then 'tokens' when event_type = 'error' then 'error' end as stop from events")
def stop_guard(spark: SparkSession, sf: str) -> DataFrame:
    limits = [(F.col("value") > 60, "value"), (F.get_json_object("props", "$.k").cast("int") > 90, "tokens"), (F.col("event_type") == "error", "error")]
    return load(spark, sf, "events").select("event_id", P.first_true(limits).alias("stop"))


@query("select identity, lower(trim(regexp_replace(kind, '\\s+', ' ', 'g'))) is not distinct from 'evidence' as same from (select distinct identity, kind from canonical_records)")
def same_wording(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "canonical_records").select("identity", "kind").distinct().select("identity", P.same_wording(F.col("kind"), F.lit("evidence")).alias("same"))


@query("select distinct source_id, 'source_' || sha256(trial_id || chr(0) || json_extract_string(payload, '$.logical_path') || chr(0) || json_extract_string(payload, '$.projection_hash')) as new_id, 'sh_' || regexp_extract(source_id, '([0-9a-f]{16})[0-9a-f]*$', 1) as handle, 'sha256:' || sha256(payload) as payload_identity from source_index where trial_id is not null")
def identities(spark: SparkSession, sf: str) -> DataFrame:
    path, digest = F.get_json_object("payload", "$.logical_path"), F.get_json_object("payload", "$.projection_hash")
    rows = load(spark, sf, "source_index").where("trial_id is not null")
    return rows.select("source_id", P.source_identity(F.col("trial_id"), path, digest).alias("new_id"), P.handle(F.col("source_id")).alias("handle"), P.identity(F.col("payload")).alias("payload_identity")).distinct()


@query("select submission_id, list_sort(list_distinct(regexp_extract_all(body, '\\b[a-z]{2}_[0-9a-f]{16}\\b'))) as ids from (select distinct submission_id, body from monarch_plus_rejected_submissions)")
def harvested_identities(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "monarch_plus_rejected_submissions").select("submission_id", "body").distinct().select("submission_id", P.harvested(F.col("body")).alias("ids"))


_DATE = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"


@query(f"with d as (select distinct source_id, page, line from (select source_id, page, unnest(string_split(text, chr(10))) as line from pages where text is not null)), x as (select *, regexp_extract(line, '(\\d{{1,2}} {_DATE} \\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}\\.\\d{{2}}\\.\\d{{4}})', 1) as date from d) select source_id, page, line, date, case when contains(lower(line), 'amend') then 'amendment' when contains(lower(line), 'version') then 'version' when contains(lower(line), 'regist') then 'registration' when contains(lower(line), 'enrol') then 'enrolment' else 'date' end as kind from x where date <> ''")
def dated_lines(spark: SparkSession, sf: str) -> DataFrame:
    cut = load(spark, sf, "pages").select("source_id", "page", F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    date, kind = P.date_lead(F.col("line"))
    return cut.select("source_id", "page", "line", date.alias("date"), kind.alias("kind")).where("date <> ''")


_BOUNDS = "case when l_linenumber % 5 = 0 then '' else ' (' || case when l_linenumber % 3 = 0 then '' else cast(l_partkey as varchar) end || ' to ' || l_orderkey || ')' end"


@query(f"select l_orderkey, l_linenumber, cast(l_linenumber as varchar) || case when l_linenumber % 2 = 0 then ' (' || l_suppkey || ')' else '' end || {_BOUNDS} || ' [' || l_returnflag || ']' as cell, '| ' || l_returnflag || chr(92) || '|x | ' || l_linestatus || ' |  |' as row from lineitem")
def rendered_cells(spark: SparkSession, sf: str) -> DataFrame:
    spread = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))
    known = F.col("l_linenumber") % 5 != 0
    low, high = F.when(known & (F.col("l_linenumber") % 3 != 0), F.col("l_partkey")), F.when(known, F.col("l_orderkey"))
    cell = P.measurement(F.col("l_linenumber"), spread, low, high, F.col("l_returnflag"))
    row = P.table_rows(F.array(F.concat("l_returnflag", F.lit("|x")), F.col("l_linestatus")), F.lit(3))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"), row.alias("row"))
