"""Queries of schedules, costs, logs and maintenance, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.operators import logs as L
from sitequarry.operators import schedule as S
from sitequarry.sources.tables import table

STATUSES = ("not_started", "in_progress", "completed", "delayed")
#: What each role may read.
GRANTS = {"admin": ("public", "internal", "confidential", "restricted"), "manager": ("public", "internal", "confidential"), "engineer": ("public", "internal"), "viewer": ("public",)}


def tasks(s, d):
    return table(s, d, "task_schedule")


def cost_lines(s, d):
    """Order lines as cost lines of a customer's project."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"))
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    li = table(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("category"), price.alias("planned"), (price * (1 - F.col("l_discount") + 2 * F.col("l_tax")).cast("decimal(5,2)")).alias("actual"), F.col("l_shipdate").cast("date").alias("day"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def cost_months(s, d):
    return S.monthly(cost_lines(s, d), "day", "actual", ["project_id"])


def documents(s, d):
    return table(s, d, "documents").select("doc_id", "doc_type", "name", "project_id", "source", "status", "permission_level", "created_at", "updated_at")


def events(s, d):
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def rates(s, d):
    p = table(s, d, "project_basic").select("project_id", "project_type")
    return p.join(S.progress(tasks(s, d)).select("project_id", "sum_actual"), "project_id", "left")


def kv(s, d):
    return events(s, d).select(F.concat_ws("-", "event_type", "k").alias("key"), "ts", "event_id")


def patched(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1000).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("-new"))).alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return L.upsert(c, new, "c_custkey")


QUERIES = {
    "op_prj_task_metrics": lambda s, d: S.with_task_metrics(tasks(s, d).distinct()).select("task_id", "variance", "spi"),
    "op_an_progress_status": lambda s, d: S.progress(tasks(s, d)),
    "op_an_status_pivot": lambda s, d: S.status_pivot(tasks(s, d), STATUSES),
    "op_an_delayed_tasks": lambda s, d: S.slipped(tasks(s, d), 5),
    "op_ag_cost_by_cat": lambda s, d: S.costs(cost_lines(s, d)),
    "op_ag_monthly_cost": cost_months,
    "op_wn_first_last": lambda s, d: S.first_last(cost_months(s, d), ["project_id"]),
    "op_jn_peer": lambda s, d: S.peers(rates(s, d), "project_type", "sum_actual"),
    "op_db_dashboard": lambda s, d: S.dashboard(table(s, d, "project_basic"), tasks(s, d), table(s, d, "construction_drawings")),
    "op_flt_docs": lambda s, d: L.filtered(documents(s, d), equal={"status": "completed", "doc_type": None}, between={"created_at": ("2021-06-01", "2024-06-01")}, within={"source": ["site_diary", "erp_export"]}).select("doc_id", "name", "source"),
    "op_flt_doc_search": lambda s, d: L.filtered(documents(s, d), contains={"name": "mar", "project_id": "0017"}).select("doc_id", "name", "project_id"),
    "op_lm_page": lambda s, d: L.page(documents(s, d).select("doc_id", "created_at"), [F.desc("created_at"), "doc_id"], 20, 15),
    "op_ag_doc_stats": lambda s, d: L.zero_filled(documents(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", documents(s, d).select("status").where("status is not null").distinct().unionByName(s.range(1).select(F.lit("archived").alias("status"))).distinct()),
    "op_flt_doc_fetch": lambda s, d: table(s, d, "construction_drawings").select("id", "document_id").join(table(s, d, "document_chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("page_num")).alias("pages")), "document_id", "left").select("id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.array_join(F.coalesce("pages", F.array().cast("array<int>")), ",").alias("pages")),
    "op_ag_query_stats": lambda s, d: L.query_stats(events(s, d), "event_type"),
    "op_ag_daily_trend": lambda s, d: L.daily(events(s, d)),
    "op_ag_hot_queries": lambda s, d: L.hot(events(s, d), F.concat_ws("-", "event_type", F.col("k") % 10), 10),
    "op_wn_history": lambda s, d: L.recent(events(s, d), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "rank"),
    "op_st_kv_ttl": lambda s, d: L.alive(kv(s, d), "key", "ts", F.expr("interval 6 hours"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")),
    "op_ext_sessions": lambda s, d: L.sessions(events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}),
    "op_ag_user_count": lambda s, d: events(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_types"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")),
    "op_ag_defect_matrix": lambda s, d: events(s, d).withColumn("level", F.when(F.col("value") >= 100, "high").when(F.col("value") >= 30, "medium").otherwise("low")).groupBy("event_type").pivot("level", ["high", "medium", "low"]).agg(F.count(F.lit(1))).fillna(0),
    "op_snk_upsert": patched,
    "op_snk_delete": lambda s, d: L.deleted(table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "orders").where("o_orderkey % 8 = 1").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
    "op_prd_perm": lambda s, d: L.row_security(documents(s, d), events(s, d).select("user_id").distinct().select("user_id", F.element_at(F.array(*map(F.lit, GRANTS)), (F.col("user_id") % 4 + 1).cast("int")).alias("role")), GRANTS),
    "op_so_union_labels": lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("n")).union(table(s, d, "customer").select("c_nationkey")).distinct(),
    "op_pipe_route": lambda s, d: documents(s, d).select("doc_id", F.when(F.col("doc_type") == "standard", "standards").when(F.col("name").rlike("^(GB|JGJ|CJJ)"), "standards").when(F.col("doc_type") == "contract", "contracts").otherwise("projects").alias("collection")),
}

_T = "t as (select *, cast(actual_progress - planned_progress as double) as variance, case when planned_progress <> 0 then round(cast(actual_progress as double) / cast(planned_progress as double), 3) end as spi from (select distinct * from task_schedule))"
_P = f"""{_T}, p0 as (select project_id, count(*) as n_tasks, count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'delayed') as n_delayed, count(*) filter (status is null) as n_unknown, count(*) filter (is_critical_path) as n_critical,
  cast(coalesce(sum(planned_progress), 0) as double) as sum_planned, cast(coalesce(sum(actual_progress), 0) as double) as sum_actual, round(avg(spi), 9) as mean_spi from t group by 1),
p as (select *, case when sum_planned <> 0 then round(sum_actual / sum_planned, 3) end as overall_spi from p0)"""
_C = """c as (select o_custkey as project_id, l_linenumber % 4 as category, cast(l_extendedprice as decimal(15,2)) as planned, cast(l_extendedprice as decimal(15,2)) * cast(1 - l_discount + 2 * l_tax as decimal(5,2)) as actual, cast(l_shipdate as date) as day from lineitem join orders on l_orderkey = o_orderkey)"""
_M = f"""{_C}, m0 as (select project_id, strftime(day, '%Y-%m') as month, sum(actual) as s, count(*) as n from c group by all),
m as (select project_id, month, cast(s as double) as total, n, s, cast(sum(s) over (partition by project_id order by month rows unbounded preceding) as double) as running, lag(s) over (partition by project_id order by month) as before from m0)"""
_EV = "e as (select *, cast(json_extract_string(props, '$.k') as int) as k from events)"
_DOCS = "select doc_id, {cols} from documents"

SQL = {
    "op_prj_task_metrics": f"with {_T} select task_id, variance, spi from t",
    "op_an_progress_status": f"with {_P} select * from p",
    "op_an_status_pivot": f"with {_T} select project_id, {', '.join(f'''count(*) filter (status = '{x}') as {x}''' for x in STATUSES)} from t group by 1",
    "op_an_delayed_tasks": f"with {_T} select project_id, task_id, variance, spi, cast(rank as int) as rank from (select *, row_number() over (partition by project_id order by variance, task_id) as rank from t where variance < 0) where rank <= 5",
    "op_ag_cost_by_cat": f"""with {_C}, s as (select project_id, category, sum(planned) as a, sum(actual) as b, count(*) as n_lines from c group by all)
select project_id, category, cast(a as double) as planned_sum, cast(b as double) as actual_sum, cast(b - a as double) as variance, case when a <> 0 then round(cast(b - a as double) / cast(a as double), 6) end as variance_rate, n_lines from s""",
    "op_ag_monthly_cost": f"with {_M} select project_id, month, total, n, running, case when before <> 0 then round(cast(s - before as double) / cast(before as double), 6) end as growth from m",
    "op_wn_first_last": f"with {_M} select project_id, arg_min(total, month) as first_total, arg_max(total, month) as last_total, count(*) as n_months from m group by 1",
    "op_jn_peer": f"""with {_P}, r as (select b.project_id, project_type, sum_actual from project_basic b left join p using (project_id))
select project_id, project_type, sum_actual, case when sum_actual is not null and count(sum_actual) over w > 1 then round((sum(sum_actual) over w - sum_actual) / (count(sum_actual) over w - 1), 4) end as peer_mean from r window w as (partition by project_type)""",
    "op_db_dashboard": f"""with {_P} select b.project_id, project_name, project_type, coalesce(n_tasks, 0) as n_tasks, coalesce(n_completed, 0) as n_completed, coalesce(n_delayed, 0) as n_delayed, overall_spi, coalesce(n_drawings, 0) as n_drawings, cast(coalesce(n_pages, 0) as bigint) as n_pages
from project_basic b left join p using (project_id) left join (select project_id, count(*) as n_drawings, sum(total_pages) as n_pages from construction_drawings where deleted_at is null and project_id is not null group by 1) d using (project_id)""",
    "op_flt_docs": "select doc_id, name, source from documents where status = 'completed' and created_at between timestamp '2021-06-01' and timestamp '2024-06-01' and source in ('site_diary', 'erp_export')",
    "op_flt_doc_search": "select doc_id, name, project_id from documents where contains(name, 'mar') or contains(project_id, '0017')",
    "op_lm_page": "select doc_id, created_at from documents order by created_at desc nulls last, doc_id limit 15 offset 20",
    "op_ag_doc_stats": "select status, coalesce(n, 0) as n from (select distinct status from documents where status is not null union select 'archived') left join (select status, count(*) as n from documents group by 1) using (status)",
    "op_flt_doc_fetch": "select id, coalesce(n_chunks, 0) as n_chunks, coalesce(pages, '') as pages from construction_drawings left join (select document_id, count(*) as n_chunks, array_to_string(list_sort(list(distinct page_num) filter (page_num is not null)), ',') as pages from document_chunks group by 1) using (document_id)",
    "op_ag_query_stats": "select event_type, count(*) as n, count(*) filter (event_type = 'error') as n_errors, round(avg(value), 4) as avg_value, round(quantile_cont(value, 0.95), 4) as p95_value, count(distinct user_id) as n_users, cast(grouping(event_type) as int) as grouped from events group by rollup (event_type)",
    "op_ag_daily_trend": "select *, round(avg(n) over (order by day rows 6 preceding), 4) as n_week_mean from (select cast(ts as date) as day, count(*) as n, round(avg(value), 4) as avg_value from events group by 1)",
    "op_ag_hot_queries": f"with {_EV} select concat_ws('-', event_type, k % 10) as key, count(*) as n from e group by 1 order by 2 desc, 1 limit 10",
    "op_wn_history": "select user_id, event_id, cast(rank as int) as rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 3",
    "op_st_kv_ttl": f"with {_EV} select key, ts, event_id from (select concat_ws('-', event_type, k) as key, ts, event_id, row_number() over (partition by concat_ws('-', event_type, k) order by ts desc, event_id desc) as rn from e where ts <= timestamp '2024-01-20') where rn = 1 and ts + interval 6 hour > timestamp '2024-01-20'",
    "op_ext_sessions": """select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, round(sum(value), 4) as total from (
  select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 0 else 1 end as opens from events)) group by user_id, run""",
    "op_ag_user_count": "select user_id, count(*) as n, count(distinct event_type) as n_types, arg_max(event_type, (ts, event_id)) as last_type from events group by 1",
    "op_ag_defect_matrix": "select event_type, count(*) filter (value >= 100) as high, count(*) filter (value >= 30 and value < 100) as medium, count(*) filter (value < 30 or value is null) as low from events group by 1",
    "op_snk_upsert": """with n as (select c_custkey + 1000 as k, case when c_custkey % 2 = 0 then c_name || '-new' end as name from customer where c_custkey % 3 = 0)
select coalesce(c_custkey, k) as c_custkey, coalesce(name, c_name) as c_name, case when k is not null then 'NEW' else c_mktsegment end as c_mktsegment from customer full join n on c_custkey = k""",
    "op_snk_delete": "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderkey % 8 = 1)",
    "op_prd_perm": "with g(role, permission_level) as (values " + ", ".join(f"('{r}', '{x}')" for r, xs in GRANTS.items() for x in xs) + "), u as (select distinct user_id, case user_id % 4 when 0 then 'admin' when 1 then 'manager' when 2 then 'engineer' else 'viewer' end as role from events), a as (select role, count(*) as n_docs from g join documents using (permission_level) group by 1) select user_id, role, coalesce(n_docs, 0) as n_docs from u left join a using (role)",
    "op_so_union_labels": "select s_nationkey as n from supplier union select c_nationkey from customer",
    "op_pipe_route": "select doc_id, case when doc_type = 'standard' then 'standards' when regexp_matches(name, '^(GB|JGJ|CJJ)') then 'standards' when doc_type = 'contract' then 'contracts' else 'projects' end as collection from documents",
}
