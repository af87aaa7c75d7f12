"""Queries of filters, predicates, serialisation, ingestion and statistics over the records, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators import chunks as C
from sitequarry.operators import logs as L
from sitequarry.operators import retrieval as R
from sitequarry.operators import schedule as S
from sitequarry.plans.project_queries import cost_lines, events, tasks
from sitequarry.plans.session import checkpoint_dir
from sitequarry.sources.tables import table

# Patterns of suspicious input, and which files may be taken in up to which size.
SQL_INJECTION = r"(?i)(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b)|(--|;|/\*|\*/|xp_|sp_)"
XSS = r"(?i)(<script|<iframe|<object|<embed|javascript:|onerror=|onload=)"
ALLOWED = {
    "document": (("pdf", "docx", "doc", "txt", "md"), 50 * 1024 * 1024),
    "image": (("jpg", "jpeg", "png", "gif", "bmp"), 10 * 1024 * 1024),
    "archive": (("zip", "tar", "gz", "rar"), 100 * 1024 * 1024),
}
DANGEROUS = ("exe", "bat", "cmd", "sh", "ps1", "dll", "so", "dylib", "js", "jar", "apk")
#: What each role may do.
ACTIONS = {"admin": ("read", "write", "delete", "share", "admin"), "manager": ("read", "write", "delete", "share"), "engineer": ("read", "write"), "viewer": ("read",)}
HEADING = r"^第[一二三四五六七八九十百千\d]+[章节条]|^\d+(?:\.\d+)*[.\s]|^[一二三四五六七八九十]+[.、]"


def documents(s, d):
    return table(s, d, "documents")


def chunk_table(s, d):
    return table(s, d, "document_chunks")


def drawings(s, d):
    return table(s, d, "construction_drawings")


def project_costs(s, d):
    """Cost lines of the projects: a customer's orders are booked on one project."""
    return cost_lines(s, d).withColumn("project_id", F.format_string("PRJ-%04d", F.pmod(F.col("project_id"), F.lit(80)) + 1))


def project_rates(s, d):
    cost = project_costs(s, d).groupBy("project_id").agg(F.sum("actual").alias("spent"))
    done = tasks(s, d).distinct().groupBy("project_id").agg(F.sum("actual_progress").alias("done"), F.count(F.lit(1)).alias("n"))
    p = table(s, d, "project_basic").select("project_id", "project_type", "status", "total_budget")
    both = p.join(done, "project_id", "left").join(cost, "project_id", "left")
    return both.select(
        "project_id", "project_type", "status",
        F.coalesce(S.ratio(F.coalesce("done", F.lit(0)), F.col("n"), 2), F.lit(0.0)).alias("progress_rate"),
        F.coalesce(S.ratio(F.coalesce("spent", F.lit(0)), F.col("total_budget"), 4), F.lit(0.0)).alias("cost_rate"),
    )


def project_statistics(s, d):
    """One row per project: tasks by status, costs, events as checks, each side aggregated before it is joined."""
    t = S.progress(tasks(s, d)).select("project_id", "n_tasks", "n_completed", "n_delayed", "n_critical")
    c = project_costs(s, d).groupBy("project_id").agg(F.sum("planned").alias("p"), F.sum("actual").alias("a"), F.count(F.lit(1)).alias("n_cost_lines"))
    e = events(s, d).groupBy(F.format_string("PRJ-%04d", F.pmod(F.col("user_id"), F.lit(80)) + 1).alias("project_id")).agg(F.countDistinct(F.to_date("ts")).alias("n_check_days"), F.count_if(F.col("value") >= 100).alias("n_high"))
    p = table(s, d, "project_basic").select("project_id", "total_budget")
    out = p.join(t, "project_id", "left").join(c, "project_id", "left").join(e, "project_id", "left").fillna(0)
    return out.select("project_id", "n_tasks", "n_completed", "n_delayed", "n_critical", F.col("p").cast("double").alias("planned_cost"), F.col("a").cast("double").alias("actual_cost"), (F.col("a") - F.col("total_budget")).cast("double").alias("cost_variance"), "n_cost_lines", "n_check_days", "n_high")


def halves(s, d):
    """Events per type in the first half of the period, open at its end, and in the second."""
    e = events(s, d).select("event_type", F.to_date("ts").alias("day"))
    span = F.broadcast(e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")).alias("middle")))  # one row
    first = F.col("day") < F.col("middle")
    return e.join(span).groupBy("event_type").agg(F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_second"))


def stored_chunks(s, d):
    """Chunks stored in two calls; total_chunks is the number of the last call that brought any of a document."""
    path = f"{checkpoint_dir(s)}/chunks-{uuid.uuid4().hex}"
    rows = chunk_table(s, d).where("document_id is not null").select("document_id", "id", F.when(F.col("chunk_index") < 4, 1).otherwise(2).alias("call"))
    rows.where("call = 1").write.mode("overwrite").parquet(path)
    rows.where("call = 2").write.mode("append").parquet(path)
    per = s.read.parquet(path).groupBy("document_id", "call").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("document_id").agg(F.sum("n").alias("n_chunks"), F.max_by("n", "call").alias("total_chunks"))


def ingested(docs):
    """The ingestion as one plan: clean, class, chunks, target collection. A document without text has failed and brings no chunk."""
    clean = docs.select("doc_id", "doc_type", "name", T.squeeze_blanks(T.drop_controls(T.fix_encoding(F.col("text")))).alias("text"))
    target = F.when((F.col("doc_type") == "standard") | F.col("name").rlike("^(GB|JGJ|CJJ)"), "standards").when(F.col("doc_type") == "contract", "contracts").otherwise("projects")
    per = clean.select("doc_id", "text", target.alias("collection"), T.classify(F.col("text"), T.DOC_TYPES, "other").alias("doc_class"), T.fingerprint(F.col("text")).alias("fp"))
    length = F.coalesce(F.length("text"), F.lit(0))
    return per.select("doc_id", "collection", "doc_class", "fp", F.when(length > 0, F.ceil(length / 450)).otherwise(0).cast("long").alias("n_chunks"), F.when(length > 0, "processed").otherwise("failed").alias("state"))


def sequence_ids(s, d):
    late = S.slipped(tasks(s, d), 20)
    return late.select("project_id", "task_id", F.format_string("RISK-%04d", "rank").alias("risk_id"))


def cached_answers(s, d):
    """Questions asked before are answered from the cache, keyed by the question alone: is_hit and the item that filled it."""
    q = table(s, d, "eval_items").select("item_id", F.md5(T.preprocess(F.col("question"))).alias("key"))
    filled = q.groupBy("key").agg(F.min("item_id").alias("filled_by"))
    return q.join(filled, "key").select("item_id", F.concat(F.lit("query:result:"), "key").alias("cache_key"), (F.col("item_id") != F.col("filled_by")).alias("is_hit"), "filled_by")


def keywords(s, d, k=5):
    """The ``k`` tokens of each document with the largest product of frequency and inverse document frequency over the corpus."""
    idx = R.build_index(documents(s, d))
    n = F.broadcast(idx.corpus.select("n_docs"))
    idf = idx.posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(n).select("token", F.log(F.col("n_docs") / (F.col("df") + 1)).alias("idf"))
    scored = idx.posts.join(idx.lengths, "doc_id").join(idf, "token").select("doc_id", "token", F.round(F.col("tf") / F.col("dl") * F.col("idf"), 6).alias("weight"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grants(s, d):
    """Grants bounded by two dates, either of which may be open, as of a day."""
    as_of = F.lit("2024-06-01").cast("date")
    p = table(s, d, "project_basic").select("project_id", "start_date", "planned_end_date")
    return p.select("project_id", ((F.coalesce("start_date", as_of) <= as_of) & (F.coalesce("planned_end_date", as_of) >= as_of)).alias("is_valid"))


def may(s, d):
    """user_id, role and the actions open to it."""
    roles = s.createDataFrame([(r, a) for r, xs in ACTIONS.items() for a in xs], "role string, action string")
    users = events(s, d).select("user_id").distinct().select("user_id", F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("user_id") % 4 + 1).cast("int")).alias("role"))
    return users.join(F.broadcast(roles), "role").groupBy("user_id", "role").agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def files(s, d):
    """Whether a drawing's file may be taken in, and why not."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    size = F.col("file_size")
    verdict = F.when(F.col("extension").isin(*DANGEROUS), "dangerous")
    for kind, (exts, most) in ALLOWED.items():
        verdict = verdict.when(F.col("extension").isin(*exts), F.when(size > most, "too large").otherwise(kind))
    return drawings(s, d).select("id", "file_size", extension.alias("extension")).select("id", "extension", verdict.otherwise("unknown").alias("verdict"))


def monthly_levels(s, d):
    level = lambda c: F.count_if(c)
    v = F.col("value")
    return events(s, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("total"), level(v >= 100).alias("high"), level((v >= 30) & (v < 100)).alias("medium"), level((v < 30) | v.isNull()).alias("low"), F.countDistinct(F.to_date("ts")).alias("check_days"))


def table_rows(s, d):
    """Rows of tables in the documents: doc_id, row number, cells and the cells joined by a bar between blanks."""
    lines = F.filter(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n"), lambda x: x.contains("|"))
    each = documents(s, d).select("doc_id", F.posexplode(lines).alias("row", "line"))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    return each.select("doc_id", "row", F.size(cells).alias("n_cells"), F.array_join(cells, " | ").alias("row_text"))


def headings(s, d):
    """Heading lines of each document with their depth, written with as many number signs."""
    lines = F.filter(F.transform(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(HEADING) & (F.length(x) < 60))
    each = documents(s, d).select("doc_id", F.posexplode(lines).alias("no", "heading"))
    depth = F.when(F.col("heading").rlike(r"^\d"), F.length(F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)", 1)) - F.length(F.replace(F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)", 1), F.lit("."), F.lit(""))) + 1).otherwise(1)
    return each.withColumn("depth", depth.cast("int")).select("doc_id", "no", "depth", F.concat(F.expr("repeat('#', depth)"), F.lit(" "), "heading").alias("rendered"))


def page_range(s, d, first=2, last=3):
    """The text of the pages from ``first`` to ``last`` of each file, in chunk order, and how many pages it has."""
    c = chunk_table(s, d).where("document_id is not null")
    on = (F.col("page_num") >= first) & (F.col("page_num") <= last)
    part = F.sort_array(F.collect_list(F.when(on, F.struct("chunk_index", "id", F.coalesce("text", F.lit("")).alias("t")))))
    return c.groupBy("document_id").agg(F.countDistinct("page_num").alias("n_pages"), F.md5(F.array_join(F.transform(part, lambda x: x["t"]), "\n")).alias("text_md5"), F.count_if(on).alias("n_chunks"))


def filtered_drawings(s, d):
    """A page of the drawings in a state, newest first, with the number of all of them."""
    rows = L.filtered(drawings(s, d), equal={"status": "completed"}, between={"progress": (0.2, None)}).select("id", "project_id", "created_at")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_total")))
    return L.page(rows, [F.desc("created_at"), "id"], 5, 20).join(total)


def durations(s, d):
    rows = L.filtered(drawings(s, d), equal={"category": None}).where("updated_at is not null")
    return L.page(rows.select("id", "status", (F.unix_timestamp(F.col("updated_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))).alias("seconds"), "created_at"), [F.desc("created_at"), "id"], 0, 50).drop("created_at")


QUERIES = {
    "op_flt_logs": lambda s, d: L.page(L.filtered(events(s, d), equal={"event_type": "error"}, between={"user_id": (1, 500)}).where("ts >= '2024-01-10' and ts < '2024-02-01'").select("event_id", "user_id", "ts"), [F.desc("ts"), "event_id"], 20, 30),
    "op_flt_log_search": lambda s, d: L.filtered(events(s, d), contains={"props": '"k": 7'}).select("event_id", "user_id", "event_type"),
    "op_flt_projects": lambda s, d: L.page(L.filtered(table(s, d, "project_basic"), equal={"status": "active"}).select("project_id", "project_name"), ["project_id"], 2, 10),
    "op_flt_costs": lambda s, d: L.filtered(cost_lines(s, d), equal={"category": 2}).where("day between '1995-01-01' and '1995-03-31'").select("project_id", "category", F.col("actual").cast("double").alias("actual"), "day"),
    "op_flt_workflows": durations,
    "op_flt_drawings": filtered_drawings,
    "op_prj_to_dict": lambda s, d: table(s, d, "project_basic").select("project_id", F.to_json(F.struct("project_id", "project_name", F.coalesce("project_type", F.lit("")).alias("project_type"), "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))).alias("json")),
    "op_prj_project_rates": project_rates,
    "op_jn_peer_rates": lambda s, d: S.peers(project_rates(s, d).where("status = 'active' and cost_rate > 0"), "project_type", "cost_rate").withColumn("above_peers", F.col("cost_rate") > F.col("peer_mean")).drop("peer_mean"),
    "op_prd_input": lambda s, d: documents(s, d).select("doc_id", F.col("text").rlike(SQL_INJECTION).alias("sql_like"), F.col("text").rlike(XSS).alias("xss_like"), F.regexp_replace(F.trim("name"), "[<>\"']", "").alias("safe_name")),
    "op_prd_file": files,
    "op_prd_grant_valid": grants,
    "op_prd_actions": may,
    "op_ag_project_stats": project_statistics,
    "op_ag_monthly_safety": monthly_levels,
    "op_wn_halves": halves,
    "op_wn_seq_id": sequence_ids,
    "op_fn_hash_dict": lambda s, d: table(s, d, "project_basic").select("project_id", F.md5(F.concat(F.lit('{"id": "'), "project_id", F.lit('", "status": "'), "status", F.lit('"}'))).alias("hash")),
    "op_fn_json": lambda s, d: table(s, d, "extracted_elements").select("id", F.get_json_object("properties", "$.layer").alias("layer")).unionByName(chunk_table(s, d).select("id", F.from_json("metadata", "page int, lang string")["lang"].alias("layer"))).groupBy("layer").agg(F.count(F.lit(1)).alias("n")),
    "op_fn_keywords": keywords,
    "op_rt_preprocess": lambda s, d: table(s, d, "eval_items").select("item_id", T.preprocess(F.col("question")).alias("question")),
    "op_rt_cache": cached_answers,
    "op_src_headings": headings,
    "op_src_ocr_quality": lambda s, d: table(s, d, "extracted_elements").where("confidence >= 0.8").select("id", T.preprocess(F.col("content")).alias("content")),
    "op_src_pdf_range": page_range,
    "op_src_pdf_tables": table_rows,
    "op_src_scanned": lambda s, d: chunk_table(s, d).where("document_id is not null").groupBy("document_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.countDistinct("page_num").alias("pages")).select("document_id", ((F.coalesce("chars", F.lit(0)) == 0) | (F.col("chars") / F.greatest("pages", F.lit(1)) < 100)).alias("is_scanned")),
    "op_snk_chunks": stored_chunks,
    "op_snk_vec_delete": lambda s, d: table(s, d, "embeddings").where(~F.coalesce((F.col("label") == 3) & (F.col("vec_id") > 10), F.lit(False))).select("vec_id", "label"),
    "op_pipe_ingest": lambda s, d: ingested(documents(s, d)),
    "op_ag_ingest_stats": lambda s, d: ingested(documents(s, d)).groupBy("collection").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("state") == "failed").alias("n_failed"), F.sum("n_chunks").alias("n_chunks"), F.round(F.avg("n_chunks"), 4).alias("mean_chunks")),
    "op_pipe_rebuild": lambda s, d: R.build_index(chunk_table(s, d), key="id").posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")),
    "op_cl_ws": lambda s, d: documents(s, d).select("doc_id", T.squeeze_blanks(F.col("text")).alias("cleaned")),
    "op_cl_url_email": lambda s, d: documents(s, d).select("doc_id", T.drop_links(F.col("text")).alias("cleaned")),
    "op_ch_force": lambda s, d: C.fixed(documents(s, d), 500, 0),
    "op_fn_line_stats": lambda s, d: documents(s, d).select("doc_id", F.coalesce(F.round(F.aggregate(T.pieces(F.col("text"), "\n"), F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(T.pieces(F.col("text"), "\n")), F.lit(0)), 4), F.lit(0.0)).alias("mean_line")),
    "op_an_defect_dist": lambda s, d: monthly_levels(s, d).select("month", F.round(F.col("high") / F.col("total"), 6).alias("share_high"), F.round(F.col("medium") / F.col("total"), 6).alias("share_medium")),
}

_EV = "e as (select *, cast(json_extract_string(props, '$.k') as int) as k from events)"
_C = """c as (select o_custkey as cust, 'PRJ-' || lpad(cast(o_custkey % 80 + 1 as varchar), 4, '0') as project_id, l_linenumber % 4 as category, cast(l_extendedprice as decimal(15,2)) as planned, cast(l_extendedprice as decimal(15,2)) * cast(1 - l_discount + 2 * l_tax as decimal(5,2)) as actual, cast(l_shipdate as date) as day from lineitem join orders on l_orderkey = o_orderkey)"""
_RATES = f"""{_C}, t as (select project_id, sum(actual_progress) as done, count(*) as n from (select distinct * from task_schedule) group by 1), k as (select project_id, sum(actual) as spent from c group by 1),
r as (select project_id, project_type, status, coalesce(round(cast(coalesce(done, 0) as double) / n, 2), 0.0) as progress_rate, coalesce(round(cast(coalesce(spent, 0) as double) / nullif(cast(total_budget as double), 0), 4), 0.0) as cost_rate from project_basic left join t using (project_id) left join k using (project_id))"""
_LEVELS = "m as (select strftime(ts, '%Y-%m') as month, count(*) as total, count(*) filter (value >= 100) as high, count(*) filter (value >= 30 and value < 100) as medium, count(*) filter (value < 30 or value is null) as low, count(distinct cast(ts as date)) as check_days from events group by 1)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SPACE = r"[ \t\n\r\f\x{0b}]"
_TOKENS = lambda source, key: rf"""x as (select {key} as doc_id, regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\S+@\S+', '', 'g') as x from {source} where text is not null),
p as (select doc_id, token, count(*) as tf from (select doc_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) as token from x
  union all select doc_id, substr(x, i, 2) from (select doc_id, x, unnest(range(1, length(x))) as i from x) where regexp_matches(substr(x, i, 2), '^[\x{{4e00}}-\x{{9fff}}]{{2}}$'))
  where token not in ({_STOP}) and (length(token) > 1 or regexp_matches(token, '[a-z]')) group by all)"""  # noqa: E731
_CLEAN = rf"regexp_replace(translate(text, '　（）【】《》', ' ()[]<>'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}\x{{00}}-\x{{08}}\x{{0b}}-\x{{1f}}]', '', 'g')"
_SQUEEZED = r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({t}, chr(10)), lambda z: trim(z, ' ')), chr(10)), '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
_CLASS = "case when {best} = 0 then 'other' {whens} end"


def _classes(text):
    score = {k: " + ".join(f"((length({text}) - length(replace({text}, '{w.lower()}', ''))) // {len(w)})" for w in ws) for k, ws in T.DOC_TYPES.items()}
    best = f"greatest({', '.join(score.values())})"
    return _CLASS.format(best=best, whens=" ".join(f"when {v} = {best} then '{k}'" for k, v in score.items()))


_INGEST = rf"""i as (select doc_id, case when doc_type = 'standard' or coalesce(regexp_matches(name, '^(GB|JGJ|CJJ)'), false) then 'standards' when doc_type = 'contract' then 'contracts' else 'projects' end as collection,
  {_classes('lower(t)')} as doc_class, substr(md5(lower(regexp_replace(t, '{_SPACE}+', '', 'g'))), 1, 16) as fp, cast(case when coalesce(length(t), 0) > 0 then ceil(length(t) / 450.0) else 0 end as bigint) as n_chunks, case when coalesce(length(t), 0) > 0 then 'processed' else 'failed' end as state
  from (select doc_id, doc_type, name, {_SQUEEZED.format(t=_CLEAN)} as t from documents))"""

SQL = {
    "op_flt_logs": "select event_id, user_id, ts from events where event_type = 'error' and user_id between 1 and 500 and ts >= timestamp '2024-01-10' and ts < timestamp '2024-02-01' order by ts desc, event_id limit 30 offset 20",
    "op_flt_log_search": "select event_id, user_id, event_type from events where props like '%\"k\": 7%'",
    "op_flt_projects": "select project_id, project_name from project_basic where status = 'active' order by project_id limit 10 offset 2",
    "op_flt_costs": f"with {_C} select cust as project_id, category, cast(actual as double) as actual, day from c where category = 2 and day between date '1995-01-01' and date '1995-03-31'",
    "op_flt_workflows": "select id, status, cast(epoch(date_trunc('second', updated_at)) - epoch(date_trunc('second', created_at)) as bigint) as seconds from construction_drawings where updated_at is not null order by created_at desc, id limit 50",
    "op_flt_drawings": "with r as (select id, project_id, created_at from construction_drawings where status = 'completed' and progress >= 0.2) select *, (select count(*) from r) as n_total from r order by created_at desc, id limit 20 offset 5",
    "op_prj_to_dict": """select project_id, concat('{"project_id":"', project_id, '","project_name":"', project_name, '","project_type":"', coalesce(project_type, ''), '","status":"', status, '","created_at":"', strftime(created_at, '%Y-%m-%d %H:%M:%S'), '"}') as json from project_basic""",
    "op_prj_project_rates": f"with {_RATES} select * from r",
    "op_jn_peer_rates": f"with {_RATES} select project_id, project_type, cost_rate, case when count(*) over w > 1 then cost_rate > (sum(cost_rate) over w - cost_rate) / (count(*) over w - 1) end as above_peers from r where status = 'active' and cost_rate > 0 window w as (partition by project_type)",
    "op_prd_input": f"select doc_id, regexp_matches(text, '{SQL_INJECTION}') as sql_like, regexp_matches(text, '{XSS}') as xss_like, regexp_replace(trim(name, ' '), '[<>\"'']', '', 'g') as safe_name from documents",
    "op_prd_file": "select id, extension, case when extension in (" + ", ".join(f"'{x}'" for x in DANGEROUS) + ") then 'dangerous' " + " ".join(f"when extension in ({', '.join(repr(x) for x in exts)}) then case when file_size > {most} then 'too large' else '{kind}' end" for kind, (exts, most) in ALLOWED.items()) + r" else 'unknown' end as verdict from (select id, file_size, lower(regexp_extract(file_path, '\.([^./]+)$', 1)) as extension from construction_drawings)",
    "op_prd_grant_valid": "select project_id, (start_date is null or start_date <= date '2024-06-01') and (planned_end_date is null or planned_end_date >= date '2024-06-01') as is_valid from project_basic",
    "op_prd_actions": "with a(role, actions) as (values " + ", ".join(f"('{r}', '{','.join(sorted(xs))}')" for r, xs in ACTIONS.items()) + ") select user_id, role, actions from (select distinct user_id, case user_id % 4 when 0 then 'admin' when 1 then 'manager' when 2 then 'engineer' else 'viewer' end as role from events) join a using (role)",
    "op_ag_project_stats": f"""with {_C}, t as (select project_id, count(*) as n_tasks, count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'delayed') as n_delayed, count(*) filter (is_critical_path) as n_critical from (select distinct * from task_schedule) group by 1),
k as (select project_id, sum(planned) as p, sum(actual) as a, count(*) as n_cost_lines from c group by 1), s as (select 'PRJ-' || lpad(cast(user_id % 80 + 1 as varchar), 4, '0') as project_id, count(distinct cast(ts as date)) as n_check_days, count(*) filter (value >= 100) as n_high from events group by 1)
select project_id, coalesce(n_tasks, 0) as n_tasks, coalesce(n_completed, 0) as n_completed, coalesce(n_delayed, 0) as n_delayed, coalesce(n_critical, 0) as n_critical, cast(coalesce(p, 0) as double) as planned_cost, cast(coalesce(a, 0) as double) as actual_cost, cast(coalesce(a, 0) - coalesce(total_budget, 0) as double) as cost_variance, coalesce(n_cost_lines, 0) as n_cost_lines, coalesce(n_check_days, 0) as n_check_days, coalesce(n_high, 0) as n_high
from project_basic left join t using (project_id) left join k using (project_id) left join s using (project_id)""",
    "op_ag_monthly_safety": f"with {_LEVELS} select * from m",
    "op_an_defect_dist": f"with {_LEVELS} select month, round(high / total, 6) as share_high, round(medium / total, 6) as share_medium from m",
    "op_wn_halves": "with s as (select min(cast(ts as date)) + cast((max(cast(ts as date)) - min(cast(ts as date))) // 2 as int) as middle from events) select event_type, count(*) filter (cast(ts as date) < middle) as n_first, count(*) filter (cast(ts as date) >= middle) as n_second from events, s group by 1",
    "op_wn_seq_id": "select project_id, task_id, printf('RISK-%04d', rank) as risk_id from (select project_id, task_id, row_number() over (partition by project_id order by actual_progress - planned_progress, task_id) as rank from (select distinct * from task_schedule) where actual_progress < planned_progress) where rank <= 20",
    "op_fn_hash_dict": """select project_id, md5(concat('{"id": "', project_id, '", "status": "', status, '"}')) as hash from project_basic""",
    "op_fn_json": "select layer, count(*) as n from (select json_extract_string(properties, '$.layer') as layer from extracted_elements union all select json_extract_string(metadata, '$.lang') from document_chunks) group by 1",
    "op_fn_keywords": f"""with {_TOKENS('documents', 'doc_id')}, dl as (select doc_id, sum(tf) as dl from p group by 1), f as (select token, ln((select count(*) from dl) / (count(*) + 1)) as idf from p group by 1)
select doc_id, token, weight, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by weight desc, token) as rank from (select doc_id, token, round(tf / dl * idf, 6) as weight from p join dl using (doc_id) join f using (token))) where rank <= 5""",
    "op_rt_preprocess": rf"select item_id, trim(regexp_replace(question, '{_SPACE}+', ' ', 'g'), ' ') as question from eval_items",
    "op_rt_cache": rf"""with q as (select item_id, md5(trim(regexp_replace(question, '{_SPACE}+', ' ', 'g'), ' ')) as key from eval_items), f as (select key, min(item_id) as filled_by from q group by 1)
select item_id, 'query:result:' || key as cache_key, item_id <> filled_by as is_hit, filled_by from q join f using (key)""",
    "op_src_headings": rf"""select doc_id, cast(i - 1 as int) as no, cast(depth as int) as depth, repeat('#', depth::bigint) || ' ' || hs[i] as rendered from (select doc_id, hs, i, case when regexp_matches(hs[i], '^\d') then length(regexp_replace(regexp_extract(hs[i], '^(\d+(?:\.\d+)*)', 1), '[^.]', '', 'g')) + 1 else 1 end as depth
  from (select doc_id, hs, unnest(range(1, len(hs) + 1)) as i from (select doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda z: trim(z, ' ')), lambda z: regexp_matches(z, '{HEADING}') and length(z) < 60) as hs from documents)))""",
    "op_src_ocr_quality": rf"select id, trim(regexp_replace(content, '{_SPACE}+', ' ', 'g'), ' ') as content from extracted_elements where confidence >= 0.8",
    "op_src_pdf_range": "select document_id, count(distinct page_num) as n_pages, md5(coalesce(string_agg(coalesce(text, ''), chr(10) order by chunk_index, id) filter (page_num between 2 and 3), '')) as text_md5, count(*) filter (page_num between 2 and 3) as n_chunks from document_chunks where document_id is not null group by 1",
    "op_src_pdf_tables": "select doc_id, cast(i - 1 as int) as row, len(string_split(ls[i], '|'))::int as n_cells, array_to_string(list_transform(string_split(ls[i], '|'), lambda z: trim(z, ' ')), ' | ') as row_text from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda z: contains(z, '|')) as ls from documents))",
    "op_src_scanned": "select document_id, coalesce(sum(length(trim(text, ' '))), 0) = 0 or sum(length(trim(text, ' '))) / greatest(count(distinct page_num), 1) < 100 as is_scanned from document_chunks where document_id is not null group by 1",
    "op_snk_chunks": "select document_id, count(*) as n_chunks, case when count(*) filter (chunk_index >= 4 or chunk_index is null) > 0 then count(*) filter (chunk_index >= 4 or chunk_index is null) else count(*) end as total_chunks from document_chunks where document_id is not null group by 1",
    "op_snk_vec_delete": "select vec_id, label from embeddings where not coalesce(label = 3 and vec_id > 10, false)",
    "op_pipe_ingest": f"with {_INGEST} select * from i",
    "op_ag_ingest_stats": f"with {_INGEST} select collection, count(*) as n_docs, count(*) filter (state = 'failed') as n_failed, cast(sum(n_chunks) as bigint) as n_chunks, round(avg(n_chunks), 4) as mean_chunks from i group by 1",
    "op_pipe_rebuild": f"with {_TOKENS('document_chunks', 'id')} select token, count(*) as df, cast(sum(tf) as bigint) as occurrences from p group by 1",
    "op_cl_ws": f"select doc_id, {_SQUEEZED.format(t='text')} as cleaned from documents",
    "op_cl_url_email": r"select doc_id, regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'g') as cleaned from documents",
    "op_ch_force": """select doc_id, cast(s // 500 as int) as chunk_index, total_chunks, s as start_char, least(s + 500, length(text)) as end_char, substr(text, s + 1, 500) as content
  from (select doc_id, text, cast(len(range(0, length(text), 500)) as int) as total_chunks, cast(unnest(range(0, length(text), 500)) as int) as s from documents where length(text) > 0)""",
    "op_fn_line_stats": "select doc_id, coalesce(round(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda z: trim(z, ' ') <> ''), lambda z: length(z))) / len(list_filter(string_split(text, chr(10)), lambda z: trim(z, ' ') <> '')), 4), 0.0) as mean_line from documents",
}
