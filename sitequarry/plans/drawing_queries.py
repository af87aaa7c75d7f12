"""Queries of drawings: what texts and tables name, typed nodes and edges, and reads of the property graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitequarry.operators import extraction as X
from sitequarry.operators import graph as G
from sitequarry.plans.graph_queries import _E, _N, _S, docs, edges, nodes, seeds
from sitequarry.sources.tables import table

# Words that name a kind of entity in a question.
KEYWORDS = {
    "component": ("构件", "梁", "柱", "板", "墙", "基础", "楼梯", "KL", "KZ", "LB", "Q"),
    "material": ("材料", "混凝土", "钢筋", "钢材", "C30", "C35", "HRB400", "Q235"),
    "specification": ("规范", "标准", "GB", "JGJ", "DBJ"),
    "dimension": ("尺寸", "厚度", "高度", "宽度", "跨度", "截面"),
}
# Labelled fields of a title block, and kinds of annotations.
INFO = {
    "drawing_number": (r"图号\s*[:：]\s*([\w\-\.]+)", r"图纸编号\s*[:：]\s*([\w\-\.]+)"),
    "drawing_name": (r"图名\s*[:：]\s*([^\n]+)", r"图纸名称\s*[:：]\s*([^\n]+)"),
    "scale": (r"比例\s*[:：]\s*1\s*[:：／/]\s*(\d+)",),
    "designer": (r"设计[人]?\s*[:：]\s*(\S+)",),
}
NOTES = {"general_note": r"注\s*[:：]\s*([^\n]+)", "description": r"说明\s*[:：]\s*([^\n]+)", "remark": r"备注\s*[:：]\s*([^\n]+)", "technical_requirement": r"技术要求\s*[:：]\s*([^\n]+)"}
#: The shape of a title block without labels: name, number and scale between bars.
BLOCK = r"^([^|\n]+) \| ([A-Z\p{IsHan}]+-\d+) \| (1:\d+|NTS)$"
CONFIDENCE = {"component": 0.9, "material": 0.95}


def elements(s, d):
    return table(s, d, "extracted_elements").select(F.col("id").alias("doc_id"), "drawing_id", "element_type", F.col("content").alias("text"))


def query_entities(s, d):
    """Codes and key words that each text names, as a retriever takes them from a question: doc_id, kind, value."""
    t = docs(s, d)
    codes = X.entities(t, X.COMPONENTS).select("doc_id", F.lit("component").alias("kind"), F.col("code").alias("value")).unionByName(X.entities(t, X.MATERIALS).select("doc_id", F.lit("material").alias("kind"), F.col("code").alias("value")))
    words = F.array(*(F.when(F.contains(F.col("text"), F.lit(w)), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("value"))) for k, ws in KEYWORDS.items() for w in ws))
    named = t.select("doc_id", F.explode(F.filter(words, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.kind", "x.value")
    return codes.unionByName(named).distinct()


def drawing_info(s, d):
    """Fields of the title blocks: labelled ones, else by their place between bars; null where there is none."""
    t = F.col("text")
    got = lambda ps: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")) for p in ps))
    at = lambda n: F.nullif(F.regexp_extract(t, BLOCK, n), F.lit(""))
    info = elements(s, d).where("element_type = 'title_block'")
    return info.select("doc_id", F.coalesce(got(INFO["drawing_number"]), at(2)).alias("drawing_number"), F.coalesce(got(INFO["drawing_name"]), at(1)).alias("drawing_name"), F.coalesce(F.concat(F.lit("1:"), got(INFO["scale"])), at(3)).alias("scale"), got(INFO["designer"]).alias("designer"))


def annotations(s, d):
    """doc_id, kind and content of the labelled notes in documents longer than five characters."""
    t = F.col("text")

    def notes(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("content")))

    each = [notes(k, p) for k, p in NOTES.items()]
    return docs(s, d).where(t.isNotNull()).select("doc_id", F.explode(F.concat(*each)).alias("x")).select("doc_id", "x.*").where(F.length("content") > 5)


def table_entities(s, d):
    """Materials and components in the rows of tables, by the words of the header: doc_id, kind, code."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.contains("|"))
    rows = docs(s, d).select("doc_id", F.col("text").alias("all"), F.explode(lines).alias("text"))
    about = F.when(F.col("all").rlike("材料|混凝土|钢筋|concrete|Beton"), "material").when(F.col("all").rlike("构件|梁|柱|beam|column"), "component")
    rows = rows.select("doc_id", "text", about.alias("about"))
    mats = X.entities(rows.where("about = 'material'"), X.MATERIALS).select("doc_id", F.lit("material").alias("kind"), "code")
    comps = X.entities(rows.where("about = 'component'"), {k: X.COMPONENTS[k] for k in ("beam", "column")}).select("doc_id", F.lit("component").alias("kind"), "code")
    return mats.unionByName(comps).distinct()


def typed_nodes(s, d):
    """One node per document and code, its id a hash of both, so that it is the same in every run; with kind, type and confidence."""
    t = docs(s, d)
    parts = [X.entities(t, kinds).select("doc_id", F.lit(name).alias("kind"), F.col("kind").alias("type"), "code", "mentions", F.lit(CONFIDENCE[name]).alias("confidence")) for name, kinds in (("component", X.COMPONENTS), ("material", X.MATERIALS))]
    return parts[0].unionByName(parts[1]).select(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "kind", "code")).alias("node_id"), "doc_id", "kind", "type", "code", "mentions", "confidence")


def document_edges(s, d):
    """Components and materials belong to their document."""
    n = typed_nodes(s, d)
    return n.select(F.col("node_id").alias("src"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dst"), F.lit("BELONGS_TO").alias("rel_type"), "confidence")


def connected(s, d):
    """Beams meet columns and slabs meet beams on one page of a drawing: how many edges there are of each kind; the pairs are not listed."""
    e = table(s, d, "drawing_entities").where("deleted_at is null")
    per = e.groupBy("drawing_id", "page_num").pivot("entity_type", ["beam", "column", "slab"]).agg(F.countDistinct("entity_id"))
    n = per.fillna(0).select("drawing_id", "page_num", (F.col("beam") * F.col("column")).alias("beam_column"), (F.col("slab") * F.col("beam")).alias("slab_beam"))
    return n.where("beam_column + slab_beam > 0")


def optional_match(s, d):
    """Every component with its materials, dimensions and neighbours, each side folded to one row before it is joined."""
    comp = nodes(s, d).where(F.col("label").isin("beam", "column", "slab", "wall", "foundation"))
    e = edges(s, d)
    to = lambda rel, name: e.where(F.col("rel_type") == rel).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias(name))
    out = comp.select("id", "label")
    for rel, name in (("USES_MATERIAL", "materials"), ("HAS_DIMENSION", "dimensions"), ("CONNECTED_TO", "connected")):
        out = out.join(to(rel, name), "id", "left")
    return out.fillna("")


def material_documents(s, d):
    """Per material: documents that name it, and components in them."""
    n = typed_nodes(s, d)
    per_doc = n.where("kind = 'component'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_components"))
    return n.where("kind = 'material'").select("doc_id", "code").join(per_doc, "doc_id", "left").groupBy("code").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_components"), F.lit(0)).alias("n_components"))


def document_graph(s, d):
    """Nodes within two outgoing hops of each start, with their depth."""
    return G.within(edges(s, d), seeds(s, d), 2, directed=True)


def relations_of(s, d):
    """The first twenty outgoing relations of each start, and of the targets of the first five of them: seed, level, src, rel_type, dst."""
    ordered = lambda df, keys, k: df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("rel_type", "dst"))).where(F.col("rn") <= k)
    e = edges(s, d)
    first = ordered(seeds(s, d).join(e, F.col("seed") == F.col("src")), ["seed"], 20)
    second = first.where("rn <= 5").select("seed", F.col("dst").alias("src")).distinct().join(e, "src")
    second = ordered(second, ["seed", "src"], 20)
    cols = ("seed", "src", "rel_type", "dst")
    return first.select(F.lit(1).alias("level"), *cols).unionByName(second.select(F.lit(2).alias("level"), *cols))


def related_documents(s, d, k=5):
    """For each material and component code the five documents that mention it most."""
    n = typed_nodes(s, d).groupBy("code", "doc_id").agg(F.sum("mentions").alias("relevance"))
    w = Window.partitionBy("code").orderBy(F.desc("relevance"), "doc_id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def any_property(s, d):
    """Nodes of which any property matches, regardless of case."""
    pattern = "(?i)c30|^kz-1"
    e = table(s, d, "drawing_entities").where("deleted_at is null")
    return e.where(F.concat_ws("\n", "code", "name", "value", "entity_label").rlike(pattern.replace("|^", "|(?m)^"))).select("id", "entity_type", "code", "value")


def inferred(s, d):
    """The kind of a node inferred from what it has, beside the one it was given."""
    e = table(s, d, "drawing_entities")
    code = F.upper(F.coalesce("code", F.lit("")))
    kind = F.when(code.contains("KL") | code.contains("KZ") | code.contains("LB"), "component").when(F.col("value").rlike(r"^C\d{2}$"), "material").when(code.contains("GB"), "specification").when(F.col("value").isNotNull(), "dimension").otherwise("unknown")
    return e.groupBy(kind.alias("inferred"), F.col("entity_type").alias("given")).agg(F.count(F.lit(1)).alias("n"))


def entity_counts(s, d):
    """Per drawing and kind: entities, those not deleted, and the sum of their confidence."""
    e = table(s, d, "drawing_entities")
    return e.groupBy("drawing_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deleted_at").isNull()).alias("n_live"), F.sum(F.col("confidence").cast("decimal(10,3)")).cast("double").alias("confidence"))


def processed(s, d):
    """Each drawing through the steps of processing: elements, entities, relations, and seconds from the first to the last of them."""
    step = lambda t, name: table(s, d, t).where("drawing_id is not null").groupBy(F.col("drawing_id").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("created_at").alias(f"last_{name}"))
    out = table(s, d, "construction_drawings").select("id", "created_at")
    for t, name in (("extracted_elements", "elements"), ("drawing_entities", "entities"), ("drawing_relations", "relations")):
        out = out.join(step(t, name), "id", "left")
    last = F.greatest("last_elements", "last_entities", "last_relations")
    state = F.when(F.col("n_entities").isNull(), "empty").when(F.col("n_relations").isNull(), "unrelated").otherwise("done")
    seconds = F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return out.select("id", *(F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("elements", "entities", "relations")), state.alias("state"), seconds.alias("seconds"))


def summaries(s, d):
    """Per document what a prompt is told of its graph: its components and materials, five of each at most, a line for each kind."""
    n = typed_nodes(s, d)
    w = Window.partitionBy("doc_id", "kind").orderBy("code")
    top = n.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("doc_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("codes"))
    line = F.concat(F.lit("related "), "kind", F.lit("s: "), "codes")
    return top.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("context"))


QUERIES = {
    "op_gx_query_entities": query_entities,
    "op_gx_drawing_info": drawing_info,
    "op_gx_annotations": annotations,
    "op_gx_table_entities": table_entities,
    "op_gx_nodes": typed_nodes,
    "op_gx_process": processed,
    "op_jn_doc_edges": document_edges,
    "op_jn_connected": connected,
    "op_jn_opt_match": optional_match,
    "op_jn_spec_docs": material_documents,
    "op_gr_find": lambda s, d: nodes(s, d).where("label = 'beam' and code is not null").select("id", "code"),
    "op_gr_doc_graph": document_graph,
    "op_gr_relations_of": relations_of,
    "op_gr_related_docs": related_documents,
    "op_gr_search": any_property,
    "op_gr_infer_type": inferred,
    "op_ag_entity_counts": entity_counts,
    "op_rt_global_summary": summaries,
}


def _hits(kinds, source, name):
    parts = [f"select doc_id, {n} as ord, upper(unnest(regexp_extract_all(text, '{p}'))) as code from {source}" for n, ps in enumerate(kinds.values()) for p in ps]
    of = "case min(ord) " + " ".join(f"when {n} then '{k}'" for n, k in enumerate(kinds)) + " end"
    return f"select doc_id, '{name}' as kind, {of} as type, code, count(*) as mentions from ({' union all '.join(parts)}) group by doc_id, code"


_TYPED = f"""n as (select md5(concat_ws(':', doc_id, kind, code)) as node_id, doc_id, kind, type, code, mentions, case kind when 'component' then cast(0.9 as double) else 0.95 end as confidence
  from ({_hits(X.COMPONENTS, 'documents', 'component')} union all {_hits(X.MATERIALS, 'documents', 'material')}))"""
_WORDS = " union all ".join(f"select doc_id, '{k}', '{w}' from documents where contains(text, '{w}')" for k, ws in KEYWORDS.items() for w in ws)
_START = _S.replace("seeds as", "starts as")
_INFO = lambda ps: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(content, '{p}', 1)), '')" for p in ps) + ", null)"
_BLOCK = BLOCK.replace("IsHan", "Han")

SQL = {
    "op_gx_query_entities": f"with {_TYPED} select distinct * from (select doc_id, kind, code as value from n union all {_WORDS})",
    "op_gx_drawing_info": f"""select id as doc_id, coalesce({_INFO(INFO['drawing_number'])}, nullif(regexp_extract(content, '{_BLOCK}', 2), '')) as drawing_number, coalesce({_INFO(INFO['drawing_name'])}, nullif(regexp_extract(content, '{_BLOCK}', 1), '')) as drawing_name,
  coalesce('1:' || {_INFO(INFO['scale'])}, nullif(regexp_extract(content, '{_BLOCK}', 3), '')) as scale, {_INFO(INFO['designer'])} as designer from extracted_elements where element_type = 'title_block'""",
    "op_gx_annotations": "select doc_id, kind, content from (" + " union all ".join(f"select doc_id, '{k}' as kind, trim(unnest(regexp_extract_all(text, '{p}', 1)), ' ') as content from documents" for k, p in NOTES.items()) + ") where length(content) > 5",
    "op_gx_table_entities": f"""with r as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda z: contains(z, '|'))) as text, case when regexp_matches(text, '材料|混凝土|钢筋|concrete|Beton') then 'material' when regexp_matches(text, '构件|梁|柱|beam|column') then 'component' end as about from documents),
a as (select * from r where about = 'material'), b as (select * from r where about = 'component')
select distinct doc_id, kind, code from ({_hits(X.MATERIALS, 'a', 'material')} union all {_hits({k: X.COMPONENTS[k] for k in ('beam', 'column')}, 'b', 'component')})""",
    "op_gx_nodes": f"with {_TYPED} select * from n",
    "op_gx_process": """with x as (select drawing_id as id, count(*) as n, max(created_at) as l from extracted_elements group by 1), y as (select drawing_id as id, count(*) as n, max(created_at) as l from drawing_entities group by 1), z as (select drawing_id as id, count(*) as n, max(created_at) as l from drawing_relations where drawing_id is not null group by 1)
select c.id, coalesce(x.n, 0) as n_elements, coalesce(y.n, 0) as n_entities, coalesce(z.n, 0) as n_relations, case when y.n is null then 'empty' when z.n is null then 'unrelated' else 'done' end as state,
  cast(epoch(date_trunc('second', greatest(x.l, y.l, z.l))) - epoch(date_trunc('second', c.created_at)) as bigint) as seconds from construction_drawings c left join x using (id) left join y using (id) left join z using (id)""",
    "op_jn_doc_edges": f"with {_TYPED} select node_id as src, 'doc_' || doc_id as dst, 'BELONGS_TO' as rel_type, confidence from n",
    "op_jn_connected": """select * from (select drawing_id, page_num, b * c as beam_column, s * b as slab_beam from (select drawing_id, page_num, count(distinct entity_id) filter (entity_type = 'beam') as b, count(distinct entity_id) filter (entity_type = 'column') as c, count(distinct entity_id) filter (entity_type = 'slab') as s
  from drawing_entities where deleted_at is null group by all)) where beam_column + slab_beam > 0""",
    "op_jn_opt_match": f"""with {_N}, {_E}, f as (select src, rel_type, string_agg(distinct dst, ',' order by dst) as l from edges group by all)
select id, label, coalesce(m.l, '') as materials, coalesce(x.l, '') as dimensions, coalesce(c.l, '') as connected from nodes left join f m on m.src = id and m.rel_type = 'USES_MATERIAL' left join f x on x.src = id and x.rel_type = 'HAS_DIMENSION' left join f c on c.src = id and c.rel_type = 'CONNECTED_TO'
where label in ('beam', 'column', 'slab', 'wall', 'foundation')""",
    "op_jn_spec_docs": f"with {_TYPED}, c as (select doc_id, count(*) as k from n where kind = 'component' group by 1) select code, count(*) as n_docs, cast(coalesce(sum(k), 0) as bigint) as n_components from n left join c using (doc_id) where kind = 'material' group by 1",
    "op_gr_find": f"with {_N} select id, code from nodes where label = 'beam' and code is not null",
    "op_gr_doc_graph": f"with recursive {_E}, {_START}, walk as (select seed, seed as node, 0 as depth from starts union select w.seed, e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 2) select seed, node, min(depth) as depth from walk group by all",
    "op_gr_relations_of": f"""with {_E}, {_START}, a as (select * from (select seed, src, rel_type, dst, row_number() over (partition by seed order by rel_type, dst) as rn from starts join edges on seed = src) where rn <= 20),
b as (select * from (select seed, e.src, e.rel_type, e.dst, row_number() over (partition by seed, e.src order by e.rel_type, e.dst) as rn from (select distinct seed, dst as src from a where rn <= 5) x join edges e on e.src = x.src) where rn <= 20)
select 1 as level, seed, src, rel_type, dst from a union all select 2, seed, src, rel_type, dst from b""",
    "op_gr_related_docs": f"with {_TYPED} select code, doc_id, cast(relevance as bigint) as relevance, cast(rank as int) as rank from (select code, doc_id, sum(mentions) as relevance, row_number() over (partition by code order by sum(mentions) desc, doc_id) as rank from n group by code, doc_id) where rank <= 5",
    "op_gr_search": "select id, entity_type, code, value from drawing_entities where deleted_at is null and (regexp_matches(coalesce(code, ''), '(?i)c30|^kz-1') or regexp_matches(coalesce(name, ''), '(?i)c30|^kz-1') or regexp_matches(coalesce(value, ''), '(?i)c30|^kz-1') or regexp_matches(coalesce(entity_label, ''), '(?i)c30|^kz-1'))",
    "op_gr_infer_type": r"select case when regexp_matches(upper(coalesce(code, '')), 'KL|KZ|LB') then 'component' when regexp_matches(value, '^C\d{2}$') then 'material' when contains(upper(coalesce(code, '')), 'GB') then 'specification' when value is not null then 'dimension' else 'unknown' end as inferred, entity_type as given, count(*) as n from drawing_entities group by all",
    "op_ag_entity_counts": "select drawing_id, entity_type, count(*) as n, count(*) filter (deleted_at is null) as n_live, cast(sum(cast(confidence as decimal(10,3))) as double) as confidence from drawing_entities group by all",
    "op_rt_global_summary": f"""with {_TYPED}, t as (select doc_id, kind, string_agg(code, ', ' order by code) as codes from (select *, row_number() over (partition by doc_id, kind order by code) as rn from n) where rn <= 5 group by all)
select doc_id, string_agg('related ' || kind || 's: ' || codes, chr(10) order by 'related ' || kind || 's: ' || codes) as context from t group by 1""",
}
