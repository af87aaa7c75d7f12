"""Queries of entity extraction and of the property graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.operators import extraction as X
from sitequarry.operators import graph as G
from sitequarry.operators.components import components
from sitequarry.operators.references import reference_key
from sitequarry.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def nodes(spark, d):
    """Drawing entities that are not deleted, one node per entity_id, with the least code."""
    e = table(spark, d, "drawing_entities").where("deleted_at is null")
    return e.groupBy(reference_key(F.col("entity_id")).alias("id")).agg(F.min("entity_type").alias("label"), F.min("code").alias("code")).where("id is not null")


def edges(spark, d):
    r = table(spark, d, "drawing_relations")
    return r.select(reference_key(F.col("from_entity_id")).alias("src"), reference_key(F.col("to_entity_id")).alias("dst"), "rel_type" if "rel_type" in r.columns else F.col("relation_type").alias("rel_type")).where("src is not null and dst is not null").distinct()


def seeds(spark, d):
    """The entities whose least row id is divisible by fifty."""
    e = table(spark, d, "drawing_entities").where("deleted_at is null")
    return e.groupBy(reference_key(F.col("entity_id")).alias("seed")).agg(F.min("id").alias("row")).where("seed is not null and row % 50 = 0").select("seed")


def drawing_graph(spark, d):
    """Drawing, entities and their counts per type: a left join with both sides aggregated first."""
    e = table(spark, d, "drawing_entities").groupBy("drawing_id").agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("entity_type").alias("n_types"))
    r = table(spark, d, "drawing_relations").where("drawing_id is not null").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_relations"))
    c = table(spark, d, "construction_drawings").select("id", "project_id")
    e, r = e.withColumnRenamed("drawing_id", "id"), r.withColumnRenamed("drawing_id", "id")
    return c.join(e, "id", "left").join(r, "id", "left").fillna(0, ["n_entities", "n_types", "n_relations"])


def pairs(spark, d):
    """Each start with the first entity of its own drawing and of the next one."""
    number = F.regexp_extract("start", r"^ENT-(\d+)-", 1).cast("long")
    goals = F.array(*(F.format_string("ENT-%08d-001", number + k) for k in (0, 1)))
    return seeds(spark, d).select(F.col("seed").alias("start")).select("start", F.explode(goals).alias("goal"))


QUERIES = {
    "op_gx_components": lambda s, d: X.entities(docs(s, d), X.COMPONENTS),
    "op_gx_materials": lambda s, d: X.entities(docs(s, d), X.MATERIALS),
    "op_gx_specs": lambda s, d: X.entities(docs(s, d), X.SPECS),
    "op_gx_dimensions": lambda s, d: X.dimensions(table(s, d, "extracted_elements").select(F.col("id").alias("doc_id"), F.col("content").alias("text"))).withColumn("number", X.first_number(F.col("value"))),
    "op_jn_relations": lambda s, d: X.relations(docs(s, d)).groupBy("doc_id", "rel_type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst")),
    "op_ag_graph_counts": lambda s, d: G.counts(nodes(s, d), edges(s, d)),
    "op_gr_neighbours": lambda s, d: G.neighbours(edges(s, d)),
    "op_gr_related": lambda s, d: G.within(edges(s, d), seeds(s, d), 2),
    "op_gr_subgraph": lambda s, d: G.subgraph(edges(s, d), seeds(s, d), 1),
    "op_gr_path": lambda s, d: G.paths(edges(s, d), pairs(s, d)),
    "op_gr_entity_search": lambda s, d: G.search(nodes(s, d), "^kl-?1"),
    "op_gr_context": lambda s, d: G.context(nodes(s, d), edges(s, d)),
    "op_gr_components": lambda s, d: components(edges(s, d), "src", "dst"),
    "op_gr_visual": lambda s, d: edges(s, d).join(nodes(s, d).select(F.col("id").alias("src")), "src", "left_semi").join(nodes(s, d).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type"),
    "op_ag_doc_graph_counts": drawing_graph,
}

_KEY = r"nullif(upper(regexp_replace({c}, '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g')), '')"
_N = f"nodes as (select * from (select {_KEY.format(c='entity_id')} as id, min(entity_type) as label, min(code) as code from drawing_entities where deleted_at is null group by 1) where id is not null)"
_E = f"edges as (select distinct * from (select {_KEY.format(c='from_entity_id')} as src, {_KEY.format(c='to_entity_id')} as dst, relation_type as rel_type from drawing_relations) where src is not null and dst is not null)"
_U = "und as (select distinct * from (select src, dst from edges union all select dst, src from edges))"
_S = f"seeds as (select seed from (select {_KEY.format(c='entity_id')} as seed, min(id) as r from drawing_entities where deleted_at is null group by 1) where seed is not null and r % 50 = 0)"


def _entities(kinds):
    parts = [f"select doc_id, {n} as ord, upper(unnest(regexp_extract_all(text, '{p}'))) as code from documents" for n, (_, ps) in enumerate(kinds.items()) for p in ps]
    name = "case min(ord) " + " ".join(f"when {n} then '{k}'" for n, k in enumerate(kinds)) + " end"
    return f"select doc_id, {name} as kind, code, count(*) as mentions from ({' union all '.join(parts)}) group by doc_id, code"


def _dimensions(source):
    parts = [f"select doc_id, 'section' as kind, regexp_extract(x, '{X.SECTION}', 1) || 'x' || regexp_extract(x, '{X.SECTION}', 2) as value from (select doc_id, unnest(regexp_extract_all(text, '{X.SECTION}')) as x from {source})"]
    parts += [f"select doc_id, '{k}', unnest(regexp_extract_all(text, '{p}', 1)) from {source}" for k, p in X.DIMENSIONS]
    return " union all ".join(parts)


_HOPS = f"""with recursive {_N}, {_E}, {_U}, {_S}, walk as (select seed, seed as node, 0 as depth from seeds union select w.seed, u.dst, w.depth + 1 from walk w join und u on u.src = w.node where w.depth < 2)"""
_RULES = lambda rules: ", ".join(f"('{c}', '{x}')" for c, xs in rules.items() for x in xs)

SQL = {
    "op_gx_components": _entities(X.COMPONENTS),
    "op_gx_materials": _entities(X.MATERIALS),
    "op_gx_specs": _entities(X.SPECS),
    "op_gx_dimensions": f"select *, coalesce(try_cast(nullif(regexp_extract(value, '(\\d+(?:\\.\\d+)?)', 1), '') as double), 0.0) as number from ({_dimensions('(select id as doc_id, content as text from extracted_elements)')})",
    "op_jn_relations": f"""with comp as ({_entities(X.COMPONENTS)}), mat as ({_entities(X.MATERIALS)}), dim as (select distinct * from ({_dimensions('documents')})),
uses(c, m) as (values {_RULES(X.USES)}), has(c, x) as (values {_RULES(X.HAS)}),
r as (select comp.doc_id, comp.code as src, mat.code as dst, 'USES_MATERIAL' as rel_type from comp join uses on comp.kind = c join mat on mat.doc_id = comp.doc_id and mat.kind = m
      union all select comp.doc_id, comp.code, dim.kind || ':' || value, 'HAS_DIMENSION' from comp join has on comp.kind = c join dim on dim.doc_id = comp.doc_id and dim.kind = x)
select doc_id, rel_type, count(*) as n, min(src) as first_src, max(dst) as last_dst from r group by all""",
    "op_ag_graph_counts": f"with {_N}, {_E} select 'node' as kind, label as name, count(*) as n from nodes group by all union all select 'relation', rel_type, count(*) from edges group by all",
    "op_gr_neighbours": f"with {_E}, {_U} select src, dst, degree from (select *, row_number() over (partition by src order by dst) as rn, count(*) over (partition by src) as degree from und) where rn <= 5",
    "op_gr_related": _HOPS + " select seed, node, min(depth) as depth from walk group by all",
    "op_gr_subgraph": f"with {_N}, {_E}, {_U}, {_S}, near as (select seed, seed as node from seeds union select seed, dst from seeds join und on src = seed) select a.seed, src, dst, rel_type from edges join near a on a.node = src join near b on b.node = dst and b.seed = a.seed",
    "op_gr_path": f"""with recursive {_N}, {_E}, {_U}, {_S}, pairs as (select seed as start, printf('ENT-%08d-001', cast(regexp_extract(seed, '^ENT-(\\d+)-', 1) as bigint) + k) as goal from seeds, (values (0), (1)) v(k)),
walk as (select distinct start, start as node, start as path, 0 as depth from pairs union all select w.start, u.dst, w.path || '>' || u.dst, w.depth + 1 from walk w join und u on u.src = w.node where w.depth < 4 and not contains('>' || w.path || '>', '>' || u.dst || '>')),
best as (select start, node, depth, min(path) as path from walk group by start, node, depth)
select p.start, p.goal, depth as hops, path from pairs p join best b on b.start = p.start and b.node = p.goal and depth = (select min(depth) from best c where c.start = b.start and c.node = b.node)""",
    "op_gr_entity_search": f"with {_N} select id, label, code, score from (select *, case when regexp_matches(code, '(?i)^kl-?1') then cast(0.9 as double) else 0.7 end as score from nodes where regexp_matches(code, '(?i)^kl-?1') or regexp_matches(id, '(?i)^kl-?1')) order by score desc, id limit 20",
    "op_gr_context": f"with {_N}, {_E}, f as (select * from (select *, row_number() over (partition by src order by rel_type, dst) as rn from edges) where rn <= 5), t as (select src, string_agg(rel_type || '->' || dst, '; ' order by rn) as rels from f group by src) select id, concat_ws(': ', code, rels) as context from nodes left join t on src = id",
    "op_gr_components": f"""with recursive {_E}, {_U}, walk as (select distinct src as node, src as origin from und union select u.dst, w.origin from walk w join und u on u.src = w.node where w.origin < u.dst)
select node, min(origin) as component from walk group by node""",
    "op_gr_visual": f"with {_N}, {_E} select src, dst, rel_type from edges where src in (select id from nodes) and dst in (select id from nodes)",
    "op_ag_doc_graph_counts": """select c.id, c.project_id, coalesce(n_entities, 0) as n_entities, coalesce(n_types, 0) as n_types, coalesce(n_relations, 0) as n_relations from construction_drawings c
  left join (select drawing_id, count(distinct entity_id) as n_entities, count(distinct entity_type) as n_types from drawing_entities group by 1) e on e.drawing_id = c.id
  left join (select drawing_id, count(*) as n_relations from drawing_relations group by 1) r on r.drawing_id = c.id""",
}
