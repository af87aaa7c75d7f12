"""Queries of batch retrieval, with SQL twins. The query set is every row whose id is divisible by fifty, against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators import extraction as X
from sitequarry.operators import retrieval as R
from sitequarry.plans.session import checkpoint_dir
from sitequarry.plans.session import stored as stored_table
from sitequarry.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def index(spark, d):
    return R.build_index(docs(spark, d))


def queries_of(idx):
    """Every fiftieth document as a query, with its whole text."""
    return R.Index(idx.texts.where("doc_id % 50 = 0")).posts.select(F.col("doc_id").alias("query_id"), "token", F.col("tf").alias("qtf"))


def lexical(idx, k=20):
    return R.bm25(queries_of(idx), idx, k)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding", "label")


def dense(spark, d, k=10):
    v = vectors(spark, d)
    return R.dense(v.where("id % 50 = 0"), v, k)


def semantic(idx, k=20):
    """The vector list: texts by the cosine of their hashed embeddings."""
    return R.dense(R.embedded(idx.texts.where("doc_id % 50 = 0")), R.embedded(idx.texts), k)


def named(spark, d):
    """doc_id and token of the codes named in each document, components and materials; stored, as they are read several times."""
    each = docs(spark, d).select("doc_id", "text")
    codes = X.entities(each, X.COMPONENTS).select("doc_id", F.col("code").alias("token")).unionByName(X.entities(each, X.MATERIALS).select("doc_id", F.col("code").alias("token")))
    return stored_table(codes.distinct())


def graph(codes, k=5):
    """The graph list: texts by the number of codes that they name as the query does."""
    wanted = codes.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "token")
    return R.matched(wanted.withColumn("qw", F.lit(1.0)), codes.withColumn("w", F.lit(1.0)), k)


def three(spark, d):
    idx = index(spark, d)
    return {"bm25": lexical(idx), "graph": graph(named(spark, d)), "vector": semantic(idx)}


def packed(spark, d):
    hits = lexical(index(spark, d), 20).join(docs(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id")
    return R.pack(hits, 3000).select("query_id", "doc_id", "rank", "used_chars")


def tiered(spark, d):
    """Every tier is searched for its own best: specifications first, then contracts, then the rest."""
    texts = index(spark, d).texts
    tier = F.when(F.col("doc_type") == "standard", 0).when(F.col("doc_type") == "contract", 2).otherwise(1)
    of = docs(spark, d).select(F.col("doc_id").alias("id"), tier.alias("tier"))
    hits = R.dense(R.embedded(texts.where("doc_id % 50 = 0")), R.embedded(texts).join(of, "id"), 5, by="tier")
    return R.tiers(hits.drop("rank"), 5).select("query_id", "doc_id", "tier", "score", "rank")


def with_tokens(hits, idx):
    """Hits with the distinct tokens of the query and of the text."""
    per = idx.texts.select("doc_id", F.col("tokens").alias("d_tokens"))
    asked = per.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("d_tokens").alias("q_tokens"))
    return hits.join(per, "doc_id").join(asked, "query_id")


def reranked(spark, d):
    idx = index(spark, d)
    return R.overlap_rerank(with_tokens(lexical(idx), idx))


def hybrid(spark, d):
    idx = index(spark, d)
    fused = R.rrf({"bm25": lexical(idx), "vector": semantic(idx)}).where("rank <= 15")
    return R.overlap_rerank(with_tokens(fused, idx))


def enhanced(spark, d):
    """The ten best of three fused lists, each with the codes that it shares with its query, five at most, as context."""
    idx, codes = index(spark, d), named(spark, d)
    hits = R.rrf({"bm25": lexical(idx), "vector": semantic(idx), "graph": graph(codes)}, {"bm25": 0.3, "vector": 0.4, "graph": 0.36}).where("rank <= 10").select("query_id", "doc_id", "score", "rank")
    asked = codes.select(F.col("doc_id").alias("query_id"), "token")
    shared = hits.join(codes, "doc_id").join(asked, ["query_id", "token"]).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("token")).alias("codes"))
    return hits.join(shared, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "score", "rank", F.array_join(F.slice(F.coalesce("codes", F.array().cast("array<string>")), 1, 5), ",").alias("context"))


def fused_scores(spark, d):
    """Scores of three stages fused over the union of the candidates."""
    idx = index(spark, d)
    lex = lexical(idx)
    again = R.overlap_rerank(with_tokens(lex, idx), 20).select("query_id", "doc_id", F.col("rerank_score").alias("score"))
    return R.weighted({"bm25": lex, "vector": semantic(idx), "rerank": again}, {"bm25": 0.3, "vector": 0.3, "rerank": 0.4})


def stored(spark, d):
    """The index stored from the even documents, the odd ones appended, and read again: df and occurrences of every token."""
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    R.write_index(docs(spark, d).where("doc_id % 2 = 0"), path)
    R.write_index(docs(spark, d).where("doc_id % 2 = 1"), path, append=True)
    return R.read_index(spark, path).posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def _rounded(df, column, digits):
    return df.withColumn(column, F.round(column, digits))


QUERIES = {
    "op_ag_bm25_corpus": lambda s, d: _rounded(index(s, d).corpus, "avgdl", 6),
    "op_rt_bm25_build": lambda s, d: _rounded(index(s, d).terms, "idf", 6),
    "op_snk_bm25_index": stored,
    "op_rt_bm25_search": lambda s, d: _rounded(lexical(index(s, d)), "score", 5),
    "op_rt_embed": lambda s, d: R.embedded(index(s, d).texts).select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 5)),
    "op_rt_vec_search": dense,
    "op_rt_vec_text": lambda s, d: semantic(index(s, d), 10),
    "op_rt_graph_search": lambda s, d: graph(named(s, d)),
    "op_rt_vec_filter": lambda s, d: R.dense(vectors(s, d).where("id % 50 = 0"), vectors(s, d).where("label < 5"), 5),
    "op_fn_similarity": lambda s, d: R.similarity(vectors(s, d).alias("x").join(vectors(s, d).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id"), "embedding", "other").select("id", "cosine", "dot", "neg_euclidean"),
    "op_ag_embed_stats": lambda s, d: R.norms(vectors(s, d)),
    "op_rt_rrf": lambda s, d: (lambda idx: R.rrf({"bm25": lexical(idx), "vector": semantic(idx)}).select("query_id", "doc_id", "score", "rank"))(index(s, d)),
    "op_rt_rrf3": lambda s, d: R.rrf(three(s, d), {"bm25": 0.3, "vector": 0.4, "graph": 0.36}).select("query_id", "doc_id", "score", F.array_join("sources", "+").alias("sources"), "rank"),
    "op_rt_wfuse2": lambda s, d: (lambda idx: R.weighted({"bm25": lexical(idx), "vector": semantic(idx)}, {"bm25": 0.5, "vector": 0.5}))(index(s, d)),
    "op_rt_wfuse3": lambda s, d: R.weighted(three(s, d), {"bm25": 0.3, "vector": 0.4, "graph": 0.3}, per_list=True, bonus={"graph": 0.1}),
    "op_rt_fuse_scores": fused_scores,
    "op_rt_graph_enh": enhanced,
    "op_wn_pack": packed,
    "op_rt_vec_hier": tiered,
    "op_rt_rerank": reranked,
    "op_rt_hybrid": hybrid,
}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _toks(name, source):
    return rf"""{name}_x as (select doc_id, regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\S+@\S+', '', 'g') as x from {source} where text is not null),
{name} as (select doc_id, token, count(*) as tf from (select doc_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) as token from {name}_x
  union all select doc_id, substr(x, i, 2) from (select doc_id, x, unnest(range(1, length(x))) as i from {name}_x) where regexp_matches(substr(x, i, 2), '^[\x{{4e00}}-\x{{9fff}}]{{2}}$'))
  where token not in ({_STOP}) and (length(token) > 1 or regexp_matches(token, '[a-z]')) group by all)"""


_EACH = lambda kinds: " union ".join(f"select doc_id, upper(unnest(regexp_extract_all(text, '{p}'))) as token from documents" for ps in kinds.values() for p in ps)
_BM25 = f"""with {_toks('p', 'documents')}, qt as (select * from p where doc_id % 50 = 0),
dl as (select doc_id, sum(tf) as dl from p group by doc_id), c as (select count(*) as n_docs, avg(dl) as avgdl, min(dl) as min_dl, max(dl) as max_dl from dl),
t0 as (select token, count(*) as df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, c group by token),
t as (select token, df, case when raw < 0 then 0.25 * (select avg(raw) from t0) else raw end as idf from t0),
s as (select q.doc_id as query_id, p.doc_id, round(sum(q.tf * idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) as score
      from qt q join p using (token) join t using (token) join dl on dl.doc_id = p.doc_id, c group by all),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 20),
h0 as (select doc_id, ('0x' || substr(md5(token), 1, 4))::int % 64 as place, sum(case when ('0x' || substr(md5(token), 5, 1))::int < 8 then tf else -tf end)::double as v from p group by all),
h as (select doc_id, place, v / n as v from h0 join (select doc_id, sqrt(sum(v * v)) as n from h0 group by doc_id) using (doc_id) where n > 0),
vs as (select q.doc_id as query_id, x.doc_id, 0 as score from (select doc_id from dl where doc_id % 50 = 0) q, dl x),
va as (select query_id, doc_id, round(coalesce(s, 0), 5) as score from vs left join (select q.doc_id as query_id, x.doc_id, sum(q.v * x.v) as s from h q join h x using (place) where q.doc_id % 50 = 0 group by all) using (query_id, doc_id)),
vec as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from va) where rank <= 20),
codes as ({_EACH(X.COMPONENTS | X.MATERIALS)}),
gr as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select q.doc_id as query_id, x.doc_id, count(*)::double as score from codes q join codes x using (token) where q.doc_id % 50 = 0 group by all)) where rank <= 5),
rr as (select bm.query_id, bm.doc_id, round(count(p.token) / any_value(n), 6) as score, any_value(bm.rank) as rank from bm join (select doc_id, token, count(*) over (partition by doc_id) as n from qt) q on q.doc_id = bm.query_id left join p on p.doc_id = bm.doc_id and p.token = q.token group by bm.query_id, bm.doc_id)
"""
_RANK = "row_number() over (partition by query_id order by score desc, doc_id) as rank"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"


def _scaled(x):
    return f"case when max({x}) over w = min({x}) over w then 1.0 else ({x} - min({x}) over w) / (max({x}) over w - min({x}) over w) end"


SQL = {
    "op_ag_bm25_corpus": _BM25 + "select n_docs, round(avgdl, 6) as avgdl, cast(min_dl as int) as min_dl, cast(max_dl as int) as max_dl from c",
    "op_rt_bm25_build": _BM25 + "select token, df, round(idf, 6) as idf from t",
    "op_rt_bm25_search": _BM25 + "select query_id, doc_id, round(score, 5) as score, cast(rank as int) as rank from bm",
    "op_rt_vec_search": f"""select query_id, doc_id, score, cast(rank as int) as rank from (select *, {_RANK} from (
  select q.vec_id as query_id, v.vec_id as doc_id, round({_DOT.format(a='q.embedding', b='v.embedding')}, 5) as score from embeddings q, embeddings v where q.vec_id % 50 = 0)) where rank <= 10""",
    "op_rt_vec_filter": f"""select query_id, doc_id, score, cast(rank as int) as rank from (select *, {_RANK} from (
  select q.vec_id as query_id, v.vec_id as doc_id, round({_DOT.format(a='q.embedding', b='v.embedding')}, 5) as score from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.label < 5)) where rank <= 5""",
    "op_fn_similarity": f"""select id, round(d / (sqrt(a) * sqrt(b)), 5) as cosine, round(d, 5) as dot, round(-sqrt(g), 5) as neg_euclidean from (
  select x.vec_id as id, {_DOT.format(a='x.embedding', b='y.embedding')} as d, {_DOT.format(a='x.embedding', b='x.embedding')} as a, {_DOT.format(a='y.embedding', b='y.embedding')} as b,
         list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) ** 2)) as g
  from embeddings x join embeddings y on y.vec_id = x.vec_id + 1)""",
    "op_ag_embed_stats": f"""select count(*) as n_vectors, cast(max(len(embedding)) as int) as dim, round(avg(n), 5) as mean_norm, round(stddev_pop(n), 5) as std_norm, round(min(n), 5) as min_norm, round(max(n), 5) as max_norm
  from (select embedding, sqrt({_DOT.format(a='embedding', b='embedding')}) as n from embeddings)""",
    "op_snk_bm25_index": _BM25 + "select token, count(*) as df, cast(sum(tf) as bigint) as occurrences from p group by token",
    "op_rt_embed": _BM25 + "select doc_id, place, round(v, 5) as value from h where v <> 0",
    "op_rt_vec_text": _BM25 + "select query_id, doc_id, score, cast(rank as int) as rank from vec where rank <= 10",
    "op_rt_graph_search": _BM25 + "select query_id, doc_id, score, cast(rank as int) as rank from gr",
    "op_rt_rrf": _BM25 + f"select query_id, doc_id, score, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) as score from (select query_id, doc_id, rank from bm union all select query_id, doc_id, rank from vec) group by all)",
    "op_rt_rrf3": _BM25
    + f"""select query_id, doc_id, score, sources, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(sum(w / (60 + rank)), 8) as score, string_agg(distinct src, '+' order by src) as sources from (
  select query_id, doc_id, rank, 0.3::double as w, 'bm25' as src from bm union all select query_id, doc_id, rank, 0.36::double, 'graph' from gr union all select query_id, doc_id, rank, 0.4::double, 'vector' from vec) group by query_id, doc_id)""",
    "op_rt_wfuse2": _BM25
    + f"""select query_id, doc_id, score, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(0.5 * {_scaled('b')} + 0.5 * {_scaled('v')}, 6) as score
  from (select coalesce(bm.query_id, vec.query_id) as query_id, coalesce(bm.doc_id, vec.doc_id) as doc_id, coalesce(bm.score, 0)::double as b, coalesce(vec.score, 0)::double as v from bm full join vec on bm.query_id = vec.query_id and bm.doc_id = vec.doc_id)
  window w as (partition by query_id))""",
    "op_rt_wfuse3": _BM25
    + f"""select query_id, doc_id, score, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(sum(s), 6) as score from (
  select query_id, doc_id, 0.3::double * {_scaled('score')} as s from bm window w as (partition by query_id)
  union all select query_id, doc_id, 0.4::double * {_scaled('score')} from vec window w as (partition by query_id)
  union all select query_id, doc_id, 0.3::double * ({_scaled('score')} + 0.1) from gr window w as (partition by query_id)) group by all)""",
    "op_rt_fuse_scores": _BM25
    + f"""select query_id, doc_id, score, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(0.3 * {_scaled('b')} + 0.3 * {_scaled('v')} + 0.4 * {_scaled('r')}, 6) as score
  from (select query_id, doc_id, coalesce(bm.score, 0)::double as b, coalesce(vec.score, 0)::double as v, coalesce(rr.score, 0)::double as r from bm full join vec using (query_id, doc_id) left join rr using (query_id, doc_id))
  window w as (partition by query_id))""",
    "op_rt_graph_enh": _BM25
    + f"""select query_id, doc_id, score, rank, coalesce((select string_agg(token, ',' order by token) from (select x.token from codes x join codes q using (token) where x.doc_id = f.doc_id and q.doc_id = f.query_id order by token limit 5)), '') as context
  from (select query_id, doc_id, score, cast({_RANK[:-8]} as int) as rank from (select query_id, doc_id, round(sum(w / (60 + rank)), 8) as score from (
    select query_id, doc_id, rank, 0.3::double as w from bm union all select query_id, doc_id, rank, 0.36::double from gr union all select query_id, doc_id, rank, 0.4::double from vec) group by query_id, doc_id)) f where rank <= 10""",
    "op_wn_pack": _BM25 + "select query_id, doc_id, cast(rank as int) as rank, cast(used_chars as bigint) as used_chars from (select bm.*, sum(length(text)) over (partition by query_id order by rank rows unbounded preceding) as used_chars from bm join documents using (doc_id)) where used_chars <= 3000",
    "op_rt_vec_hier": _BM25
    + f""", k as (select * from (select va.*, tier, row_number() over (partition by query_id, tier order by score desc, doc_id) as r from va join (select doc_id, case when doc_type = 'standard' then 0 when doc_type = 'contract' then 2 else 1 end as tier from documents) using (doc_id)) where r <= 5)
select query_id, doc_id, tier, score, cast(rank as int) as rank from (select *, {_RANK} from (select k.*, (select count(*) from k o where o.query_id = k.query_id and o.tier < k.tier) as before from k) where before < 5) where rank <= 5""",
    "op_rt_rerank": _BM25 + "select query_id, doc_id, score as rerank_score, cast(new_rank as int) as new_rank from (select *, row_number() over (partition by query_id order by score desc, rank, doc_id) as new_rank from rr) where new_rank <= 5",
    "op_rt_hybrid": _BM25
    + f""", f as (select * from (select query_id, doc_id, {_RANK} from (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) as score from (select query_id, doc_id, rank from bm union all select query_id, doc_id, rank from vec) group by all)) where rank <= 15),
r as (select f.query_id, f.doc_id, round(count(p.token) / any_value(n), 6) as rerank_score, any_value(f.rank) as rank from f join (select doc_id, token, count(*) over (partition by doc_id) as n from qt) q on q.doc_id = f.query_id left join p on p.doc_id = f.doc_id and p.token = q.token group by f.query_id, f.doc_id)
select query_id, doc_id, rerank_score, cast(new_rank as int) as new_rank from (select *, row_number() over (partition by query_id order by rerank_score desc, rank, doc_id) as new_rank from r) where new_rank <= 5""",
}
