"""Queries over the texts of documents: fingerprints, statistics, cleaning, chunks, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators import chunks, dedup, retrieval
from sitequarry.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def _select(columns):
    """A query of doc_id and the columns made of the text column."""
    return lambda spark, d: docs(spark, d).select("doc_id", *columns(F.col("text")))


QUERIES = {
    "op_fn_hash": _select(lambda t: [F.md5(t).alias("md5_hex"), F.sha2(t, 256).alias("sha256_hex"), F.base64(F.encode(F.substring(t, 1, 15), "UTF-8")).alias("b64"), F.concat(F.lit("query:result:"), F.md5(t)).alias("cache_key")]),
    "op_fn_fingerprint": _select(lambda t: [T.fingerprint(t).alias("fp"), T.fingerprint(F.substring(t, 1, 1000)).alias("doc_fp"), F.md5(F.substring(t, 1, 1000)).alias("meta_fp")]),
    "op_fn_chunk_fp": lambda spark, d: table(spark, d, "document_chunks").select("id", T.chunk_fingerprint(F.col("document_id"), F.col("chunk_index"), F.col("text")).alias("fp")),
    "op_fn_token_count": _select(lambda t: [T.token_count(t).alias("tokens")]),
    "op_fn_text_stats": _select(lambda t: [
        F.length(t).alias("char_count"), F.size(T.pieces(t, "\n")).alias("line_count"), F.size(T.pieces(t, "\n\n")).alias("paragraph_count"),
        (T.count_matches(t, f"[{T.HAN}]") + T.count_matches(t, r"\b[a-zA-Z]+\b")).alias("word_count"), T.language(t).alias("language"),
    ]),
    "op_fn_dates": _select(lambda t: [T.dates(t).alias("dates"), F.array_max(T.dates(t)).alias("last_date")]),
    "op_fn_doc_number": _select(lambda t: [T.doc_number(t).alias("doc_number")]),
    "op_fn_title": _select(lambda t: [T.title(t).alias("title")]),
    "op_fn_classify": _select(lambda t: [T.classify(t, T.DOC_TYPES, "other").alias("doc_class"), T.classify(t, T.DOMAINS, "general").alias("domain")]),
    "op_fn_tokenize": lambda spark, d: retrieval.postings(docs(spark, d)).withColumn("tf", F.col("tf").cast("long")),
    "op_fn_file_names": _select(lambda t: [T.safe_filename(F.col("name")).alias("safe_name"), T.format_size(F.octet_length(t).cast("long")).alias("size_text")]),
    "op_prd_regexes": _select(lambda t: [t.rlike(T.STANDARD_CODE).alias("has_standard"), t.rlike(T.PROJECT_CODE).alias("has_project_code"), F.col("name").rlike(T.EMAIL).alias("name_is_email"), F.regexp_count(t, F.lit(r"C\d{2}")).alias("n_grades")]),
    "op_cl_encoding": _select(lambda t: [T.fix_encoding(t).alias("cleaned")]),
    "op_cl_ctrl_punct": _select(lambda t: [T.squeeze_punctuation(T.drop_controls(t)).alias("cleaned")]),
    "op_cl_header": _select(lambda t: [T.drop_page_lines(t).alias("cleaned")]),
    "op_cl_dedup_para": _select(lambda t: [T.dedup_paragraphs(t).alias("cleaned")]),
    "op_cl_clean": lambda spark, d: T.cleaned(docs(spark, d).select("doc_id", "text")).withColumnRenamed("text", "cleaned"),
    "op_ch_fixed": lambda spark, d: chunks.fixed(docs(spark, d)),
    "op_ch_sliding": lambda spark, d: chunks.fixed(docs(spark, d), 300, 100, whole_steps_only=True),
    "op_cl_linebreak": _select(lambda t: [T.merge_lines(t).alias("cleaned")]),
    "op_ch_recursive": lambda spark, d: chunks.recursive(docs(spark, d)),
    "op_ch_semantic": lambda spark, d: chunks.semantic(docs(spark, d)),
    "op_ch_sentences": lambda spark, d: chunks.sentences(docs(spark, d)),
    "op_wn_dedup_first": lambda spark, d: dedup.keep_first(docs(spark, d), T.fingerprint(F.col("text")), "doc_id").select("doc_id", "key"),
    "op_snk_dedup_store": lambda spark, d: dedup.against_store(docs(spark, d).where("doc_id % 2 = 1"), docs(spark, d).where("doc_id % 2 = 0"), T.fingerprint(F.col("text"))).select("doc_id", "is_known"),
    "op_fn_simhash": lambda spark, d: dedup.simhash(docs(spark, d)),
    "op_fn_neardup": lambda spark, d: dedup.simhash_classes(dedup.simhash(docs(spark, d))),
    "op_fn_neardup_pairs": lambda spark, d: dedup.simhash_pairs(dedup.simhash(docs(spark, d))),
}

_TERMS = lambda classes: {k: " + ".join(f"((length(l) - length(replace(l, '{w.lower()}', ''))) // {len(w)})" for w in ws) for k, ws in classes.items()}


def _classify(classes, none, name):
    terms = _TERMS(classes)
    best = f"greatest({', '.join(terms.values())})"
    return f"case when {best} = 0 then '{none}' " + " ".join(f"when {v} = {best} then '{k}'" for k, v in terms.items()) + f" end as {name}"


_RE2_SPACE = r"[ \t\n\f\r\x{0b}]"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FP = rf"substr(md5(lower(regexp_replace(text, '{_RE2_SPACE}+', '', 'g'))), 1, 16)"
_HEADER = r"""array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: not (regexp_matches(x, '^\s*[-–—]\s*\d+\s*[-–—]\s*$')
   or (length(x) < 50 and regexp_matches(x, '(?i)(第\s*\d+\s*页|Page\s+\d+|共\s*\d+\s*页|\d+\s*/\s*\d+)')))), chr(10))"""
_SQUEEZE = "text"
for _c in "。！？，、；：":
    _SQUEEZE = f"regexp_replace({_SQUEEZE}, '{_c}{_c}+', '{_c}', 'g')"

_VOTES = lambda at: "[" + ", ".join(f"sum(case when (x{at} >> {i}) & 1 = 1 then n else -n end) > 0" for i in range(64)) + "]"
_LONG = lambda bits: f"cast(case when {bits}[64] then -9223372036854775808 else 0 end + list_sum(list_transform(range(1, 64), lambda i: case when {bits}[i] then cast(1 as hugeint) << (i - 1) else 0 end)) as bigint)"
_SIMHASH = rf"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) as w from documents where text is not null),
c as (select doc_id, n, ('0x' || substr(md5(w), 1, 16))::ubigint as x1, ('0x' || substr(md5(w), 17, 16))::ubigint as x2 from (select doc_id, w, count(*) as n from w group by all)),
v as (select doc_id, {_VOTES(1)} as b1, {_VOTES(2)} as b2 from c group by doc_id), h as (select doc_id, {_LONG('b1')} as hi, {_LONG('b2')} as lo from v)
"""

SQL = {
    "op_fn_hash": "select doc_id, md5(text) as md5_hex, sha256(text) as sha256_hex, base64(encode(substr(text, 1, 15))) as b64, 'query:result:' || md5(text) as cache_key from documents",
    "op_fn_fingerprint": f"select doc_id, {_FP} as fp, {_FP.replace('(text', '(substr(text, 1, 1000)')} as doc_fp, md5(substr(text, 1, 1000)) as meta_fp from documents",
    "op_fn_chunk_fp": "select id, md5(concat_ws(':', document_id, chunk_index, substr(text, 1, 200))) as fp from document_chunks",
    "op_fn_token_count": r"select doc_id, cast(coalesce(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + floor(len(regexp_extract_all(text, '[a-zA-Z]+')) * 1.3), 0) as bigint) as tokens from documents",
    "op_fn_text_stats": r"""select doc_id, length(text) as char_count, cast(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as int) as line_count,
       cast(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) as int) as paragraph_count, cast(h + e as int) as word_count,
       case when h > e * 5 then 'chinese' when e > h then 'english' else 'mixed' end as language
  from (select *, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) as h, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) as e from documents)""",
    "op_fn_dates": r"""select doc_id, dates, list_max(dates) as last_date from (
  select doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '\d{4}年\d{1,2}月\d{1,2}日'), regexp_extract_all(text, '\d{4}-\d{1,2}-\d{1,2}'), regexp_extract_all(text, '\d{4}/\d{1,2}/\d{1,2}')))) as dates from documents)""",
    "op_fn_doc_number": r"""select doc_id, coalesce(nullif(regexp_extract(h, 'GB\s*\d+[-–]\d{4}'), ''), nullif(regexp_extract(h, 'JGJ\s*\d+[-–]\d{4}'), ''), nullif(regexp_extract(h, '\[\d{4}\]\d+号'), ''), nullif(regexp_extract(h, 'No\.\s*\d+'), '')) as doc_number
  from (select doc_id, substr(text, 1, 1000) as h from documents)""",
    "op_fn_title": "select doc_id, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: trim(replace(x, chr(13), ''), ' ')), lambda x: length(x) > 5 and length(x) < 100 and length(x) - length(replace(x, '。', '')) < 2)[1] as title from documents",
    "op_fn_classify": f"select doc_id, {_classify(T.DOC_TYPES, 'other', 'doc_class')}, {_classify(T.DOMAINS, 'general', 'domain')} from (select doc_id, lower(text) as l from documents)",
    "op_fn_tokenize": rf"""with d as (select doc_id, regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\S+@\S+', '', 'g') as x from documents where text is not null),
c as (select doc_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) as token from d
      union all select doc_id, substr(x, i, 2) from (select doc_id, x, unnest(range(1, length(x))) as i from d) where regexp_matches(substr(x, i, 2), '^[\x{{4e00}}-\x{{9fff}}]{{2}}$'))
select doc_id, token, count(*) as tf from c where token not in ({_STOP}) and (length(token) > 1 or regexp_matches(token, '[a-z]')) group by all""",
    "op_fn_file_names": r"""select doc_id, regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') as safe_name,
       case when b < 1024 then printf('%.2f B', cast(b as double)) when b < 1048576 then printf('%.2f KB', floor(b / 1024.0 * 100) / 100) else printf('%.2f MB', floor(b / 1048576.0 * 100) / 100) end as size_text
  from (select doc_id, name, octet_length(encode(text)) as b from documents)""",
    "op_prd_regexes": r"""select doc_id, regexp_matches(text, '[A-Z]{2,4}[\s\-]?\d{4,6}[\-\s]?\d{4}') as has_standard, regexp_matches(text, '[A-Z]{2}\d{6}') as has_project_code,
       regexp_matches(name, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$') as name_is_email, cast(len(regexp_extract_all(text, 'C\d{2}')) as int) as n_grades from documents""",
    "op_cl_encoding": r"select doc_id, regexp_replace(translate(text, '　（）【】《》', ' ()[]<>'), '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g') as cleaned from documents",
    "op_cl_ctrl_punct": f"select doc_id, {_SQUEEZE} as cleaned from (select doc_id, regexp_replace(text, '[\\x{{00}}-\\x{{08}}\\x{{0b}}-\\x{{1f}}]', '', 'g') as text from documents)",
    "op_cl_header": f"select doc_id, {_HEADER} as cleaned from documents",
    "op_cl_dedup_para": """with p as (select doc_id, i, trim(ps[i], ' ') as p from (select doc_id, string_split(text, chr(10) || chr(10)) as ps, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) as i from documents where text is not null)),
k as (select *, row_number() over (partition by doc_id, substr(p, 1, 100) order by i) as rn from p where p <> '')
select d.doc_id, case when d.text is not null then coalesce(string_agg(p, chr(10) || chr(10) order by i), '') end as cleaned from documents d left join (select * from k where rn = 1) k on k.doc_id = d.doc_id group by d.doc_id, d.text""",
    "op_ch_fixed": """select doc_id, cast(s // 450 as int) as chunk_index, total_chunks, s as start_char, least(s + 500, length(text)) as end_char, substr(text, s + 1, 500) as content
  from (select doc_id, text, cast(len(range(0, length(text), 450)) as int) as total_chunks, cast(unnest(range(0, length(text), 450)) as int) as s from documents where length(text) > 0)""",
    "op_ch_sliding": """select doc_id, cast(s // 200 as int) as chunk_index, total_chunks, s as start_char, least(s + 300, length(text)) as end_char, substr(text, s + 1, 300) as content
  from (select doc_id, text, cast(len(range(0, greatest(length(text) - 200, 0) + 1, 200)) as int) as total_chunks, cast(unnest(range(0, greatest(length(text) - 200, 0) + 1, 200)) as int) as s from documents where length(text) > 0)""",
    "op_wn_dedup_first": f"select doc_id, key from (select doc_id, {_FP} as key, row_number() over (partition by {_FP} order by doc_id) as rn from documents) where rn = 1 and key is not null",
    "op_snk_dedup_store": f"with k as (select doc_id, {_FP} as key from documents) select doc_id, key is not null and key in (select key from k where doc_id % 2 = 0 and key is not null) as is_known from k where doc_id % 2 = 1",
    "op_fn_simhash": _SIMHASH + "select doc_id, hi, lo from h",
    "op_fn_neardup": _SIMHASH + """, k as (select hi, lo, min(doc_id) as class_id, count(*) as copies from h group by all),
l as (select a.class_id, count(*) as links from k a join k b on a.class_id <> b.class_id and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12 group by 1)
select doc_id, class_id, copies, coalesce(links, 0) as links from h join k using (hi, lo) left join l using (class_id)""",
    "op_fn_neardup_pairs": _SIMHASH + """, k as (select hi, lo, min(doc_id) as doc_id from h group by all)
select a.doc_id as a, b.doc_id as b, cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as int) as distance from k a join k b on a.doc_id < b.doc_id where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12""",
}
