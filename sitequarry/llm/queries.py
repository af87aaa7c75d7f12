"""Queries over texts, with their SQL twins where SQL can express them."""

from __future__ import annotations

from sitequarry.llm import encode, forms, leaks, neardup, scans, truncation
from sitequarry.sources.tables import table


def _forms(f):
    return lambda spark, d: f(table(spark, d, "document_chunks"), table(spark, d, "drawing_entities"))


def _scans(f):
    return lambda spark, d: f(scans.sources(table(spark, d, "document_chunks"), table(spark, d, "extracted_elements")))


QUERIES = {
    "p3_found": _scans(scans.found),
    "p3_repaired": _scans(scans.repaired),
    "p4_found": _forms(forms.found),
    "p4_forms": _forms(lambda chunks, entities: forms.consistent(forms.sources(chunks, entities)).select("src_table", "row_id", "form")),
    "p5_found": lambda spark, d: neardup.found(table(spark, d, "document_chunks")),
    "p5_groups": lambda spark, d: neardup.groups(table(spark, d, "document_chunks")),
    "p6_ids": lambda spark, d: encode.encode(table(spark, d, "documents")),
    "p6_tokens_by_source": lambda spark, d: encode.tokens_by_source(table(spark, d, "documents")),
    "p7_found": lambda spark, d: leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p7_leaks_by_item": lambda spark, d: leaks.leaks_by_item(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p7_cleaned": lambda spark, d: leaks.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_found": lambda spark, d: truncation.found(table(spark, d, "documents")),
    "p8_by_source": lambda spark, d: truncation.by_source(table(spark, d, "documents")),
    "p8_limits": lambda spark, d: truncation.spikes(table(spark, d, "documents")),
}


SQL = {
    # by script and general category of the database, without the classes of the operator
    "p4_found": r"""
with t as (select 'document_chunks' as src_table, id as row_id, text as x, false as code from document_chunks union all select 'drawing_entities', id, code, true from drawing_entities),
w as (select src_table, row_id, unnest(regexp_extract_all(x, '[\p{L}\p{M}\p{Cf}\p{Nd}-]+')) as w from t where not code and regexp_matches(x, '[\p{Cyrillic}\p{Greek}]')),
m as (select distinct src_table, row_id from w where regexp_matches(w, '\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{Nd}-]*\p{Latin}|\p{Latin}[\p{Nd}\p{Cf}\p{M}-]*[\p{Cyrillic}\p{Greek}]') and regexp_matches(regexp_replace(w, '[ΦφϕΩΔΣπµμθλσεδβ]', '', 'g'), '[\p{Cyrillic}\p{Greek}]')
  or regexp_matches(w, '^[АВЕКМНОРСТУХЅІЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]{1,3}-?\d'))
select src_table, row_id from t where case when code
    then regexp_matches(replace(x, ' ', ''), '[\p{Cyrillic}\p{M}\p{Cf}\p{Co}]|[\x{ff01}-\x{ff5e}\x{ffe0}-\x{ffe6}]|[\p{Zs}\x{2010}\x{2011}\x{fe63}\x{fb00}-\x{fb06}\x{2e80}-\x{2fd5}]') or regexp_matches(regexp_replace(x, '[ΦφϕΩΔΣπµμθλσεδβ]', '', 'g'), '\p{Greek}')
    else regexp_matches(x, '[\p{Mn}\p{Me}\p{Cf}]|[\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{ff0d}]|[\x{2010}\x{2011}\x{fe63}\x{fb00}-\x{fb06}\x{2e80}-\x{2fd5}]') or regexp_matches(replace(x, ' ', ''), '\p{Zs}') end
union select src_table, row_id from m""",
    # an inverted list of all sequences, and every pair that shares one
    "p5_found": r"""
with n as (select id, trim(regexp_replace(lower(text), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') as t from document_chunks where text is not null),
g as (select distinct id, substr(t, i, 5) as g from (select id, t, unnest(range(1, length(t) - 3)) as i from n where length(t) >= 40)),
s as (select id, count(*) as n from g group by id),
p as (select x.id as a, y.id as b, count(*) as k from g x join g y on x.g = y.g and x.id < y.id group by all)
select a as id_a, b as id_b from p join s x on x.id = a join s y on y.id = b where 2 * k >= x.n + y.n - k""",
    # windows of twelve words, and of twenty characters for Chinese passages
    "p7_found": r"""
with i as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}\p{M}]+') as w, regexp_matches(passage, '\p{Han}') as zh from eval_items where passage is not null),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') as w from documents where text is not null),
iw as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as x from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where not zh)),
dw as (select distinct doc_id, array_to_string(w[k : k + 11], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ic as (select distinct item_id, substr(c, k, 20) as x from (select item_id, c, unnest(range(1, length(c) - 18)) as k from (select item_id, array_to_string(w, '') as c from i where zh))),
dc as (select distinct doc_id, substr(c, k, 20) as x from (select doc_id, c, unnest(range(1, length(c) - 18)) as k from (select doc_id, array_to_string(w, '') as c from d)))
select doc_id, item_id from dw join iw using (x) union select doc_id, item_id from dc join ic using (x)""",
    "p8_limits": """
with x as (select source, 'chars' as measure, 1 as width, length(text) as size from documents where length(text) > 0
  union all select source, 'bytes', 4, octet_length(encode(text)) from documents where length(text) > 0),
h as (select source, measure, width, size, max(size) over (partition by source, measure) as top from x),
g as (select 'text' as "column", source, measure, top - width + 1 as low, top, width, count(*) filter (size > top - width) as n_at, count(*) filter (size <= top - width and size > top - width - top // 4) as under from h group by all)
select "column", source, measure, low, top from g where n_at >= 5 and n_at >= 6 * width * greatest(under / (top // 4), 0.02)""",
}
SQL["p7_leaks_by_item"] = f"select item_id, suite, count(distinct doc_id) as n_docs from ({SQL['p7_found']}) join eval_items using (item_id) group by all"
