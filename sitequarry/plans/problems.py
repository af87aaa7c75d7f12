"""Queries of the general data-quality operators, with their SQL twins."""

from __future__ import annotations

from sitequarry.operators import intervals, references
from sitequarry.sources.tables import table


def _refs(f):
    return lambda spark, d: f(table(spark, d, "drawing_relations"), table(spark, d, "drawing_entities"), table(spark, d, "construction_drawings"))


QUERIES = {
    "p1_found": _refs(references.orphans),
    "p1_orphans_by_month": _refs(references.orphans_by_month),
    "p2_found": lambda spark, d: intervals.task_periods(table(spark, d, "task_schedule")),
    "p2_coverage": lambda spark, d: intervals.coverage(table(spark, d, "task_schedule")),
}

_STATES = r"""
with parents as (
  select kind, key, min(born) as live_from from (
    select 'entity' as kind, nullif(upper(regexp_replace(entity_id, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), '') as key,
           case when deleted_at is null then coalesce(created_at, timestamp '0001-01-01') end as born from drawing_entities
    union all select 'drawing', cast(id as varchar), case when deleted_at is null then coalesce(created_at, timestamp '0001-01-01') end from construction_drawings)
  where key is not null group by kind, key),
refs as (
  select id as relation_row_id, created_at as ref_at, 'from_entity_id' as ref_field, 'entity' as kind, nullif(upper(regexp_replace(from_entity_id, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), '') as key from drawing_relations
  union all select id, created_at, 'to_entity_id', 'entity', nullif(upper(regexp_replace(to_entity_id, '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), '') from drawing_relations
  union all select id, created_at, 'drawing_id', 'drawing', cast(drawing_id as varchar) from drawing_relations),
states as (
  select relation_row_id, ref_field, ref_at,
         case when p.key is null then 'missing' when live_from is null then 'deleted' when live_from > ref_at then 'late' else 'ok' end as ref_state
  from refs r left join parents p on p.kind = r.kind and p.key = r.key where r.key is not null)
"""

_RUNS = """
with i as (
  select work_package, 'planned' as track, planned_start as a, planned_end as b from task_schedule
  union all select work_package, 'actual', actual_start, actual_end from task_schedule),
o as (select *, max(b) over (partition by work_package, track order by a, b rows between unbounded preceding and 1 preceding) as seen
      from i where work_package is not null and a is not null and b is not null and a <= b),
n as (select *, sum(case when seen is null or a > seen + 1 then 1 else 0 end) over (partition by work_package, track order by a, b rows unbounded preceding) as run from o),
r as (select work_package, track, run, min(a) as a, max(b) as b from n group by all),
g as (select *, lag(b) over (partition by work_package, track order by a) as before from r),
x as (select work_package, track, 'period' as kind, a, b from g
      union all select work_package, track, 'gap', before + 1, a - 1 from g where before is not null)
"""

SQL = {
    "p1_found": _STATES + "select relation_row_id, ref_field, ref_state from states where ref_state <> 'ok'",
    "p1_orphans_by_month": _STATES + "select ref_field, coalesce(strftime(ref_at, '%Y-%m'), '') as month, ref_state, count(*) as n_refs from states group by all",
    "p2_found": _RUNS + "select work_package, track, kind, strftime(a, '%Y-%m-%d') as first_day, strftime(b, '%Y-%m-%d') as last_day from x",
    "p2_coverage": _RUNS
    + """select work_package, track, count(*) filter (kind = 'period') as n_periods, count(*) filter (kind = 'gap') as n_gaps,
       cast(coalesce(sum(b - a + 1) filter (kind = 'period'), 0) as bigint) as days_covered, cast(coalesce(sum(b - a + 1) filter (kind = 'gap'), 0) as bigint) as days_open
  from x group by all""",
}
