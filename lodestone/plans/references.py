"""Registered queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.orphans import orphan_references, orphan_report
from lodestone.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    orphans = orphan_references(table(spark, folder, "manifest_docs"), table(spark, folder, "crosslink_stats"))
    return orphans.select("ref_table", "period", "ref_field", "ref_key", "target_key")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    orphans = orphan_references(table(spark, folder, "manifest_docs"), table(spark, folder, "crosslink_stats"))
    return orphan_report(orphans).select("ref_table", "period", "ref_field", "reason", F.col("references").alias("n_references"), F.col("records").alias("n_records"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_NAMED = r"lower(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\', '/'))"

_ORPHANS = f"""
with refs as (
  select distinct 'manifest_docs' as ref_table, f as ref_field, id as ref_key, target_key, indexed_at as at,
         case when f = 'related_contracts' then 'external_id' else 'id' end as space, {_NAMED.format("target_key")} as k
  from (
    select id, indexed_at, 'code_anchors' as f, unnest(code_anchors) as target_key from manifest_docs
    union all select id, indexed_at, 'related_doc_ids', unnest(related_doc_ids) from manifest_docs
    union all select id, indexed_at, 'related_contracts', unnest(related_contracts) from manifest_docs)
  where {_NAMED.format("target_key")} <> ''
  union
  select 'crosslink_stats', 'unresolved_symbols', build_id, target_key, built_at, 'symbol',
         {_NAMED.format("regexp_replace(target_key, '^[^:]*:', '')")}
  from (select build_id, built_at, unnest(unresolved_symbols) as target_key from crosslink_stats)
  where {_NAMED.format("target_key")} <> ''
), named as (
  select 'id' as space, {_NAMED.format("id")} as k, indexed_at, removed_at from manifest_docs
  union all select 'external_id', {_NAMED.format("external_id")}, indexed_at, removed_at from manifest_docs
  union all select 'symbol', {_NAMED.format("symbol")}, indexed_at, removed_at from manifest_docs
  union all select 'symbol', regexp_replace({_NAMED.format("symbol")}, 'impl$', ''), indexed_at, removed_at from manifest_docs
    where {_NAMED.format("symbol")} like '%impl'
), judged as (
  select r.ref_table, strftime(r.at, '%Y-%m') as period, r.ref_field, r.ref_key, r.target_key,
         count(n.k) as ever, count(n.k) filter (n.indexed_at <= r.at) as begun,
         count(n.k) filter (n.indexed_at <= r.at and (n.removed_at is null or n.removed_at > r.at)) as alive
  from refs r left join named n on r.space = n.space and r.k = n.k and n.indexed_at is not null
  where r.at is not null
  group by r.ref_table, r.at, r.ref_field, r.ref_key, r.target_key
)
"""

ORACLE = {
    "p2_found": _ORPHANS + "select distinct ref_table, period, ref_field, ref_key, target_key from judged where alive = 0",
    "p2_report": _ORPHANS + """
select ref_table, period, ref_field, reason, count(*) as n_references, count(distinct ref_key) as n_records
from (select distinct ref_table, period, ref_field, ref_key, target_key,
             case when ever = 0 then 'missing' when begun > 0 then 'deleted' else 'late' end as reason
      from judged where alive = 0)
group by ref_table, period, ref_field, reason""",
}
