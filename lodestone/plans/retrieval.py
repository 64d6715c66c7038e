"""Registered queries on chunks, budgets, anchors of records and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.plans.search import _hits, _scored_sql, docs_of
from lodestone.storage import materialize
from lodestone.tables import table
from lodestone.vocab import ANCHOR_PRIORITY, sql_lookup


def _top(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    return materialize(_hits(spark, folder, limit=limit), "hits")


def chunk_best(spark: SparkSession, folder: str) -> DataFrame:
    return R.best_chunks(_top(spark, folder), table(spark, folder, "chunks"))


def fetch_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.fetched(_top(spark, folder, limit=3), table(spark, folder, "manifest_docs"), table(spark, folder, "chunks"))
    return rows.select("query", "hit_rank", "part", "chunk_id", F.length("shown").cast("bigint").alias("chars"), "was_cut", F.md5("shown").alias("digest"))


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.document_chunks(table(spark, folder, "chunks")).select("doc_id", "position", "chunk_id", F.length("shown").cast("bigint").alias("chars"), "was_cut", F.md5("shown").alias("digest"))


def doc_texts(spark: SparkSession, folder: str) -> DataFrame:
    return R.document_texts(table(spark, folder, "chunks")).select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "search_hits").select(F.explode("top_chunk_ids").alias("c")).where("c is not null").distinct()
    return R.parsed_chunk_ids(named, "c")


def snippet_docs(spark: SparkSession, folder: str) -> DataFrame:
    return R.snippets(table(spark, folder, "chunks"))


def anchors_related(spark: SparkSession, folder: str) -> DataFrame:
    return R.related_anchors(table(spark, folder, "manifest_docs"))


def gap_list(spark: SparkSession, folder: str) -> DataFrame:
    return R.gap_documents(docs_of(spark, folder))


def gap_prefix_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.gap_prefixes(docs_of(spark, folder))


def chunk_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.chunk_rows(table(spark, folder, "chunks"))
    return rows.select("chunk_id", X.content_hash(F.encode("text", "UTF-8")).alias("content_hash"), F.octet_length("text").cast("bigint").alias("n_bytes"))


QUERIES = {
    "chunk_best": chunk_best, "fetch_hits": fetch_hits, "doc_chunks": doc_chunks, "doc_texts": doc_texts, "chunk_ids": chunk_ids, "snippet_docs": snippet_docs,
    "anchors_related": anchors_related, "gap_list": gap_list, "gap_prefix_stats": gap_prefix_stats, "chunk_hashes": chunk_hashes,
}

_CHUNKS = "select distinct chunk_id, doc_id, title, heading, text, try_cast(regexp_extract(chunk_id, '#([^#]*)$', 1) as int) as number from chunks where chunk_id is not null"
_CUT = "case when length({t}) <= {n} then {t} else left({t}, greatest({n} - 3, 0)) || left('...', least({n}, 3)::int) end"

_ANCHORS = f"""
a0 as (select distinct id, symbol, anchor_type, code_anchors, related_anchors from manifest_docs),
a1 as (
  select id, list_filter(coalesce(code_anchors, []), lambda x: x is not null) as listed,
         list_distinct(list_filter(list_transform(list_filter(coalesce(related_anchors, []), lambda x: x is not null), lambda x: split_part(trim(x), '.', 1)),
           lambda x: regexp_full_match(x, '[A-Z][a-zA-Z0-9]+') and length(x) >= 3 and x <> upper(x) and not ends_with(x, 'Payload') and not ends_with(x, 'Dto') and not ends_with(x, 'DTO')
                  and x not in ('Authorization', 'Bearer'))) as w0
  from a0),
a2 as (select id, len(listed) as anchor_total, unnest(list_distinct(list_filter(listed, lambda x: x <> ''))) as anchor_id from a1),
wanted as (select id, symbol, min(pos) as pos, max(n) as n from (
    select id, unnest(list_transform(coalesce(related_anchors, []), lambda x: split_part(trim(x), '.', 1))) as symbol, unnest(range(1, len(coalesce(related_anchors, [])) + 1)) as pos, len(coalesce(related_anchors, [])) as n from a0) group by all),
a3 as (
  select a2.id, anchor_id, anchor_total, coalesce(t.symbol, '') as symbol, t.id is not null as there,
         case when p.pos is null or not list_contains(a1.w0, p.symbol) then 1000000 else p.pos end as pos, {sql_lookup(ANCHOR_PRIORITY, "coalesce(t.anchor_type, '')", 10)} as pr
  from a2 join a1 on a1.id = a2.id left join a0 t on t.id = a2.anchor_id left join wanted p on p.id = a2.id and p.symbol = t.symbol),
anchors as (
  select * from (select id, row_number() over (partition by id order by pos, pr desc, symbol desc, anchor_id) as anchor_rank, anchor_id, anchor_total, there from a3) where there)
"""

_BEST = f"""
top as (select * from ranked where hit_rank <= 10),
ck as ({_CHUNKS}),
best as (
  select query, id, hit_rank, chunk_id, heading, chunk_score, row_number() over (partition by query, id order by chunk_score desc, chunk_id) as chunk_rank
  from (select top.query, top.id, top.hit_rank, ck.chunk_id, ck.heading, len(list_filter(q.toks, lambda x: contains(lower(coalesce(ck.text, '')), x))) as chunk_score
        from top join q on q.query = top.query join ck on ck.doc_id = top.id))
"""

ORACLE = {
    "chunk_best": _scored_sql().rstrip() + "," + _BEST + "select query, id, chunk_rank, chunk_id, heading, chunk_score from best where chunk_rank <= 3",
    "fetch_hits": _scored_sql().rstrip() + "," + _BEST.rstrip() + "," + _ANCHORS + f"""
, parts as (
  select query, hit_rank, 0 as part, chunk_id from best where chunk_rank = 1 and hit_rank <= 3
  union all select top.query, hit_rank, anchor_rank, anchor_id || '#0' from top join anchors on anchors.id = top.id where hit_rank <= 3 and anchor_rank <= 2
), s as (
  select p.*, coalesce(ck.text, '') as t, coalesce(sum(least(length(coalesce(ck.text, '')), 4000)) over (partition by query order by hit_rank, part rows between unbounded preceding and 1 preceding), 0) as used
  from parts p join ck on ck.chunk_id = p.chunk_id
), l as (select *, cast(least(4000, 12000 - used) as bigint) as room from s where used < 12000
), o as (select *, {_CUT.format(t="t", n="room")} as shown from l)
select query, hit_rank, part, chunk_id, length(shown) as chars, length(t) > room as was_cut, md5(shown) as digest from o""",
    "doc_chunks": f"""
with ck as ({_CHUNKS}), n as (select *, coalesce(text, '') as t, row_number() over (partition by doc_id order by number nulls last, chunk_id) as position from ck
), s as (select *, coalesce(sum(length(t)) over (partition by doc_id order by position rows between unbounded preceding and 1 preceding), 0) as used from n where position <= 5
), l as (select *, cast(8000 - used as bigint) as room from s where used < 8000), o as (select *, {_CUT.format(t="t", n="room")} as shown from l)
select doc_id, position, chunk_id, length(shown) as chars, length(t) > room as was_cut, md5(shown) as digest from o""",
    "doc_texts": f"""
with ck as ({_CHUNKS}), s as (
  select *, coalesce(sum(length(text)) over (partition by doc_id order by number nulls last, chunk_id rows between unbounded preceding and 1 preceding), 0) as used from ck where text <> ''
), o as (select doc_id, string_agg(left(text, (8000 - used)::int), chr(10) order by used, chunk_id) as text from s where used < 8000 group by doc_id)
select doc_id, length(text) as chars, md5(text) as digest from o""",
    "chunk_ids": """
select c as chunk_id, case when regexp_matches(c, '(?s)^.*#[0-9]+$') then regexp_extract(c, '(?s)^(.*)#[0-9]+$', 1) else c end as doc_id, try_cast(regexp_extract(c, '#([0-9]+)$', 1) as int) as number
from (select distinct unnest(top_chunk_ids) as c from search_hits) where c is not null""",
    "snippet_docs": f"""
with f as (select doc_id, regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g') as t
           from (select *, row_number() over (partition by doc_id order by chunk_id) as r from ({_CHUNKS})) where r = 1)
select doc_id, case when length(t) > 200 then left(t, 197) || '...' else t end as snippet from f""",
    "anchors_related": "with " + _ANCHORS + "select id, anchor_rank, anchor_id, anchor_total from anchors where anchor_rank <= 12",
    "gap_list": """
select gap_id, count(*) as document_count, count(distinct repo) as repos
from (select id, repo, unnest(known_gap_ids) as gap_id from (select distinct id, repo, known_gap_ids from manifest_docs)) where gap_id is not null group by gap_id""",
    "gap_prefix_stats": """
select prefix, count(*) as occurrences, count(distinct gap_id) as gaps
from (select gap_id, case when regexp_matches(upper(gap_id), '^[A-Z]{2,5}-[A-Z0-9]+') then regexp_extract(upper(gap_id), '^([A-Z]{2,5}-[A-Z0-9]+)', 1) else upper(gap_id) end as prefix
      from (select id, unnest(known_gap_ids) as gap_id from (select distinct id, known_gap_ids from manifest_docs)) where gap_id is not null)
group by prefix""",
    "chunk_hashes": f"select chunk_id, 'sha256:' || sha256(text) as content_hash, strlen(text) as n_bytes from ({_CHUNKS})",
}
