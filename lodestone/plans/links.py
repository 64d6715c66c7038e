"""Registered queries on links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import links as L
from lodestone.plans.search import _scored_sql
from lodestone.storage import materialize
from lodestone.tables import table
from lodestone.vocab import ANCHOR_KEEP_RANK, ANCHOR_PRIORITY, ANCHOR_SOFT_CAP, STOPWORDS, sql_lookup


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_docs")


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(L.mentions(_manifest(spark, folder), table(spark, folder, "chunks")), "mentions")


def crosslink_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return L.crosslinks(_mentions(spark, folder), _manifest(spark, folder))


def crosslink_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    return L.unresolved(_mentions(spark, folder), _manifest(spark, folder))


def crosslink_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return L.crosslink_statistics(_mentions(spark, folder), _manifest(spark, folder))


def crosslink_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return L.linked_documents(crosslink_tiers(spark, folder))


def anchor_repo_cap(spark: SparkSession, folder: str) -> DataFrame:
    return L.capped_anchors(_manifest(spark, folder))


def anchors_softcap(spark: SparkSession, folder: str) -> DataFrame:
    return L.softly_capped(_manifest(spark, folder))


def related_two_hop(spark: SparkSession, folder: str) -> DataFrame:
    return L.related_records(_manifest(spark, folder))


def related_tests(spark: SparkSession, folder: str) -> DataFrame:
    return L.tests_of_symbols(_manifest(spark, folder), table(spark, folder, "chunks"))


def query_tests(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "search_hits").where("hit_id % 50 = 0").select("query")
    return L.tests_of_queries(asked, _manifest(spark, folder), table(spark, folder, "chunks"))


def impact_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Tests of the queries as an impact analysis takes them: a query that is a symbol asks for its stems, tokens alone need six points."""
    asked = table(spark, folder, "search_hits").where("hit_id % 50 = 0").select("query")
    primary = asked.distinct().select("query", F.trim("query").alias("symbol")).where(F.col("symbol").rlike(X.PASCAL))
    return L.tests_of_queries(asked, _manifest(spark, folder), table(spark, folder, "chunks"), primary=primary, require_primary=True, least_tokens=6)


def tested_by(spark: SparkSession, folder: str) -> DataFrame:
    return L.tested_by(_manifest(spark, folder))


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The change set: paths of hits that were found stale, without leading dots and slashes."""
    return table(spark, folder, "search_hits").where("stale").select(X.plain_path(F.col("path")).alias("path")).distinct()


def diff_records(spark: SparkSession, folder: str) -> DataFrame:
    return L.records_at_paths(changed_files(spark, folder), _manifest(spark, folder))


def diff_linked(spark: SparkSession, folder: str) -> DataFrame:
    return L.records_linked_to(materialize(diff_records(spark, folder), "touched"), _manifest(spark, folder))


QUERIES = {
    "crosslink_tiers": crosslink_tiers, "crosslink_unresolved": crosslink_unresolved, "crosslink_statistics": crosslink_statistics, "crosslink_reverse": crosslink_reverse,
    "anchor_repo_cap": anchor_repo_cap, "anchors_softcap": anchors_softcap, "related_two_hop": related_two_hop, "related_tests": related_tests, "query_tests": query_tests, "impact_tests": impact_tests, "tested_by": tested_by,
    "diff_records": diff_records, "diff_linked": diff_linked,
}

_LINKABLE = "regexp_full_match({0}, '[A-Z][a-zA-Z0-9]+') and length({0}) >= 3 and {0} <> upper({0}) and not regexp_matches({0}, '(Payload|Dto|DTO)$') and {0} not in ('Authorization', 'Bearer')"
_MENTIONS = f"""
docs as (select distinct id, repo, related_anchors from manifest_docs where kind in ({", ".join(repr(k) for k in L.LINKING_KINDS)})),
mentions as (
  select distinct id, repo, symbol from (
    select id, repo, unnest(list_transform(list_filter(coalesce(related_anchors, []), lambda x: x is not null), lambda x: split_part(trim(x), '.', 1))) as symbol from docs
    union all
    select d.id, d.repo, c.symbol from docs d join (
      select doc_id, unnest(regexp_extract_all(text, '`([A-Z][A-Za-z0-9]{{2,}})`', 1) || regexp_extract_all(text, '{X.PROSE_SYMBOL}', 1)) as symbol from chunks) c on c.doc_id = d.id)
  where {_LINKABLE.format("symbol")}),
anchors as (select distinct id as anchor_id, repo as a_repo, symbol as a_symbol from manifest_docs where kind = 'code_anchor' and symbol <> '' and repo <> ''),
pairs as (
  select m.*, anchor_id, case when repo = a_repo and symbol = a_symbol then 1 when repo = a_repo then 2 else 3 end as tier
  from mentions m join anchors a on a.a_symbol = m.symbol or (ends_with(m.symbol, 'Service') and a.a_symbol = m.symbol || 'Impl')),
linked as (select * from pairs qualify tier = min(tier) over (partition by id, symbol)),
missing as (select m.* from mentions m anti join pairs p on p.id = m.id and p.symbol = m.symbol)
"""
_TESTS = """
ck as (select distinct chunk_id, doc_id, text, try_cast(regexp_extract(chunk_id, '#([^#]*)$', 1) as int) as number from chunks where text <> '' and chunk_id is not null),
dt as (select doc_id, string_agg(text, chr(10) order by number nulls last, chunk_id) as text from ck group by doc_id),
t as (select distinct id, path, lower(concat_ws(' ', coalesce(symbol, ''), coalesce(title, ''), coalesce(path, ''), array_to_string(coalesce(keywords, []), ' '), coalesce(dt.text, ''))) as h
      from manifest_docs m left join dt on dt.doc_id = m.id where kind = 'test_anchor')"""
_TAILS = "list_transform(range(1, len(string_split({0}, '/')) + 1), lambda i: array_to_string(list_slice(string_split({0}, '/'), i, len(string_split({0}, '/'))), '/'))"
_DIFF = f"""
changed as (select distinct regexp_replace(replace(path, '\\', '/'), '^[./]+', '') as changed from search_hits where stale),
d as (select distinct id, path as p from manifest_docs where path <> ''),
touched as (
  select changed, id from (select changed, unnest({_TAILS.format("changed")}) as p from changed where changed <> '') a join d using (p)
  union select c.changed, b.id from (select id, unnest({_TAILS.format("p")}) as changed from d) b join changed c on c.changed = b.changed and c.changed <> '')
"""

ORACLE = {
    "crosslink_tiers": "with " + _MENTIONS + "select id, repo, symbol, anchor_id, tier from linked",
    "crosslink_unresolved": "with " + _MENTIONS + "select id, repo, symbol from missing",
    "crosslink_statistics": "with " + _MENTIONS + """
, a as (select repo, count(distinct id) as n, count(distinct anchor_id) as m from linked group by repo),
b as (select repo, count(*) as t, count(distinct symbol) as u from missing group by repo)
select coalesce(a.repo, b.repo) as repo, coalesce(n, 0) as records_with_anchors, coalesce(m, 0) as anchors_linked, coalesce(t, 0) as unresolved_total, coalesce(u, 0) as unresolved_unique
from a full join b on a.repo = b.repo""",
    "crosslink_reverse": "with " + _MENTIONS + "select anchor_id, count(distinct id) as documents from linked group by anchor_id",
    "anchor_repo_cap": f"""
select repo, keep_rank, id from (
  select repo, id, row_number() over (partition by repo order by {sql_lookup(ANCHOR_KEEP_RANK, "coalesce(anchor_type, '')", 50)}, coalesce(weight, 0) desc, coalesce(path, ''), id) as keep_rank
  from (select distinct id, repo, anchor_type, weight, path from manifest_docs where kind in ('code_anchor', 'test_anchor'))) where keep_rank <= 500""",
    "anchors_softcap": f"""
with d as (select distinct id, kind, symbol, path, anchor_type, code_anchors from manifest_docs),
e as (select id, unnest(list_distinct(list_filter(coalesce(code_anchors, []), lambda x: x is not null))) as anchor_id from d),
r as (select e.id, e.anchor_id, coalesce(t.anchor_type, '') as ty, {sql_lookup(ANCHOR_PRIORITY, "coalesce(t.anchor_type, '')", 10)} as pr, coalesce(t.kind <> 'code_anchor', true) as other, coalesce(nullif(t.symbol, ''), t.path, '') as name
      from e join d t on t.id = e.anchor_id),
n as (select *, row_number() over (partition by id, ty order by pr desc, other, name, anchor_id) as n from r),
k as (select *, row_number() over (partition by id order by pr desc, other, name, anchor_id) as place from n where n <= {sql_lookup(ANCHOR_SOFT_CAP, "ty", 12)})
select id, place, anchor_id from k where place <= 12""",
    "related_two_hop": """
with d as (select distinct id, external_id, related_contracts from manifest_docs),
b as (select external_id, max(id) as related_id from d where external_id <> '' group by external_id),
s as (select distinct id, related_id from (select id, unnest(related_contracts) as external_id from d) join b using (external_id) where id <> related_id),
t as (select id, 1 as hop, related_id from s union all select a.id, 2, c.related_id from s a join s c on c.id = a.related_id where a.id <> c.related_id)
select id, min(hop) as hop, related_id from t group by id, related_id""",
    "related_tests": "with " + _TESTS + """,
s as (select distinct symbol from manifest_docs where kind = 'code_anchor' and symbol <> ''),
p as (select symbol, regexp_extract_all(regexp_replace(trim(symbol), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as parts from s),
v as (select symbol, unnest(list_distinct(list_filter(list_transform([trim(symbol)] || list_transform(range(2, len(parts) + 1), lambda n: array_to_string(list_slice(parts, 1, n), '')), lambda x: lower(x)), lambda x: length(x) >= 5))) as stem from p),
m as (select symbol, t.id as test_id, t.path, 12 + max(least(length(stem), 16)) as score from v join t on contains(t.h, v.stem) group by symbol, t.id, t.path)
select symbol, test_rank, test_id, score from (select *, row_number() over (partition by symbol order by score desc, coalesce(path, ''), test_id) as test_rank from m) where test_rank <= 8""",
    "query_tests": _scored_sql("lower(kind) in (%s)" % ", ".join(repr(k) for k in L.SEED_KINDS)).rstrip() + "," + _TESTS + f""",
n as (
  select query, tok as needle, {L.QUERY_TOKEN} * times as points from qt where length(tok) > 1 and tok not in ({", ".join(repr(w) for w in STOPWORDS)})
  union all
  select query, lower(symbol), {L.SEED_SYMBOL} from (
    select distinct r.query, regexp_replace(s.symbol, '^\\s+|\\s+$', '', 'g') as symbol
    from ranked r join (select id, symbol from manifest_docs union select id, regexp_extract(a, '#([^#]*)$', 1) from (select id, unnest(code_anchors) as a from manifest_docs) where contains(a, '#')) s on s.id = r.id
    where r.hit_rank <= {L.SEEDS}) where symbol <> ''),
tm as (select query, id as test_id, path, cast(sum(points) as bigint) as score from n, t where contains(h, needle) group by query, id, path)
select query, test_rank, test_id, score from (select *, row_number() over (partition by query order by score desc, coalesce(path, ''), test_id) as test_rank from tm) where test_rank <= 8""",
    "impact_tests": _scored_sql("lower(kind) in (%s)" % ", ".join(repr(k) for k in L.SEED_KINDS)).rstrip() + "," + _TESTS + f""",
fi as (select query, trim(query) as symbol from q0 where regexp_full_match(trim(query), '[A-Z][a-zA-Z0-9]+')),
n as (
  select query, tok as needle, {L.QUERY_TOKEN} * times as tokens, 0 as symbols from qt where length(tok) > 1 and tok not in ({", ".join(repr(w) for w in STOPWORDS)})
  union all
  select query, lower(symbol), 0, {L.SEED_SYMBOL} from (
    select distinct r.query, regexp_replace(s.symbol, '^\\s+|\\s+$', '', 'g') as symbol
    from ranked r join (select id, symbol from manifest_docs union select id, regexp_extract(a, '#([^#]*)$', 1) from (select id, unnest(code_anchors) as a from manifest_docs) where contains(a, '#')) s on s.id = r.id
    where r.hit_rank <= {L.SEEDS}) x where symbol <> '' and not exists (select 1 from fi where fi.query = x.query and fi.symbol = x.symbol)),
pa as (select query, symbol, regexp_extract_all(regexp_replace(symbol, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as parts from fi),
st as (select query, unnest(list_distinct(list_filter(list_transform([symbol] || list_transform(range(2, len(parts) + 1), lambda n: array_to_string(list_slice(parts, 1, n), '')), lambda x: lower(x)), lambda x: length(x) >= 5))) as stem from pa),
tm as (
  select query, id as test_id, path, sum(tokens) as tokens, sum(symbols) as symbols, 0 as stem from n, t where contains(h, needle) group by query, id, path
  union all select query, id, path, 0, 0, 12 + max(least(length(stem), 16)) from st, t where contains(h, stem) group by query, id, path),
ts as (select query, test_id, path, cast(sum(tokens) + sum(symbols) + max(stem) as bigint) as score from tm group by query, test_id, path
       having (max(stem) > 0 or query not in (select query from fi)) and (max(stem) > 0 or sum(symbols) > 0 or sum(tokens) >= 6))
select query, test_rank, test_id, score from (select *, row_number() over (partition by query order by score desc, coalesce(path, ''), test_id) as test_rank from ts) where test_rank <= 8""",
    "tested_by": """
with c as (select lower(symbol) as needle, max(id) as anchor_id from manifest_docs where kind = 'code_anchor' and symbol <> '' group by lower(symbol)),
t as (select distinct id as test_id, lower(coalesce(symbol, '') || ' ' || coalesce(path, '')) as h from manifest_docs where kind = 'test_anchor')
select distinct anchor_id, test_id from c join t on contains(t.h, c.needle)""",
    "diff_records": "with " + _DIFF + "select changed, id from touched",
    "diff_linked": "with " + _DIFF + """
, m as (select distinct id, kind, code_anchors, related_doc_ids from manifest_docs),
c as (select m.* from m where kind = 'code_anchor' and id in (select id from touched))
select id, linked_id, direction from (
  select distinct c.id, l.linked_id, 'named' as direction from (select id, unnest(related_doc_ids) as linked_id from c) l join c using (id) join m on m.id = l.linked_id
  union all
  select distinct l.id, l.linked_id, 'naming' from (select id as linked_id, unnest(code_anchors) as id from m where kind = 'contract') l join c on c.id = l.id)
where linked_id not in (select id from touched)""",
}
