"""Registered queries on search: the queries of every hit with an id divisible by 50, against all records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import impact as M
from lodestone.operators import search as S
from lodestone.tables import table
from lodestone.vocab import CONTEXT_KINDS, CONTRACT_KINDS, STOPWORDS, TRUST_RANK, sql_lookup


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_hits").where("hit_id % 50 = 0").select("query")


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    return S.records(table(spark, folder, "manifest_docs"))


def _hits(spark: SparkSession, folder: str, kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
    return S.search(S.restricted(docs_of(spark, folder), kinds=kinds), asked(spark, folder), limit)


def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("query", "hit_rank", "id", "score")


def search_contracts(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, kinds=["contract"]).select("query", "hit_rank", "id", "score")


def search_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return S.seeds(_hits(spark, folder)).select("query", "hit_rank", "id", "score")


def search_tokens(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "search_hits").select("query").distinct()
    words = X.tokens(F.col("query"))
    return queries.select("query", F.array_join(words, " ").alias("tokens"), F.array_join(X.significant(words), " ").alias("significant"))


def token_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs, parsed = S.numbered(docs_of(spark, folder), "records"), S.numbered(S.parsed_queries(asked(spark, folder)), "queries")
    rows = S.token_weights(docs, parsed, S.matched(docs, parsed)).join(parsed.select(F.col("n").alias("q"), "query"), "q")
    return rows.select("query", "token", F.col("times").cast("bigint").alias("times"), F.col("df").cast("bigint").alias("df"), F.round("weight", 6).alias("weight"))


def impact_records(spark: SparkSession, folder: str) -> DataFrame:
    return M.impact_records(docs_of(spark, folder), table(spark, folder, "manifest_docs"), asked(spark, folder))


QUERIES = {"impact_records": impact_records, "search_topk": search_topk, "search_contracts": search_contracts, "search_seeds": search_seeds, "search_tokens": search_tokens, "token_weights": token_weights}

_TOKENS = r"regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_\-]*')"
_DOCS = "select distinct id, repo, path, kind, title, domain, external_id, status, symbol, anchor_type, headings, keywords, known_gap_ids, weight, trust_level from manifest_docs"
_LIST = lambda c: f"list_transform(list_filter(coalesce({c}, []), lambda x: x is not null), lambda x: lower(x))"


def _scored_sql(where: str = "true") -> str:
    return rf"""
with d0 as ({_DOCS}), d as (
  select *, lower(coalesce(title, '')) as t, {_LIST("keywords")} as k, {_LIST("headings")} as h, lower(coalesce(path, '')) as p, lower(coalesce(symbol, '')) as s,
         {_LIST("known_gap_ids")} as g, lower(coalesce(external_id, '')) as x
  from d0 where {where}
), b as (
  select *, concat_ws(' ', t, array_to_string(k, ' '), array_to_string(h, ' '), p, s, x) as blob from d
), q0 as (
  select distinct query from search_hits where hit_id % 50 = 0 and query is not null
), q as (
  select query, {_TOKENS} as toks, case when regexp_full_match(trim(query), '[A-Z]{{2,5}}(?:-[A-Z0-9]+){{1,5}}-[0-9]{{2,}}') then trim(query) end as gap,
         case when regexp_full_match(trim(query), '[A-Z][a-zA-Z0-9]+') then trim(query) end as sym
  from q0
), qt as (
  select query, tok, count(*) as times from (select query, unnest(toks) as tok from q) group by query, tok
), f as (
  select tok, count(*) as df1 from (select distinct tok from qt) a, b where contains(b.blob, a.tok) group by tok
), w as (
  select query, qt.tok, times, times * coalesce(df1, 0) as df, 1 + ln(((select count(*) from d) + 1) / (times * coalesce(df1, 0) + 1)) as weight
  from qt left join f on qt.tok = f.tok
), c as (
  select w.query, b.id, w.times, w.weight, contains(b.t, w.tok) as titled,
         case when contains(b.t, w.tok) or list_contains(b.k, w.tok) then 3
              when len(list_filter(b.k, lambda y: contains(y, w.tok))) > 0 then 2
              when len(list_filter(b.h, lambda y: contains(y, w.tok))) > 0 then 1
              when contains(b.p, w.tok) then 1 else 0 end
         + case when b.s = w.tok then 5 else 0 end
         + case when len(list_filter(b.g, lambda y: contains(y, w.tok))) > 0 then 5 else 0 end as points
  from w, b
), m as (
  select query, id, sum(case when points > 0 then greatest(1, cast(round_even(points * weight, 0) as bigint)) else 0 end * times) as content, sum(case when titled then times else 0 end) as titles
  from c group by query, id
), e as (
  select query, id, sum(v) as exact from (
    select q.query, d.id, case when d.symbol = q.sym then 80 when starts_with(d.symbol, q.sym) and ends_with(d.symbol, 'Impl') then 50 else 0 end as v from q, d where q.sym is not null and d.symbol <> ''
    union all
    select q.query, d.id, case when d.kind in ({", ".join(repr(k) for k in CONTRACT_KINDS)}) then 62 else 50 end from q, d where q.gap is not null and list_contains(d.known_gap_ids, q.gap)
  ) group by query, id
), z as (
  select m.query, m.id, m.content + coalesce(e.exact, 0) + case when titles >= 2 then 3 * (titles - 1) else 0 end as content
  from m left join e on m.query = e.query and m.id = e.id
), r as (
  select z.query, z.id, d.path,
         cast(z.content + coalesce(d.weight, 0) // 10 + ({sql_lookup(TRUST_RANK, "coalesce(d.trust_level, 'confirmed')", 0)}) // 10
         + case when lower(d.kind) in ({", ".join(repr(k) for k in CONTEXT_KINDS)})
                 and len(list_intersect(q.toks, list_append(list_filter(regexp_split_to_array(lower(d.repo), '[^a-z0-9]+'), lambda y: y <> ''), lower(d.repo)))) > 0 then 3 else 0 end as bigint) as score
  from z join d on z.id = d.id join q on z.query = q.query where z.content > 0
), ranked as (
  select query, id, score, row_number() over (partition by query order by score desc, coalesce(path, ''), id) as hit_rank from r
)
"""


_IMPACT = """,
ab as (select id, lower(concat_ws(' ', coalesce(title, ''), array_to_string(coalesce(keywords, []), ' '), array_to_string(coalesce(headings, []), ' '), coalesce(path, ''), coalesce(symbol, ''), coalesce(external_id, ''))) as blob from d0),
sg as (select query, tok, times from qt where length(tok) > 1 and tok not in (%s)),
af as (select tok, count(*) as c from (select distinct tok from sg) x, ab where contains(ab.blob, x.tok) group by tok),
aw as (select query, sg.tok, 1 + ln(((select count(*) from d0) + 1) / (times * coalesce(c, 0) + 1)) as weight from sg left join af on af.tok = sg.tok),
med as (select query, list(weight order by weight)[len(list(weight)) // 2 + 1] as median from aw group by query),
seeds as (select query, hit_rank, id from (select *, max(score) over (partition by query) as top from ranked where hit_rank <= 5) where score >= greatest(cast(trunc(top * 0.82) as bigint), top - 8)),
lk as (select distinct id, external_id, related_contracts from manifest_docs),
br as (select external_id, max(id) as rid from lk where external_id <> '' group by external_id),
st as (select l.id as parent, l.pos, br.rid from (select id, unnest(related_contracts) as external_id, unnest(range(1, len(related_contracts) + 1)) as pos from lk) l join br on br.external_id = l.external_id),
ho as (select m.query, ab.id as rid, count(*) filter (contains(ab.blob, aw.tok) and aw.weight >= m.median) as strong, count(*) filter (contains(ab.blob, aw.tok)) as held from med m join aw on aw.query = m.query, ab group by m.query, ab.id),
pr as (select query, min_by(s.id, hit_rank) as parent from seeds s join d0 on d0.id = s.id where d0.kind = 'contract' group by query),
h1 as (select * from (select query, rid, strong, free, row_number() over (partition by query order by pos) as place from (
  select pr.query, st.rid, coalesce(ho.strong, 0) as strong, m.query is null as free, min(st.pos) as pos
  from pr join st on st.parent = pr.parent left join med m on m.query = pr.query left join ho on ho.query = pr.query and ho.rid = st.rid
  where (m.query is null or coalesce(ho.strong, 0) > 0) and (pr.query, st.rid) not in (select (query, id) from seeds) group by all)) where place <= 3),
h2 as (select query, rid, row_number() over (partition by query order by o) as place from (
  select h1.query, st.rid, min({'a': -h1.strong, 'b': h1.place, 'c': st.pos}) as o
  from h1 join st on st.parent = h1.rid left join ho on ho.query = h1.query and ho.rid = st.rid
  where (h1.free or h1.strong > 0) and (h1.free or coalesce(ho.held, 0) > 0) and (h1.query, st.rid) not in (select (query, id) from seeds) and (h1.query, st.rid) not in (select (query, rid) from h1)
  group by h1.query, st.rid))
select query, 0 as hop, hit_rank as place, id from seeds
union all select query, 1, place, rid from h1
union all select h2.query, 2, h2.place, h2.rid from h2 join (select query, count(*) as n from h1 group by query) c on c.query = h2.query where h2.place + n <= 3""" % ", ".join(repr(w) for w in STOPWORDS)

ORACLE = {
    "impact_records": _scored_sql("kind in (%s)" % ", ".join(repr(k) for k in M.IMPACT_KINDS)).rstrip() + _IMPACT,
    "search_topk": _scored_sql() + "select query, hit_rank, id, score from ranked where hit_rank <= 10",
    "search_contracts": _scored_sql("lower(kind) = 'contract'") + "select query, hit_rank, id, score from ranked where hit_rank <= 10",
    "search_seeds": _scored_sql()
    + "select query, hit_rank, id, score from (select *, max(score) over (partition by query) as top from ranked where hit_rank <= 10) where score >= greatest(cast(trunc(top * 0.82) as bigint), top - 8)",
    "search_tokens": rf"""
select query, array_to_string(toks, ' ') as tokens, array_to_string(list_filter(toks, lambda x: x not in ({", ".join(repr(w) for w in STOPWORDS)}) and length(x) > 1), ' ') as significant
from (select distinct query, {_TOKENS.replace("query", "coalesce(query, '')")} as toks from search_hits)""",
    "token_weights": _scored_sql() + "select query, tok as token, times, cast(df as bigint) as df, round(weight, 6) as weight from w",
}
