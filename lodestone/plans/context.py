"""Registered queries that put records together with what belongs to them: references, snippets, anchors, owners, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import context as T
from lodestone.operators import impact as M
from lodestone.operators import links as L
from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.plans.links import _DIFF, _MENTIONS, crosslink_tiers, diff_records
from lodestone.plans.retrieval import _BEST
from lodestone.plans.search import _IMPACT, _hits, _scored_sql, asked, docs_of
from lodestone.storage import materialize
from lodestone.tables import table
from lodestone.vocab import ANCHOR_PRIORITY, ANCHOR_SOFT_CAP, sql_lookup

#: anchors that the registered report keeps of each repository
REPORT_CAP = 20


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_docs")


def search_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The first hits of each query with what refers to their records."""
    return T.references(_hits(spark, folder, limit=3), _manifest(spark, folder))


def hit_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The snippet of the best chunk of each of the first hits."""
    hits = materialize(_hits(spark, folder, limit=3), "hits")
    return R.snippets_of_hits(hits, table(spark, folder, "chunks"))


def explicit_search(spark: SparkSession, folder: str) -> DataFrame:
    """Searches for every gap id that a hit lists and every symbol that an asked hit has, as explicit arguments."""
    hits = table(spark, folder, "search_hits").where("hit_id % 50 = 0")
    gaps = hits.select(F.explode("known_gap_ids").alias("gap_id"))
    parsed = S.explicit_queries(gaps, "gap_id", "gap").unionByName(S.explicit_queries(hits, "symbol", "symbol"))
    return S.search_parsed(docs_of(spark, folder), parsed).select("query", "hit_rank", "id", "score")


def crosslink_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Which records each anchor implements."""
    return crosslink_tiers(spark, folder).select("anchor_id", "id").distinct()


def anchor_cap_report(spark: SparkSession, folder: str) -> DataFrame:
    return L.cap_report(_manifest(spark, folder), REPORT_CAP)


def impact_context(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps, owners, services, sources and contracts of the records an impact analysis finds."""
    found = M.impact_records(docs_of(spark, folder), _manifest(spark, folder), asked(spark, folder))
    return T.belongings(found.select("query", "id"), _manifest(spark, folder), "query")


def impact_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Code anchors of an impact analysis: those of earlier seeds first, few of the plain types."""
    found = M.impact_records(docs_of(spark, folder), _manifest(spark, folder), asked(spark, folder))
    return T.anchors_of_seeds(found.where("hop = 0").select("query", F.col("place").alias("seed"), "id"), _manifest(spark, folder))


def diff_context(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps, owners, services, sources and contracts of the records at each changed path."""
    return T.belongings(diff_records(spark, folder), _manifest(spark, folder), "changed")


def orientation_contracts(spark: SparkSession, folder: str) -> DataFrame:
    return T.first_contracts(_manifest(spark, folder))


QUERIES = {
    "search_refs": search_refs, "hit_snippets": hit_snippets, "explicit_search": explicit_search, "crosslink_pairs": crosslink_pairs, "anchor_cap_report": anchor_cap_report,
    "impact_context": impact_context, "impact_anchors": impact_anchors, "diff_context": diff_context, "orientation_contracts": orientation_contracts,
}

_IMPACT_ROWS = _scored_sql("kind in (%s)" % ", ".join(repr(k) for k in M.IMPACT_KINDS)).rstrip() + _IMPACT.replace("select query, 0 as hop, hit_rank as place, id from seeds", "ir as (select query, 0 as hop, hit_rank as place, id from seeds", 1).replace("on c.query = h2.query where h2.place + n <= 3", "on c.query = h2.query where h2.place + n <= 3)")
_IMPACT_ROWS = _IMPACT_ROWS.replace("group by h1.query, st.rid))\nir as", "group by h1.query, st.rid)),\nir as")
_BELONGINGS = """
bm as (select distinct id, repo, path, kind, external_id, owner, known_gap_ids from manifest_docs),
bj as (select b.k, bm.* from br0 b join bm on bm.id = b.id),
bl as (
  select k, 'gap' as part, unnest(known_gap_ids) as value from bj
  union select k, 'owner', coalesce(nullif(owner.team, ''), nullif(owner.contact, '')) from bj where owner is not null
  union select k, 'service', coalesce(nullif(owner.service, ''), nullif(repo, '')) from bj
  union select k, 'source', path from bj
  union select k, 'contract', external_id from bj where kind = 'contract')
"""

ORACLE = {
    "search_refs": _scored_sql() + """
select query, hit_rank, r.id, m.repo, m.path, m.kind, m.title, nullif(m.external_id, '') as external_id, nullif(m.symbol, '') as symbol, m.line_start, nullif(m.trust_level, '') as trust_level, score
from ranked r join (select distinct id, repo, path, kind, title, external_id, symbol, line_start, trust_level from manifest_docs) m on m.id = r.id where hit_rank <= 3""",
    "hit_snippets": _scored_sql().rstrip() + "," + _BEST + r"""
select query, id, hit_rank, chunk_id, case when length(f) > 200 then left(f, 197) || '...' else f end as snippet
from (select b.*, regexp_replace(replace(coalesce(ck.text, ''), chr(10), ' '), '^\s+|\s+$', '', 'g') as f from best b join ck on ck.chunk_id = b.chunk_id where chunk_rank = 1 and hit_rank <= 3)""",
    "explicit_search": f"""
with d as (select distinct id, repo, path, kind, title, domain, external_id, status, symbol, anchor_type, headings, keywords, known_gap_ids, weight, trust_level from manifest_docs),
h as (select symbol, known_gap_ids from search_hits where hit_id % 50 = 0),
q as (select distinct 'gap ' || g as query, upper(trim(g)) as gap, null as sym from (select unnest(known_gap_ids) as g from h) where trim(g) <> '' union select distinct 'symbol ' || symbol, null, trim(symbol) from h where trim(symbol) <> ''),
e as (
  select query, id, case when kind in ('contract', 'request_flow', 'frontend_contract', 'backend_contract') then 62 else 50 end as v from q join d on list_contains(d.known_gap_ids, q.gap)
  union all select query, id, case when d.symbol = q.sym then 80 else 50 end from q join d on d.symbol = q.sym or (d.symbol <> q.sym and starts_with(d.symbol, q.sym) and ends_with(d.symbol, 'Impl'))),
s as (select query, d.id, d.path, cast(sum(v) + any_value(coalesce(d.weight, 0) // 10 + ({{rank}}) // 10) as bigint) as score from e join d on d.id = e.id group by query, d.id, d.path)
select query, hit_rank, id, score from (select *, row_number() over (partition by query order by score desc, coalesce(path, ''), id) as hit_rank from s) where hit_rank <= 10""".replace("{rank}", sql_lookup(S.TRUST_RANK, "coalesce(d.trust_level, 'confirmed')", 0)),
    "crosslink_pairs": "with " + _MENTIONS + "select distinct anchor_id, id from linked",
    "anchor_cap_report": f"select repo, count(*) as total, least(count(*), {REPORT_CAP}) as kept, greatest(count(*) - {REPORT_CAP}, 0) as dropped from (select distinct id, repo from manifest_docs where kind in ('code_anchor', 'test_anchor')) group by repo",
    "impact_context": _IMPACT_ROWS + ", br0 as (select query as k, id from ir)," + _BELONGINGS + "select k as query, part, value from bl where value <> ''",
    "impact_anchors": _IMPACT_ROWS + f""",
ia as (select ir.query, ir.place as seed, unnest(list_filter(code_anchors, lambda x: x is not null)) as anchor_id from ir join (select distinct id, code_anchors from manifest_docs) m on m.id = ir.id where ir.hop = 0),
ib as (select query, anchor_id, min(seed) as seed from ia group by query, anchor_id),
ic as (select ib.*, coalesce(t.anchor_type, '') as ty, {sql_lookup(ANCHOR_PRIORITY, "coalesce(t.anchor_type, '')", 10)} as pr, coalesce(t.kind <> 'code_anchor', true) as other, coalesce(nullif(t.symbol, ''), t.path, '') as name
       from ib join (select distinct id, kind, symbol, path, anchor_type from manifest_docs) t on t.id = ib.anchor_id),
ie as (select *, row_number() over (partition by query, ty order by seed, pr desc, other, name, anchor_id) as n from ic)
select query, place, anchor_id from (select *, row_number() over (partition by query order by seed, pr desc, other, name, anchor_id) as place from ie where n <= {sql_lookup(ANCHOR_SOFT_CAP, "ty", 12)}) where place <= 12""",
    "diff_context": "with " + _DIFF.rstrip() + ", br0 as (select changed as k, id from touched)," + _BELONGINGS + "select k as changed, part, value from bl where value <> ''",
    "orientation_contracts": """
select repo, place, id from (select repo, id, row_number() over (partition by repo order by coalesce(path, ''), id) as place from (select distinct id, repo, path from manifest_docs where kind = 'contract' and trust_level = 'confirmed')) where place <= 8""",
}
