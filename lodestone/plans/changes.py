"""Registered queries on change sets, symbols, findings and the history of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import changes as C
from lodestone.operators import evolution as V
from lodestone.operators import links as L
from lodestone.operators import retrieval as R
from lodestone.plans.links import _DIFF, _TESTS, changed_files
from lodestone.storage import materialize
from lodestone.tables import table


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_docs")


def _asked_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_hits").where("hit_id % 50 = 0")


def links_of_records(spark: SparkSession, folder: str) -> DataFrame:
    return V.evolution_links(_manifest(spark, folder), table(spark, folder, "path_decisions"))


def evolution_links(spark: SparkSession, folder: str) -> DataFrame:
    return links_of_records(spark, folder)


def evolution_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Links at the external ids of the records, and at the symbols, that the asked hits found."""
    hits = _asked_hits(spark, folder).select("doc_id", "symbol")
    names = _manifest(spark, folder).select(F.col("id").alias("doc_id"), "external_id").distinct()
    needles = hits.join(names, "doc_id").select(F.col("external_id").alias("needle")).unionByName(hits.select(F.col("symbol").alias("needle")))
    return V.evolution_trace(links_of_records(spark, folder), needles)


def change_files(spark: SparkSession, folder: str) -> DataFrame:
    return C.change_set(changed_files(spark, folder))


def change_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return changed_files(spark, folder).select("path", C.class_of_file(F.col("path")).alias("symbol")).where("symbol is not null")


def symbol_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that records prefer, cut into class and method."""
    targets = _manifest(spark, folder).select(F.explode(X.strings(F.col("related_anchors"))).alias("target")).distinct()
    return targets.select("target", C.symbol_target(F.col("target")).alias("t")).select("target", "t.class_name", "t.method")


def symbol_contracts(spark: SparkSession, folder: str) -> DataFrame:
    return C.contracts_of_symbols(_asked_hits(spark, folder).select("symbol"), _manifest(spark, folder))


def test_documents(spark: SparkSession, folder: str) -> DataFrame:
    return C.documents_of_tests(changed_files(spark, folder), _manifest(spark, folder))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the given tables: unresolved symbols of builds, stale hits by path, removed records by external id."""
    empty = F.lit(None).cast("string")
    entries = table(spark, folder, "crosslink_stats").select("build_id", F.explode(X.strings(F.col("unresolved_symbols"))).alias("e")).distinct()
    lost = entries.select(F.concat("build_id", F.lit("/"), "e").alias("finding_id"), empty.alias("external_id"), empty.alias("path"), F.col("e").alias("summary"))
    stale = table(spark, folder, "search_hits").where("stale").select(F.concat(F.lit("hit/"), F.col("hit_id").cast("string")), empty, "path", empty).distinct()
    removed = _manifest(spark, folder).where("removed_at is not null and external_id <> ''").select(F.concat(F.lit("removed/"), "id"), "external_id", empty, empty).distinct()
    return lost.union(stale).union(removed)


def finding_documents(spark: SparkSession, folder: str) -> DataFrame:
    return C.documents_of_findings(materialize(findings(spark, folder), "findings"), _manifest(spark, folder))


def symbol_findings(spark: SparkSession, folder: str) -> DataFrame:
    return C.findings_of_symbols(_asked_hits(spark, folder).select("symbol"), materialize(findings(spark, folder), "findings"))


def diff_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The best tests of the classes that changed files are named after."""
    return L.tests_of_names(change_symbols(spark, folder).select("symbol").distinct(), _manifest(spark, folder), table(spark, folder, "chunks"))


def diff_test_labels(spark: SparkSession, folder: str) -> DataFrame:
    return C.test_labels(diff_tests(spark, folder), _manifest(spark, folder))


def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the asked hits name."""
    ids = _asked_hits(spark, folder).select(F.explode("top_chunk_ids").alias("chunk_id")).where("chunk_id is not null")
    rows = R.chunk_lookup(ids, table(spark, folder, "chunks"), _manifest(spark, folder))
    return rows.select("chunk_id", "doc_id", "path", "title", "heading", F.length("shown").cast("bigint").alias("chars"), "truncated", F.md5("shown").alias("digest"))


def gap_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every gap."""
    return R.known_gaps(_manifest(spark, folder).select("id", "path", "repo", "known_gap_ids").distinct())


def gap_members_of_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the gaps of one register, named in lower case."""
    return R.gaps_filtered(gap_members(spark, folder), prefix="vuv-")


QUERIES = {
    "evolution_links": evolution_links, "evolution_trace": evolution_trace, "change_files": change_files, "change_symbols": change_symbols, "symbol_targets": symbol_targets,
    "symbol_contracts": symbol_contracts, "test_documents": test_documents, "finding_documents": finding_documents, "symbol_findings": symbol_findings, "diff_tests": diff_tests,
    "diff_test_labels": diff_test_labels, "chunk_lookup": chunk_lookup, "gap_members": gap_members, "gap_members_of_prefix": gap_members_of_prefix,
}

_PLAIN = r"regexp_replace(replace({0}, '\', '/'), '^[./]+', '')"
_KINDS = ", ".join(repr(k) for k in C.DOCUMENT_KINDS)
_CODE_CLASS = r"(?:^|/)([A-Z][A-Za-z0-9]+)\.(?:java|kt|ts|tsx|js|jsx|go|py)$"

LINKS_SQL = rf"""
ed as (select distinct id, repo, path, kind, external_id, symbol, trust_level, related_contracts, related_anchors from manifest_docs),
eh as (select *, row_number() over (partition by repo, p order by decided_at desc, decision_id desc) as r
       from (select distinct repo, {_PLAIN.format("path")} as p, decision_id, decided_at from path_decisions where path is not null and decided_at is not null)),
ee as (select repo, p, max_by(decision_id, r) as a, min_by(decision_id, r) as b, count(*) as n from eh where r <= 5 group by repo, p),
em as (select ed.*, ee.a, ee.b, ee.n, case kind when 'contract' then coalesce(trust_level, 'confirmed') when 'adr' then coalesce(trust_level, 'accepted') else 'implementation' end as level
       from ed join ee on ed.repo = ee.repo and {_PLAIN.format("ed.path")} = ee.p where kind in ('contract', 'adr', 'test_anchor') and path <> '' and external_id <> ''),
elinks as (
  select 'introduced_in' as link_type, external_id as source, cast(a as varchar) as target, repo, path, kind as source_type, level as trust_level from em
  union select 'modified_by', external_id, cast(b as varchar), repo, path, 'git_mining', 'inferred' from em where n > 1
  union select 'decided_in', c, external_id, repo, path, 'adr', coalesce(trust_level, 'accepted') from (select *, unnest(related_contracts) as c from ed where kind = 'adr' and path <> '' and external_id <> '') where c <> ''
  union select 'validated_by', c.external_id, t.symbol, t.repo, t.path, 'test_anchor', 'implementation'
    from (select external_id, split_part(unnest(related_anchors), '.', 1) as s from ed where kind = 'contract' and external_id <> '') c join ed t on t.kind = 'test_anchor' and t.symbol <> '' and c.s <> '' and starts_with(t.symbol, c.s))
"""
_FINDINGS = rf"""
fs as (
  select distinct build_id || '/' || e as finding_id, null as external_id, null as path, e as summary from (select build_id, unnest(unresolved_symbols) as e from crosslink_stats) where e is not null
  union all select distinct 'hit/' || cast(hit_id as varchar), null, path, null from search_hits where stale
  union all select distinct 'removed/' || id, external_id, null, null from manifest_docs where removed_at is not null and external_id <> '')
"""
_DIFF_TESTS = _DIFF.replace("\nchanged as", "\nchanged as", 1).rstrip() + "," + _TESTS + rf""",
s as (select distinct regexp_extract(changed, '{_CODE_CLASS}', 1) as symbol from changed where regexp_matches(changed, '{_CODE_CLASS}')),
p as (select symbol, regexp_extract_all(regexp_replace(trim(symbol), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as parts from s),
v as (select symbol, unnest(list_distinct(list_filter(list_transform([trim(symbol)] || list_transform(range(2, len(parts) + 1), lambda n: array_to_string(list_slice(parts, 1, n), '')), lambda x: lower(x)), lambda x: length(x) >= 5))) as stem from p),
mt as (select symbol, t.id as test_id, t.path, 12 + max(least(length(stem), 16)) as score from v join t on contains(t.h, v.stem) group by symbol, t.id, t.path),
best as (select symbol, test_rank, test_id, score from (select *, row_number() over (partition by symbol order by score desc, coalesce(path, ''), test_id) as test_rank from mt) where test_rank <= 8)
"""
_GAPS = "select distinct id, path, repo, known_gap_ids from manifest_docs"

ORACLE = {
    "evolution_links": "with " + LINKS_SQL + "select * from elinks",
    "evolution_trace": "with " + LINKS_SQL + """,
h as (select doc_id, symbol from search_hits where hit_id % 50 = 0),
k as (select distinct trim(needle) as needle from (select external_id as needle from h join (select distinct id, external_id from manifest_docs) m on m.id = h.doc_id union all select symbol from h) where trim(needle) <> '')
select needle, case when trust_level in ('confirmed', 'accepted', 'implementation') then 'trusted' when trust_level = 'inferred' then 'inferred' else 'other' end as trust_class,
       link_type, source, target, repo, path, source_type, trust_level
from k join elinks e on k.needle = e.source or k.needle = e.target""",
    "change_files": "with " + _DIFF + rf"""
select row_number() over (order by changed) as place, changed as path, regexp_matches(changed, '(?i)\.(java|kt|tsx?|jsx?|go|py|ya?ml)$') as is_code,
       ends_with(lower(changed), '.md') and (contains(lower(changed), '/docs/') or starts_with(lower(changed), 'docs/')) as is_doc,
       regexp_matches(changed, '{C.TEST_FILE}') as is_test, count(*) over () as total, count(*) over () > {C.LISTED} as truncated
from changed where changed <> '' qualify row_number() over (order by changed) <= {C.LISTED}""",
    "change_symbols": "with " + _DIFF + f"select changed as path, regexp_extract(changed, '{_CODE_CLASS}', 1) as symbol from changed where regexp_matches(changed, '{_CODE_CLASS}')",
    "symbol_targets": r"""
select target, case when m then regexp_extract(p, '^([A-Z][A-Za-z0-9]+)\.([a-z][A-Za-z0-9]*)$', 1) else p end as class_name, case when m then regexp_extract(p, '^([A-Z][A-Za-z0-9]+)\.([a-z][A-Za-z0-9]*)$', 2) end as method
from (select *, regexp_matches(p, '^([A-Z][A-Za-z0-9]+)\.([a-z][A-Za-z0-9]*)$') as m from (
  select distinct target, trim(target) as p from (select unnest(related_anchors) as target from manifest_docs) where target is not null))""",
    "symbol_contracts": """
with d as (select distinct id, kind, symbol, related_doc_ids, code_anchors from manifest_docs),
a as (select * from d where kind = 'code_anchor' and symbol in (select symbol from search_hits where hit_id % 50 = 0 and symbol <> '')),
x as (select u.symbol, c as contract_id, true as f, false as b from (select symbol, unnest(related_doc_ids) as c from a) u join d on d.id = c and d.kind = 'contract'
      union all select a.symbol, c.id, false, true from (select id, unnest(code_anchors) as anchor from d where kind = 'contract') c join a on a.id = c.anchor)
select symbol, contract_id, bool_or(f) as by_anchor, bool_or(b) as by_contract from x group by symbol, contract_id""",
    "test_documents": "with " + _DIFF.rstrip() + f""",
m as (select distinct id, kind, symbol, related_doc_ids, code_anchors from manifest_docs),
te as (select * from m where kind = 'test_anchor' and id in (select id from touched)),
k as (select * from m where kind in ({_KINDS})),
x as (select te.id as test_id, k.id as doc_id, true as named from (select id, unnest(related_doc_ids) as r from te) te join k on k.id = te.r
      union all select te.id, s.doc_id, false from te join (select k.id as doc_id, lower(m.symbol) as s from (select id, unnest(code_anchors) as a from k) k join m on m.id = k.a where length(m.symbol) >= {C.LEAST_SYMBOL}) s on contains(lower(te.symbol), s.s))
select test_id, doc_id, bool_or(named) as named from x where doc_id not in (select id from touched) group by test_id, doc_id""",
    "finding_documents": "with " + _FINDINGS.rstrip() + rf""",
k as (select distinct id, external_id, {_PLAIN.format("path")} as p, related_anchors from manifest_docs where kind in ({_KINDS})),
g as (select finding_id, external_id, {_PLAIN.format("path")} as p, summary from fs),
x as (select finding_id, id as doc_id, 1 as tier from g join k on g.external_id = k.external_id and g.external_id <> ''
      union all select finding_id, id, 2 from g join k on g.p <> '' and k.p <> '' and (g.p = k.p or ends_with(g.p, '/' || k.p) or ends_with(k.p, '/' || g.p))
      union all select finding_id, id, 3 from g join (select id, split_part(unnest(related_anchors), '.', 1) as s from k) a on a.s <> '' and contains(g.summary, a.s))
select finding_id, doc_id, min(tier) as tier from x group by finding_id, doc_id""",
    "symbol_findings": "with " + _FINDINGS.rstrip() + """,
s as (select distinct symbol from search_hits where hit_id % 50 = 0 and symbol <> '')
select distinct symbol, finding_id from s join fs on contains(lower(fs.summary), lower(s.symbol)) or contains(fs.external_id, s.symbol)""",
    "diff_tests": "with " + _DIFF_TESTS + "select * from best",
    "diff_test_labels": "with " + _DIFF_TESTS + r""",
la as (select distinct b.symbol, coalesce(nullif(m.symbol, ''), regexp_replace(string_split(m.path, '/')[-1], '(.)\.[^.]*$', '\1')) as label from best b join (select distinct id, symbol, path from manifest_docs where kind = 'test_anchor') m on m.id = b.test_id),
lr as (select *, row_number() over (partition by symbol order by case when ends_with(lower(label), 'contracttest') then 0 when ends_with(lower(label), 'integrationtest') then 1 when ends_with(lower(label), 'securitytest') then 2 when ends_with(lower(label), 'test') then 3 else 4 end, label) as place from la where label <> '')
select symbol, place, label from lr where place <= 4""",
    "chunk_lookup": """
with a as (select distinct c from (select unnest(top_chunk_ids) as c from search_hits where hit_id % 50 = 0) where c is not null),
x as (select k.*, case when regexp_matches(c, '(?s)^.*#[0-9]+$') then regexp_extract(c, '(?s)^(.*)#[0-9]+$', 1) else c end as id, coalesce(k.text, '') as t
      from a join (select distinct chunk_id, doc_id, title, heading, text from chunks) k on k.chunk_id = a.c),
o as (select x.*, m.path, case when length(t) > 8000 then left(t, 7997) || '...' else t end as shown from x left join (select id, min(path) as path from manifest_docs group by id) m on m.id = x.id)
select chunk_id, doc_id, path, title, heading, length(shown) as chars, length(t) > 8000 as truncated, md5(shown) as digest from o""",
    "gap_members": f"select gap_id, id, path, repo from (select id, path, repo, unnest(known_gap_ids) as gap_id from ({_GAPS})) where gap_id is not null",
    "gap_members_of_prefix": f"select gap_id, id, path, repo from (select id, path, repo, unnest(known_gap_ids) as gap_id from ({_GAPS})) where starts_with(upper(gap_id), 'VUV-')",
}
