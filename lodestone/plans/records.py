"""Registered queries on extraction, graph, integrity, status and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.globs import Policy, decided
from lodestone.operators import extraction as E
from lodestone.operators import graph as G
from lodestone.operators import integrity as I
from lodestone.plans.changes import LINKS_SQL, links_of_records
from lodestone.sources import collectors as W
from lodestone.storage import materialize
from lodestone.tables import table
from lodestone.vocab import KIND_WEIGHT, sql_lookup

#: the policy that the registered policy queries apply
POLICY = Policy(mode="allowlist", include=("src/**", "internal/**", "docs/**", "web/**"), exclude=("**/legacy/**", "tools/**", "web/**"), ignore=("*.log", "node_modules/", "target/", "build/", "*.min.js"))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_docs")


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    return E.outlines(table(spark, folder, "documents"))


def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    return E.sections(table(spark, folder, "documents")).select("doc_id", "section_no", "heading", F.length("section").cast("bigint").alias("chars"))


def packed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return E.packed_sections(table(spark, folder, "documents")).select("doc_id", "section_no", "part_no", F.octet_length("chunk").cast("bigint").alias("n_bytes"), F.md5("chunk").alias("digest"))


def inline_links(spark: SparkSession, folder: str) -> DataFrame:
    return E.inline_links(table(spark, folder, "documents"))


def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return G.code_symbols(table(spark, folder, "source_files"))


def code_imports(spark: SparkSession, folder: str) -> DataFrame:
    return G.imports(table(spark, folder, "source_files"))


def _structure(spark: SparkSession, folder: str) -> DataFrame:
    return G.structural_edges(table(spark, folder, "source_files"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.edges(_manifest(spark, folder), _structure(spark, folder), links_of_records(spark, folder))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.nodes(_manifest(spark, folder), _structure(spark, folder))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(materialize(_edges(spark, folder), "edges"))


def structural_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.structural_edges(table(spark, folder, "source_files"))


def orientation(spark: SparkSession, folder: str) -> DataFrame:
    return G.orientation(G.structural_edges(table(spark, folder, "source_files")))


def class_services(spark: SparkSession, folder: str) -> DataFrame:
    return G.services_of_controllers(G.structural_edges(table(spark, folder, "source_files")))


def path_history(spark: SparkSession, folder: str) -> DataFrame:
    return G.path_history(table(spark, folder, "path_decisions"))


def lint_violations(spark: SparkSession, folder: str) -> DataFrame:
    return I.violations(_manifest(spark, folder))


def build_changes(spark: SparkSession, folder: str) -> DataFrame:
    return I.build_changes(table(spark, folder, "crosslink_stats"))


def kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return I.kind_counts(_manifest(spark, folder))


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    return I.index_status(_manifest(spark, folder), table(spark, folder, "chunks"))


def owners(spark: SparkSession, folder: str) -> DataFrame:
    return I.owners(_manifest(spark, folder))


def services(spark: SparkSession, folder: str) -> DataFrame:
    return I.services(_manifest(spark, folder))


def trust_differences(spark: SparkSession, folder: str) -> DataFrame:
    return I.trust_differences(_manifest(spark, folder))


def policy_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "path_decisions").select("repo", X.plain_path(F.col("path")).alias("path")).distinct()
    return rows.select("repo", "path", decided(F.col("path"), F.col("repo"), POLICY).alias("d")).select("repo", "path", "d.*")


def policy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return policy_decisions(spark, folder).groupBy("repo", "reason").agg(F.count("*").alias("paths"))


def file_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """What the policy decides on each source file and which part of a build takes it."""
    return W.explained(table(spark, folder, "source_files").select("repo", X.plain_path(F.col("path")).alias("path")), POLICY)


def symbol_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The lines from each defined symbol on that its chunk shows."""
    files = table(spark, folder, "source_files")
    rows = W.symbol_excerpts(files, G.code_symbols(files))
    return rows.select("repo", "path", "symbol", "symbol_kind", "line_start", "line_end", F.md5("excerpt").alias("digest"))


def domain_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return I.domain_phrases(_manifest(spark, folder))


def workspace_status(spark: SparkSession, folder: str) -> DataFrame:
    return I.workspace_status(_manifest(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "search_hits"), table(spark, folder, "crosslink_stats"))


def contract_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    """External ids that no record relates to, and related ids that no record bears."""
    docs = _manifest(spark, folder)
    return I.reciprocity(docs.where("external_id <> ''").select("external_id"), docs.select(F.explode("related_contracts").alias("external_id")).where("external_id <> ''"), "external_id")


QUERIES = {
    "file_explanations": file_explanations, "symbol_excerpts": symbol_excerpts, "domain_phrases": domain_phrases, "workspace_status": workspace_status, "contract_reciprocity": contract_reciprocity,
    "outlines": outlines, "doc_sections": doc_sections, "packed_chunks": packed_chunks, "inline_links": inline_links, "code_symbols": code_symbols, "code_imports": code_imports,
    "graph_nodes": graph_nodes, "graph_edges": graph_edges, "graph_degrees": graph_degrees, "structural_edges": structural_edges, "orientation": orientation, "class_services": class_services, "path_history": path_history, "lint_violations": lint_violations,
    "build_changes": build_changes, "kind_counts": kind_counts, "index_status": index_status, "owners": owners, "services": services, "trust_differences": trust_differences,
    "policy_decisions": policy_decisions, "policy_counts": policy_counts,
}

_LF = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
_BODY = rf"""
p as (select doc_id, repo, kind, title, {_LF} as t from documents),
f as (select *, regexp_matches(t, '\A[ \t]*---[ \t]*\n(?:(?s:.*?)\n)??[ \t]*---[ \t]*(?:\n|\z)') as fm from p),
b as (select *, case when fm then regexp_replace(regexp_replace(t, '\A[ \t]*---[ \t]*\n(?:(?s:.*?)\n)??[ \t]*---[ \t]*(?:\n|\z)', ''), '\A\s+', '') else t end as body,
             case when fm then regexp_extract(t, '\A[ \t]*---[ \t]*\n((?s:.*?))(?:\A|\n)[ \t]*---[ \t]*(?:\n|\z)', 1) else '' end as block from f)
"""
_SECTIONS = rf"""
p as (select doc_id, kind, coalesce(title, '') as title, {_LF} as t, not coalesce(kind in ('contract', 'known_gaps'), false) and strlen({_LF}) <= 8192 as whole from documents where text is not null),
s as (select doc_id, title, whole, unnest(case when whole then [t] else string_split(regexp_replace(t, '(?m)^(##[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) end) as part,
             unnest(range(0, len(case when whole then [t] else string_split(regexp_replace(t, '(?m)^(##[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) end))) as section_no,
             starts_with(t, '## ') or starts_with(t, '##' || chr(9)) as lead from p),
c as (select doc_id, section_no - case when lead and not whole then 1 else 0 end as section_no, not whole and regexp_matches(part, '\A##[ \t]+\S') as starts, title, part from s),
sections as (
  select * from (
    select doc_id, section_no, case when starts then trim(regexp_extract(part, '\A##[ \t]+([^\n]*)', 1)) else title end as heading,
           regexp_replace(regexp_replace(case when starts then regexp_replace(part, '\A##[^\n]*\n?', '') else part end, '\A\s+', ''), '\s+\z', '') as section from c)
  where section <> '')
"""
_NODE = """
docs as (
  select *, coalesce(nullif(external_id, ''), id) as node,
         case when owner is not null then 'owner:' || coalesce(nullif(owner.team, ''), nullif(owner.contact, ''), nullif(owner.service, ''), 'None') end as owner_node
  from (select distinct id, repo, path, kind, title, symbol, external_id, owner, known_gap_ids, code_anchors, related_contracts from manifest_docs)),
shown as (select * from docs where kind in ('contract', 'adr', 'known_gaps', 'code_anchor', 'test_anchor'))
"""
_STRUCTURE = r"""
f as (select distinct repo, path, text, regexp_extract(text, '(?:public\s+)?(?:abstract\s+)?class\s+(\w+)', 1) as source from source_files where path like '%.java' and text is not null),
edges as (
  select distinct repo, path, source, target, edge_type from (
    select repo, path, source, list_extract(string_split(unnest(regexp_extract_all(text, '(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;', 1)), '.'), -1) as target, 'imports' as edge_type from f
    union all select repo, path, source, unnest(regexp_extract_all(text, '(?:private\s+final|@Autowired\s+private)\s+(\w+Service\w*)\s+\w+;', 1)), 'uses_service' from f
    union all select repo, path, source, unnest(regexp_extract_all(text, '(?:private\s+final|@Autowired\s+private)\s+(\w+Repository\w*)\s+\w+;', 1)), 'uses_repository' from f
    union all select repo, path, source, case when r = b then r else replace(regexp_replace(b, '/+$', '') || case when starts_with(r, '/') then r else '/' || r end, '//', '/') end, 'implements_route' from (
      select repo, path, source, regexp_extract(text, '@RequestMapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)"', 1) as b,
             unnest(case when regexp_matches(text, '@(?:Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*)?"[^"]+"') then regexp_extract_all(text, '@(?:Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)"', 1)
                         when regexp_matches(text, '@RequestMapping\s*\(\s*(?:value\s*=\s*)?"[^"]+"') then [''] else [] end) as r from f where contains(text, '@RestController')))
  where source <> '' and not (edge_type = 'imports' and target = source))
"""
_EDGES = _NODE.rstrip() + "," + LINKS_SQL.rstrip() + "," + _STRUCTURE.replace("f as (", "sf as (").replace("from f", "from sf").replace("edges as (", "structure as (").rstrip() + """,
tests as (
  select distinct anchor_id, test_id from (select lower(symbol) as needle, max(id) as anchor_id from docs where kind = 'code_anchor' and symbol <> '' group by lower(symbol)) c
  join (select id as test_id, lower(coalesce(symbol, '') || ' ' || coalesce(path, '')) as h from docs where kind = 'test_anchor') t on contains(h, needle)),
edges as (
  select node as from_id, repo as to_id, 'belongs_to_service' as type from shown where repo <> ''
  union select node, owner_node, 'owned_by' from shown where owner_node is not null
  union select * from (select node, unnest(known_gap_ids) as g, 'mentions_gap' from shown) where g is not null
  union select a.node, b.node, 'implemented_by' from (select node, unnest(code_anchors) as r from docs) a join docs b on b.id = a.r
  union select a.node, b.node, 'relates_to' from (select node, unnest(related_contracts) as r from docs) a join docs b on b.external_id = a.r and b.external_id <> ''
  union select c.node, t.node, 'tested_by' from tests join docs c on c.id = anchor_id join docs t on t.id = test_id
  union select source, target, edge_type from structure where target <> ''
  union select source, target, link_type from elinks where source <> '' and target <> '')
"""
_POLICY = r"""
p as (select distinct repo, regexp_replace(replace(path, '\', '/'), '^[./]+', '') as path from path_decisions),
i as (select *, case when regexp_matches(path, '(?s)^src/.*$') then 'src/**' when regexp_matches(path, '(?s)^internal/.*$') then 'internal/**' when regexp_matches(path, '(?s)^docs/.*$') then 'docs/**' when regexp_matches(path, '(?s)^web/.*$') then 'web/**' end as inc,
     case when regexp_matches(path, '(?s)^(.*/)?legacy/.*$') then '**/legacy/**' when regexp_matches(path, '(?s)^tools/.*$') then 'tools/**' when regexp_matches(path, '(?s)^web/.*$') then 'web/**' end as exc,
     case when regexp_matches(path, '(^|/)[^/]*\.log(/|$)') then '*.log' when regexp_matches(path, '(^|/)node_modules(/|$)') then 'node_modules/' when regexp_matches(path, '(^|/)target(/|$)') then 'target/'
          when regexp_matches(path, '(^|/)build(/|$)') then 'build/' when regexp_matches(path, '(^|/)[^/]*\.min\.js(/|$)') then '*.min.js' end as ign from p),
d as (select *, case when path is null then 'no_path' when inc is null then 'not_included' when exc is not null then 'excluded' when ign is not null then 'ignored' else 'allowed' end as reason from i)
"""
_MODIFIERS = r"(?:(?:public|protected|private|final|abstract|sealed|non-sealed|open|data|static)\s+)*(class|interface|enum|record|object)\s+"
_CLASS, _NESTED = r"^(?:export\s+)?(?:default\s+)?" + _MODIFIERS + r"([A-Z]\w*)", r"^\s*" + _MODIFIERS + r"([A-Za-z]\w*)"
_TYPE, _FUNC, _EXPORT = r"^type\s+([A-Z]\w*)\s+(?:struct|interface)\b", r"^func\s+([A-Z]\w*)\s*\(", r"\bexport\s+(?:async\s+)?(?:function|const|type)\s+([A-Za-z]\w*)"
_EXPORTED_TYPE = r"\bexport\s+(?:default\s+)?" + _MODIFIERS + r"([A-Za-z]\w*)"

_TAKEN = " ".join(
    f"when regexp_matches(path, '{pattern.replace('(?!(?:' + W._SKIP_BESIDE + ')/)', '').replace(chr(39), chr(39) * 2)}')"
    + (f" and not regexp_matches(path, '{left}')" if left else "") + (f" and not regexp_matches(path, '^({W._SKIP_BESIDE})/')" if name == "script" else "")
    + (" and len(list_filter([" + ", ".join(repr(h) for h in W.JAVA_HINTS) + "], lambda h: contains(lower('/' || path), h))) > 0" if name == "java" else "") + f" then '{name}'"
    for name, (pattern, left) in W.RULES.items()
)
_SYMBOLS = rf"""
f as (select distinct repo, path, text, coalesce(lower(nullif(language, '')), case when regexp_matches(path, '(?i)\.(java|kts?)$') then 'java' when regexp_matches(path, '(?i)\.[cm]?[jt]sx?$') then 'typescript' else '' end) as language from source_files where text is not null),
l as (select repo, path, language in ('java', 'kotlin') as nested, language in ('typescript', 'javascript') as script, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from f),
lead as (
  select repo, path, line, regexp_extract(l, '{_CLASS}', 2) as symbol, regexp_extract(l, '{_CLASS}', 1) as symbol_kind from l where regexp_matches(l, '{_CLASS}')
  union all select repo, path, line, regexp_extract(l, '{_NESTED}', 2), regexp_extract(l, '{_NESTED}', 1) from l where nested and regexp_matches(l, '{_NESTED}') and not regexp_matches(l, '{_CLASS}')
  union all select repo, path, line, regexp_extract(l, '{_TYPE}', 1), 'type' from l where regexp_matches(l, '{_TYPE}')
  union all select repo, path, line, regexp_extract(l, '{_FUNC}', 1), 'function' from l where regexp_matches(l, '{_FUNC}')
  union all select repo, path, line, regexp_extract(l, '^{_EXPORT[2:]}', 1), 'export' from l where regexp_matches(l, '^{_EXPORT[2:]}')),
anywhere as (
  select repo, path, line, unnest(regexp_extract_all(l, '{_EXPORT}', 1)) as symbol, 'export' as symbol_kind from l where script
  union all select repo, path, line, unnest(regexp_extract_all(l, '{_EXPORTED_TYPE}', 2)), unnest(regexp_extract_all(l, '{_EXPORTED_TYPE}', 1)) from l where script),
symbols as (select repo, path, symbol, symbol_kind, line from lead union select repo, path, symbol, symbol_kind, line from anywhere)
"""

ORACLE = {
    "file_explanations": "with " + _POLICY.replace("from path_decisions", "from source_files") + f""",
c as (select repo, path, reason, case {_TAKEN} end as collector from d)
select repo, path, reason = 'allowed' as allowed, case when reason <> 'allowed' then reason when collector is null then 'no_collector' else 'indexed' end as reason, collector, reason = 'allowed' and collector is not null as indexed from c""",
    "symbol_excerpts": "with " + _SYMBOLS.rstrip() + r""",
ls as (select repo, path, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) as t, unnest(range(1, len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) + 1)) as n from (select distinct repo, path, text from source_files where text is not null)),
ex as (select s.*, ls.t, ls.n, coalesce(sum(strlen(ls.t) + 1) over (partition by s.repo, s.path, s.symbol, s.symbol_kind, s.line order by ls.n rows between unbounded preceding and 1 preceding), 0) as used
       from symbols s join ls on ls.repo is not distinct from s.repo and ls.path = s.path and ls.n >= s.line)
select repo, path, symbol, symbol_kind, line as line_start, max(n) as line_end, md5(string_agg(t, chr(10) order by n)) as digest from ex where used < 8192 group by repo, path, symbol, symbol_kind, line""",
    "domain_phrases": r"""
with d as (select distinct id, owner, title, external_id from manifest_docs),
w as (select id, coalesce(owner."domain", '') as p from d union select id, unnest(list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(external_id, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)) from d)
select id, string_agg(distinct p, ' ' order by p) as phrases, count(distinct p) as n_phrases from w where p <> '' group by id""",
    "workspace_status": """
with m as (select distinct id, repo, kind, owner, symbol, known_gap_ids, code_anchors, related_doc_ids, trust_level, removed_at, indexed_at from manifest_docs),
c as (select distinct chunk_id, doc_id, text from chunks where chunk_id is not null), h as (select distinct hit_id, stale, chunks_missing from search_hits),
b as (select * from (select distinct build_id, repo, built_at, unresolved_symbols, contract_symbols_unresolved_total from crosslink_stats) qualify row_number() over (partition by repo order by built_at desc, build_id desc) = 1),
v as (
  select 'records' as metric, count(*) as value from m union all select 'removed', count(removed_at) from m union all select 'documents', count(*) from m where kind not in ('code_anchor', 'test_anchor', 'openapi_spec')
  union all select 'code_anchors', count(*) from m where kind = 'code_anchor' union all select 'test_anchors', count(*) from m where kind = 'test_anchor' union all select 'openapi_specs', count(*) from m where kind = 'openapi_spec'
  union all select 'contracts', count(*) from m where kind = 'contract' union all select 'decisions', count(*) from m where kind = 'adr' union all select 'repos', count(distinct repo) from m union all select 'owned', count(owner) from m
  union all select 'trusted', count(*) from m where trust_level in ('confirmed', 'accepted', 'implementation') union all select 'contracts_with_anchors', count(*) from m where kind = 'contract' and len(list_filter(code_anchors, lambda x: x is not null)) > 0
  union all select 'anchors_with_documents', count(*) from m where kind = 'code_anchor' and len(list_filter(related_doc_ids, lambda x: x is not null)) > 0 union all select 'gap_mentions', coalesce(sum(len(list_filter(known_gap_ids, lambda x: x is not null))), 0) from m
  union all select 'gaps', count(distinct g) from (select unnest(known_gap_ids) as g from m) union all select 'symbols', count(distinct symbol) from m where kind = 'code_anchor'
  union all select 'chunks', count(*) from c union all select 'chunked_documents', count(distinct doc_id) from c union all select 'empty_chunks', count(*) from c where coalesce(text, '') = '' union all select 'chunk_characters', coalesce(sum(length(text)), 0) from c
  union all select 'hits', count(*) from h union all select 'stale_hits', count(*) from h where stale union all select 'hits_without_chunks', count(*) from h where chunks_missing
  union all select 'unresolved_total', coalesce(sum(contract_symbols_unresolved_total), 0) from b union all select 'unresolved_symbols', count(distinct s) from (select unnest(unresolved_symbols) as s from b)
  union all select 'builds', count(*) from b)
select metric, cast(value as bigint) as value from v""",
    "contract_reciprocity": """
with a as (select distinct external_id from manifest_docs where external_id <> ''), b as (select distinct external_id from (select unnest(related_contracts) as external_id from manifest_docs) where external_id <> '')
select external_id, 'left' as only_in from a where external_id not in (select external_id from b) union all select external_id, 'right' from b where external_id not in (select external_id from a)""",
    "outlines": "with " + _BODY + rf"""
, h as (select *, coalesce(nullif(trim(regexp_extract(body, '(?m)^#[ \t]+(\S.*)$', 1)), ''), title, '') as name from b)
select doc_id, name as title,
       array_to_string(list_slice(list_transform(regexp_extract_all(body, '(?m)^#{{1,3}}[ \t]+(\S.*)$', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), 1, 20), ' | ') as headings,
       array_to_string(list_slice((select list(w order by pos) from (select w, min(pos) as pos from (
           select unnest([lower(trim(coalesce(repo, ''))), lower(trim(coalesce(kind, '')))] || list_transform(regexp_split_to_array(name, '[^a-zA-Z0-9]+'), lambda x: lower(x))) as w,
                  unnest(range(0, 2 + len(regexp_split_to_array(name, '[^a-zA-Z0-9]+')))) as pos) where length(w) >= 2 group by w)), 1, 30), ' ') as keywords,
       array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(body, '[\p{{Lo}}\p{{Lm}}\p{{Lt}}\p{{Cyrillic}}\p{{Greek}}\x{{C0}}-\x{{24F}}\x{{FF10}}-\x{{FF5A}}\x{{1D400}}-\x{{1D7FF}}]', 'x', 'g'), '{X.GAP_ID[4:]}'), lambda x: not starts_with(x, 'ADR-') and not contains(x, '-CONTRACT-')))), ' ') as gap_ids,
       nullif(trim(regexp_extract(block, '(?m)^id[ \t]*:(.*)$', 1)), '') as external_id, nullif(trim(regexp_extract(block, '(?m)^status[ \t]*:(.*)$', 1)), '') as status
from h""",
    "doc_sections": "with " + _SECTIONS + "select doc_id, section_no, heading, length(section) as chars from sections",
    "packed_chunks": "with recursive " + _SECTIONS.rstrip() + r""",
pg as (select doc_id, section_no, section, unnest(pars) as p, unnest(range(1, len(pars) + 1)) as i from (
  select doc_id, section_no, section, list_filter(list_transform(string_split(section, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\A\\s+', ''), '\\s+\\z', '')), lambda x: x <> '') as pars
  from sections where strlen(section) > 2048)),
walk as (
  select doc_id, section_no, i, 0 as part_no, strlen(p) as n from pg where i = 1
  union all
  select pg.doc_id, pg.section_no, pg.i, case when w.n + strlen(pg.p) + 2 <= 2048 then w.part_no else w.part_no + 1 end, case when w.n + strlen(pg.p) + 2 <= 2048 then w.n + strlen(pg.p) + 2 else strlen(pg.p) end
  from walk w join pg on pg.doc_id = w.doc_id and pg.section_no = w.section_no and pg.i = w.i + 1),
ch as (
  select doc_id, section_no, part_no, string_agg(p, chr(10) || chr(10) order by i) as chunk from walk join pg using (doc_id, section_no, i) group by doc_id, section_no, part_no
  union all select doc_id, section_no, 0, section from sections where strlen(section) <= 2048)
select doc_id, section_no, part_no, strlen(chunk) as n_bytes, md5(chunk) as digest from ch""",
    "inline_links": r"""
with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z)', '', 'g'), '`[^`\n]*`', ' ', 'g') as b from documents),
l as (select distinct doc_id, target from (select doc_id, unnest(regexp_extract_all(b, '(?:^|[^!])\[[^\]\n]+\]\(([^)\n]+)\)', 1)) as target from t))
select doc_id, target, case when regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//)') then 'external' when starts_with(target, '#') then 'anchor' else 'local' end as link_class from l""",
    "code_symbols": "with " + _SYMBOLS + "select repo, path, symbol, symbol_kind, line from symbols",
    "code_imports": r"""
with f as (select distinct repo, path, text from source_files where text is not null)
select distinct repo, path, target from (
  select repo, path, list_extract(string_split(m, '.'), -1) as target from (select repo, path, unnest(regexp_extract_all(text, '(?m)^import\s+(?:static\s+)?([\w.]+);', 1)) as m from f)
  union all
  select repo, path, list_extract(string_split(m, '/'), -1) from (select repo, path, unnest(regexp_extract_all(text, '(?m)^import\s+[^''"\n]*[''"]([^''"\n]+)[''"]', 1)) as m from f))
where target <> ''""",
    "graph_nodes": "with " + _NODE.rstrip() + "," + _STRUCTURE + """
, a as (
  select 0 as o, node as id, kind as type, coalesce(nullif(title, ''), nullif(symbol, ''), node) as label from shown
  union all select 1, repo, 'service', repo from shown where repo <> ''
  union all select 2, owner_node, 'owner', coalesce(nullif(owner.team, ''), owner_node) from shown where owner_node is not null
  union all select 3, g, 'known_gap', g from (select unnest(known_gap_ids) as g from shown) where g <> ''
  union all select 4, e, 'structural', e from (select source as e from edges union select target from edges) where e <> '')
select id, type, label from a qualify row_number() over (partition by id order by o, type, label) = 1""",
    "graph_edges": "with " + _EDGES + "select from_id, to_id, type from edges",
    "graph_degrees": "with " + _EDGES + """
select id, type, cast(sum(o) as bigint) as outgoing, cast(sum(i) as bigint) as incoming
from (select from_id as id, type, 1 as o, 0 as i from edges union all select to_id, type, 0, 1 from edges) group by id, type""",
    "structural_edges": "with " + _STRUCTURE + "select repo, path, source, target, edge_type from edges",
    "orientation": "with " + _STRUCTURE + """
select repo, edge_type, place, source, target from (select *, row_number() over (partition by repo, edge_type order by source, target, path) as place from edges) where place <= 40""",
    "class_services": "with " + _STRUCTURE + """
select repo, source, string_agg(target, ',' order by target) as services from (select distinct repo, source, target from edges where edge_type = 'uses_service') group by repo, source""",
    "path_history": """
with r as (select *, row_number() over (partition by repo, path order by decided_at desc, decision_id desc) as r
           from (select distinct repo, path, decision_id, decided_at from path_decisions where path is not null and decided_at is not null)),
e as (select repo, path, max_by(decision_id, r) as a, min_by(decision_id, r) as b, count(*) as n from r where r <= 5 group by repo, path)
select repo, path, 'introduced_in' as link_type, a as decision_id from e union all select repo, path, 'modified_by', b from e where n > 1""",
    "lint_violations": f"""
with d as (select distinct id, repo, kind, external_id, status, owner, symbol, known_gap_ids, related_contracts, related_anchors from manifest_docs),
n as (select id, external_id as value from d where external_id <> ''), g as (select id, kind, unnest(known_gap_ids) as value from d)
select distinct "check", id, value from (
  select 'missing_id' as "check", id, '' as value from d where kind in ('contract', 'adr') and trim(coalesce(external_id, '')) = ''
  union all select 'missing_owner', id, '' from d where kind in ('contract', 'adr') and owner is null
  union all select 'missing_team', id, '' from d where kind in ('contract', 'adr') and owner is not null and trim(coalesce(owner.team, '')) = ''
  union all select 'missing_service', id, '' from d where kind in ('contract', 'adr') and owner is not null and trim(coalesce(owner.service, '')) = ''
  union all select 'bad_status', id, lower(trim(coalesce(status, ''))) from d where kind = 'adr' and lower(trim(coalesce(status, ''))) not in ({", ".join(repr(s) for s in I.ADR_STATES)})
  union all select 'duplicate_id', id, value from n where value in (select value from n group by value having count(*) > 1)
  union all select 'repeated_gap', id, value from g where kind = 'known_gaps' and value in (select value from g where kind = 'known_gaps' and value is not null group by value having count(*) > 1)
  union all select 'id_is_gap', id, value from n where value in (select value from g where value is not null)
  union all select 'unknown_contract', id, value from (select id, unnest(related_contracts) as value from d) where value is not null and value not in (select value from n)
  union all select 'unknown_anchor', id, value from (select id, unnest(related_anchors) as value from d) where value is not null and split_part(trim(value), '.', 1) not in (select symbol from d where kind in ('code_anchor', 'test_anchor') and symbol <> ''))""",
    "build_changes": """
with r as (select distinct build_id, repo, built_at, list_distinct(list_filter(coalesce(unresolved_symbols, []), lambda x: x is not null and trim(x) <> '')) as now from (
             select distinct build_id, repo, built_at, unresolved_symbols from crosslink_stats)),
l as (select *, coalesce(lag(now) over (partition by repo order by built_at, build_id), []) as bef from r)
select repo, build_id, len(list_filter(now, lambda x: not list_contains(bef, x))) as appeared, len(list_filter(bef, lambda x: not list_contains(now, x))) as resolved from l""",
    "kind_counts": """
select kind, repo, count(*) as records, count(removed_at) as removed, cast(grouping(kind, repo) as bigint) as level
from (select distinct id, kind, repo, removed_at from manifest_docs) group by rollup (kind, repo)""",
    "index_status": """
with d as (select distinct id, repo, kind, known_gap_ids, indexed_at from manifest_docs),
a as (select repo, count(*) as records, count(*) filter (kind = 'code_anchor') as code_anchors, count(*) filter (kind = 'test_anchor') as test_anchors,
             count(*) filter (id not in (select doc_id from chunks where doc_id is not null)) as without_chunks,
             cast(sum(len(list_filter(coalesce(known_gap_ids, []), lambda x: x is not null))) as bigint) as gap_mentions, max(indexed_at) as built from d group by repo),
h as (select *, round_even((epoch_us((select max(indexed_at) from d)) - epoch_us(built)) / 3.6e9, 2) as age_hours from a)
select repo, records, code_anchors, test_anchors, without_chunks, gap_mentions, age_hours, without_chunks > 0 or age_hours > 48 as rebuild from h""",
    "owners": """
select coalesce(owner.team, '') as team, coalesce(owner.service, '') as service, coalesce(owner."domain", '') as "domain", coalesce(owner.contact, '') as contact, count(*) as records
from (select distinct id, owner from manifest_docs where owner is not null) group by all""",
    "services": """
select service, count(*) as records from (select coalesce(nullif(owner.service, ''), nullif(repo, '')) as service from (select distinct id, repo, owner from manifest_docs)) where service is not null group by service""",
    "trust_differences": f"""
with d as (select distinct id, kind, status, source_type, trust_level, weight, lower(trim(coalesce(status, ''))) as s from manifest_docs),
e as (select id, source_type, trust_level, weight, case kind {" ".join(f"when '{k}' then '{s}'" for k, (s, _) in I.KIND_SOURCE.items())} else 'contract' end as expected_source,
  case when kind in ('contract', 'request_flow', 'frontend_contract', 'backend_contract', 'adr') and s in ('draft', 'proposed') then 'draft'
       when kind in ('contract', 'request_flow', 'frontend_contract', 'backend_contract') and s in ('confirmed', 'active', 'approved') then 'confirmed'
       when kind = 'adr' and s in ('accepted', 'approved') then 'accepted'
       else case kind {" ".join(f"when '{k}' then '{t}'" for k, (_, t) in I.KIND_SOURCE.items())} else 'confirmed' end end as expected_trust,
  {sql_lookup(KIND_WEIGHT, "coalesce(kind, '')", 55)} as expected_weight from d)
select * from e where source_type is distinct from expected_source or trust_level is distinct from expected_trust or weight is distinct from expected_weight""",
    "policy_decisions": "with " + _POLICY + """
select repo, path, reason = 'allowed' as allowed, reason, inc as matched_include, case when reason = 'excluded' then exc end as matched_exclude, case when reason = 'ignored' then ign end as matched_ignore from d""",
    "policy_counts": "with " + _POLICY + "select repo, reason, count(*) as paths from d group by repo, reason",
}
