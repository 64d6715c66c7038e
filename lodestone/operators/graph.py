"""Nodes and edges of the record graph, structural edges of source code, history of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.links import tested_by

# Kinds that become nodes; decisions that count as a path's history.
NODE_KINDS = ["contract", "adr", "known_gaps", "code_anchor", "test_anchor"]
HISTORY = 5

COLUMNS = ["id", "repo", "path", "kind", "title", "symbol", "external_id", "owner", "known_gap_ids", "code_anchors", "related_contracts"]


def _docs(manifest: DataFrame) -> DataFrame:
    docs = manifest.select(*COLUMNS).distinct()
    owner = F.coalesce(F.nullif("owner.team", F.lit("")), F.nullif("owner.contact", F.lit("")), F.nullif("owner.service", F.lit("")))
    return docs.withColumn("node", F.coalesce(F.nullif("external_id", F.lit("")), "id")).withColumn("owner_node", F.when(F.col("owner").isNotNull(), F.concat(F.lit("owner:"), F.coalesce(owner, F.lit("None")))))


def nodes(manifest: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """(id, type, label), one per id: records first (the least type and label), then services, owners, gaps and ends of structural edges."""
    docs = _docs(manifest).where(F.col("kind").isin(*NODE_KINDS))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = [
        docs.select(F.lit(0).alias("o"), F.col("node").alias("id"), F.col("kind").alias("type"), F.coalesce(empty("title"), empty("symbol"), "node").alias("label")),
        docs.where("repo <> ''").select(F.lit(1), "repo", F.lit("service"), "repo"),
        docs.where("owner_node is not null").select(F.lit(2), "owner_node", F.lit("owner"), F.coalesce(empty("owner.team"), "owner_node")),
        docs.select(F.explode(X.strings(F.col("known_gap_ids"))).alias("g")).where("g <> ''").select(F.lit(3), "g", F.lit("known_gap"), "g"),
    ]
    if structure is not None:
        ends = structure.select(F.explode(F.array("source", "target")).alias("n")).where("n <> ''").distinct()
        parts.append(ends.select(F.lit(4), "n", F.lit("structural"), "n"))
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.groupBy("id").agg(F.min(F.struct("o", "type", "label")).alias("m")).select("id", "m.type", "m.label")


def edges(manifest: DataFrame, structure: DataFrame | None = None, evolution: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, type), distinct: edges of the records and, where given, structural edges and evolution links."""
    docs = _docs(manifest)
    shown = docs.where(F.col("kind").isin(*NODE_KINDS))
    names = docs.select(F.col("id").alias("_id"), F.col("node").alias("to_id"))
    by_external = docs.where("external_id <> ''").select(F.col("external_id").alias("_ref"), F.col("node").alias("to_id")).distinct()
    implemented = docs.select(F.col("node").alias("from_id"), F.explode(X.strings(F.col("code_anchors"))).alias("_id")).join(names, "_id").select("from_id", "to_id", F.lit("implemented_by").alias("type"))
    related = docs.select(F.col("node").alias("from_id"), F.explode(X.strings(F.col("related_contracts"))).alias("_ref")).join(by_external, "_ref").select("from_id", "to_id", F.lit("relates_to").alias("type"))
    tests = tested_by(manifest)
    tested = tests.join(names.select(F.col("_id").alias("anchor_id"), F.col("to_id").alias("from_id")), "anchor_id").join(names.select(F.col("_id").alias("test_id"), "to_id"), "test_id").select("from_id", "to_id", F.lit("tested_by").alias("type"))
    parts = [
        shown.where("repo <> ''").select(F.col("node").alias("from_id"), F.col("repo").alias("to_id"), F.lit("belongs_to_service").alias("type")),
        shown.where("owner_node is not null").select("node", "owner_node", F.lit("owned_by")),
        shown.select("node", F.explode(X.strings(F.col("known_gap_ids"))).alias("g"), F.lit("mentions_gap")),
        implemented, related, tested,
    ]
    if structure is not None:
        parts.append(structure.where("source <> '' and target <> ''").select("source", "target", "edge_type"))
    if evolution is not None:
        parts.append(evolution.where("source <> '' and target <> ''").select("source", "target", "link_type"))
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union.distinct()


def degrees(all_edges: DataFrame) -> DataFrame:
    """(id, type, outgoing, incoming)."""
    out = all_edges.groupBy(F.col("from_id").alias("id"), "type").agg(F.count("*").alias("n")).select("id", "type", F.col("n").alias("outgoing"), F.lit(0).alias("incoming"))
    into = all_edges.groupBy(F.col("to_id").alias("id"), "type").agg(F.count("*").alias("n")).select("id", "type", F.lit(0).alias("outgoing"), F.col("n").alias("incoming"))
    return out.unionByName(into).groupBy("id", "type").agg(F.sum("outgoing").cast("bigint").alias("outgoing"), F.sum("incoming").cast("bigint").alias("incoming"))


# Languages whose classes are found at any depth, and those whose exports are found anywhere in a line.
NESTED_CLASSES, NESTED_EXPORTS = ["java", "kotlin"], ["typescript", "javascript"]
_TYPE_KEYWORD = r"(?:(?:public|protected|private|final|abstract|sealed|non-sealed|open|data|static)\s+)*(class|interface|enum|record|object)\s+"
_TYPE_WORDS, _ANY_TYPE_WORDS = _TYPE_KEYWORD + r"([A-Z]\w*)", _TYPE_KEYWORD + r"([A-Za-z]\w*)"
_EXPORTED = r"export\s+(?:async\s+)?(?:function|const|type)\s+([A-Za-z]\w*)"


def code_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, symbol, symbol_kind, line): types and exported functions that source files define.

    Lines count from 1.  Classes of Java, Kotlin, TypeScript, JavaScript and Python, Go types and
    exported functions, exported functions of scripts; names with a leading underscore are private.
    Java's and Kotlin's classes may be indented and small, and exports of scripts stand anywhere in
    a line, each of several counts; all else begins its line.  Without language the path's ending tells it.
    """
    language = F.coalesce(F.lower(F.nullif("language", F.lit(""))), F.when(F.col("path").rlike(r"(?i)\.(java|kts?)$"), NESTED_CLASSES[0]).when(F.col("path").rlike(r"(?i)\.[cm]?[jt]sx?$"), NESTED_EXPORTS[0]), F.lit(""))
    rows = files.where("text is not null").select("repo", "path", "language", "text").distinct()
    lines = rows.select("repo", "path", language.isin(*NESTED_CLASSES).alias("nested"), language.isin(*NESTED_EXPORTS).alias("script"), F.posexplode(F.split("text", "\n")).alias("n", "l"))
    a_class = r"^(?:export\s+)?(?:default\s+)?" + _TYPE_WORDS
    indented = r"^\s*" + _ANY_TYPE_WORDS
    a_type = r"^type\s+([A-Z]\w*)\s+(?:struct|interface)\b"
    a_func = r"^func\s+([A-Z]\w*)\s*\("
    exported = "^" + _EXPORTED
    take = lambda pattern, group: F.regexp_extract("l", pattern, group)
    found = lambda kind, name: F.array(F.struct(kind.alias("symbol_kind"), name.alias("symbol")))
    none = F.array().cast("array<struct<symbol_kind:string,symbol:string>>")
    first = (
        F.when(F.col("l").rlike(a_class), found(take(a_class, 1), take(a_class, 2))).when(F.col("nested") & F.col("l").rlike(indented), found(take(indented, 1), take(indented, 2)))
        .when(F.col("l").rlike(a_type), found(F.lit("type"), take(a_type, 1))).when(F.col("l").rlike(a_func), found(F.lit("function"), take(a_func, 1))).when(F.col("l").rlike(exported), found(F.lit("export"), take(exported, 1)))
        .otherwise(none)
    )
    every = lambda pattern, group: F.regexp_extract_all("l", F.lit(pattern), F.lit(group))
    types = r"\bexport\s+(?:default\s+)?" + _ANY_TYPE_WORDS
    others = F.transform(every(r"\b" + _EXPORTED, 1), lambda name: F.struct(F.lit("export").alias("symbol_kind"), name.alias("symbol")))
    anywhere = F.concat(F.zip_with(every(types, 1), every(types, 2), lambda kind, name: F.struct(kind.alias("symbol_kind"), name.alias("symbol"))), others)
    symbols = F.array_distinct(F.concat(first, F.when(F.col("script") & F.contains(F.col("l"), F.lit("export")), anywhere).otherwise(none)))
    return lines.select("repo", "path", F.explode(symbols).alias("s"), "n").select("repo", "path", "s.symbol", "s.symbol_kind", (F.col("n") + 1).alias("line"))


def imports(files: DataFrame) -> DataFrame:
    """(repo, path, target): what source files import, by the last part of its name; distinct."""
    rows = files.where("text is not null").select("repo", "path", "text").distinct()
    module = F.regexp_extract_all("text", F.lit(r"(?m)^import\s+(?:static\s+)?([\w.]+);"), F.lit(1))
    script = F.regexp_extract_all("text", F.lit(r"(?m)^import\s+[^'\"\n]*['\"]([^'\"\n]+)['\"]"), F.lit(1))
    each = rows.select("repo", "path", F.explode(F.array_distinct(F.concat(F.transform(module, lambda m: F.element_at(F.split(m, r"\."), -1)), F.transform(script, lambda m: F.element_at(F.split(m, "/"), -1))))).alias("target"))
    return each.where("target <> ''")


def path_history(decisions: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(repo, path, link_type, decision_id): the oldest and newest of the last ``keep`` decisions of a path.

    The oldest is ``introduced_in``, the newest ``modified_by`` where there are two or more.
    Decisions at the same time are in order of their ids.
    """
    rows = decisions.where("path is not null and decided_at is not null").select("repo", "path", "decision_id", "decided_at").distinct()
    newest = Window.partitionBy("repo", "path").orderBy(F.col("decided_at").desc(), F.col("decision_id").desc())
    last = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= keep)
    ends = last.groupBy("repo", "path").agg(F.max_by("decision_id", "_r").alias("introduced_in"), F.min_by("decision_id", "_r").alias("modified_by"), F.count("*").alias("n"))
    links = F.array(F.struct(F.lit("introduced_in").alias("link_type"), F.col("introduced_in").alias("decision_id")), F.struct(F.when(F.col("n") > 1, "modified_by").alias("link_type"), F.col("modified_by").alias("decision_id")))
    return ends.select("repo", "path", F.explode(links).alias("l")).select("repo", "path", "l.link_type", "l.decision_id").where("link_type is not null")


# How classes, imports, routes and injected fields are written.
_CLASS = r"(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"
_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;"
_BASE_ROUTE = r'@RequestMapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'
_ROUTE = r'@(?:Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'
_FIELD = r"(?:private\s+final|@Autowired\s+private)\s+(\w+{0}\w*)\s+\w+;"


# The file that holds the routes of a web application, a route with its component, an import of a page.
_ROUTES_FILE = r"(^|/)main\.tsx$"
_ROUTE_ELEMENT = r"""<Route\s+[^>]*path=["']([^"']+)["'][^>]*element=\{<(\w+)\s*/>\}"""
_PAGE_IMPORT = r"""from\s+['"]@/pages/([^'"]*)['"]"""


def route_edges(files: DataFrame) -> DataFrame:
    """(repo, path, source, target, edge_type) of web applications: routes that components serve, pages that the file imports; distinct."""
    rows = files.where(F.col("path").rlike(_ROUTES_FILE) & F.col("text").isNotNull()).select("repo", "path", "text").distinct()
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    edge = lambda kind, source, target: F.struct(F.lit(kind).alias("edge_type"), source.alias("source"), target.alias("target"))
    routes = F.zip_with(found(_ROUTE_ELEMENT, 1), found(_ROUTE_ELEMENT, 2), lambda route, component: edge("implements_route", component, route))
    pages = F.transform(found(_PAGE_IMPORT, 1), lambda page: edge("imports", F.lit("main"), F.element_at(F.split(page, "/"), -1)))
    return rows.select("repo", "path", F.explode(F.concat(routes, pages)).alias("e")).select("repo", "path", "e.source", "e.target", "e.edge_type").distinct()


def structural_edges(files: DataFrame) -> DataFrame:
    """(repo, path, source, target, edge_type): what the first class of each Java file imports, serves and uses, and ``route_edges``; distinct.

    Types: imports (by simple name, not itself), implements_route (of a class marked as REST
    controller), uses_service and uses_repository (by injected fields).
    """
    rows = files.where(F.col("path").endswith(".java") & F.col("text").isNotNull()).select("repo", "path", "text").distinct().withColumn("source", F.regexp_extract("text", _CLASS, 1)).where("source <> ''")
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    typed = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("edge_type"), v.alias("target")))
    base = F.regexp_replace(F.regexp_extract("text", _BASE_ROUTE, 1), "/+$", "")
    whole = F.regexp_extract("text", _BASE_ROUTE, 1)
    routes = F.when(F.size(found(_ROUTE)) > 0, found(_ROUTE)).when(whole != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    full = F.transform(routes, lambda r: F.when(r == whole, r).otherwise(F.replace(F.concat(base, F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))), F.lit("//"), F.lit("/"))))
    served = F.when(F.contains(F.col("text"), F.lit("@RestController")), full).otherwise(F.array().cast("array<string>"))
    edges_ = F.concat(
        typed("imports", F.filter(F.transform(found(_IMPORT), lambda m: F.element_at(F.split(m, r"\."), -1)), lambda m: m != F.col("source"))), typed("implements_route", served),
        typed("uses_service", found(_FIELD.format("Service"))), typed("uses_repository", found(_FIELD.format("Repository"))),
    )
    return rows.select("repo", "path", "source", F.explode(F.array_distinct(edges_)).alias("e")).select("repo", "path", "source", "e.target", "e.edge_type").distinct().unionByName(route_edges(files))


def orientation(structure: DataFrame, per_type: int = 40) -> DataFrame:
    """(repo, edge_type, place, source, target): the first edges of each type of a repository by source, target and path."""
    order = Window.partitionBy("repo", "edge_type").orderBy("source", "target", "path")
    return structure.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_type).select("repo", "edge_type", "place", "source", "target")


def services_of_controllers(structure: DataFrame) -> DataFrame:
    """(repo, source, services): services that each class uses, sorted and joined by commas."""
    uses = structure.where("edge_type = 'uses_service'").select("repo", "source", "target").distinct()
    return uses.groupBy("repo", "source").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("services"))  # fields of one class
