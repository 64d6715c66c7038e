"""Records and chunks from the files of a workspace, as distributed scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.globs import Policy, decided
from lodestone.operators import extraction as E
from lodestone.operators.integrity import trust
from lodestone.operators.links import crosslinks, mentions, unresolved
from lodestone.sources import collectors as C
from lodestone.vocab import KIND_WEIGHT, lookup

# File names that tell the kind of a document; folders of decisions and contracts.
KIND_OF_NAME = {
    "agents.md": "agents", "known-gaps.md": "known_gaps", "architecture.md": "architecture", "integrations.md": "integrations", "request-flow.md": "request_flow",
    "frontend-contract.md": "frontend_contract", "backend-contract.md": "backend_contract", "to-validate.md": "to_validate", "touchpoints.md": "touchpoint",
}
DECISION_FOLDER, CONTRACT_FOLDER = r"(^|/)docs/adrs?/", r"(^docs/|/)contracts/"
# Kinds without a domain; names and folders that tell an anchor's type, first match.
NO_DOMAIN = ["agents", "openapi_spec", "workspace_doc", "doc"]
ANCHOR_TYPES = [
    (r"(?i)controller", r"/controllers?/", "controller"), (r"ServiceImpl$", None, "service_impl"), (r"Service$", None, "service"), (r"Repository$", r"/(repository|repositories|jooq)/", "repository"),
    (r"Client$", None, "client"), (r"(Filter|Guard)$", r"/security/", "filter"), (r"Mapper$", r"/mapper/", "mapper"), (r"(?i)specification", r"/specification/", "specification"),
    (r"(Resolver|Helper|Limiter)$", None, "support"), (r"Context$", r"/multitenancy/", "multitenancy"), (r"(?i)config", r"/config/", "config"), (r"^$", r"/(entity|entities)/", "entity"),
]


def files(spark: SparkSession, root: str, pattern: str = "*", policy: Policy | None = None) -> DataFrame:
    """(repo, path, text, content_hash, n_bytes) of the files below ``root``; repo is its first folder.

    Paths are relative to ``root``.  A policy, if given, is a filter on the files' paths alone, so
    Spark applies it when it lists the files and never opens those it denies.  Bytes that are no
    UTF-8 become replacement marks.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    clean = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")

    def parts(path: Column) -> tuple[Column, Column]:
        relative = F.element_at(F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), rf"\Q{clean}\E/", 2), -1)
        return F.when(F.contains(relative, F.lit("/")), F.split(relative, "/")[0]).otherwise("."), F.regexp_replace(relative, r"^[^/]*/", "")

    if policy is not None:
        repo, path = parts(F.col("_metadata.file_path"))
        base = base.where(decided(path, repo, policy)["allowed"])
    repo, path = parts(F.col("path"))
    return base.select(repo.alias("repo"), path.alias("path"), F.decode("content", "UTF-8").alias("text"), X.content_hash(F.col("content")).alias("content_hash"), F.col("length").alias("n_bytes"))


def kind_of(path: Column, fallback: str = "doc") -> Column:
    """Kind of a markdown file by its name, then by its folder."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    named = F.create_map(*(F.lit(x) for pair in KIND_OF_NAME.items() for x in pair))
    by_folder = F.when(low.rlike(DECISION_FOLDER), "adr").when(low.rlike(CONTRACT_FOLDER) & (name != "readme.md"), "contract").otherwise(fallback)
    return F.coalesce(F.try_element_at(named, name), by_folder)


def _document_id() -> Column:
    return F.concat(F.lit("doc:"), "repo", F.lit(":"), F.replace(F.translate("path", "/", ":"), F.lit(".md"), F.lit("")))


def document_records(markdown: DataFrame) -> DataFrame:
    """One record per markdown file with the columns that search, crosslinks and integrity use."""
    block, rest = E.front_matter(F.col("text")), E.body(F.col("text"))
    rows = markdown.withColumn("kind", kind_of(F.col("path"))).withColumn("_block", block).withColumn("_body", rest)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    domain = F.when(F.col("kind").isin(*NO_DOMAIN), F.lit(None)).when((F.col("kind") != "contract") & (F.lower(stem).isin("readme", *KIND_OF_NAME.values())), F.lit(None)).otherwise(stem)
    name = F.coalesce(E.meta_value(F.col("_block"), "title"), E.title(F.col("_body"), F.initcap(F.translate(stem, "-_", "  "))))
    status = E.meta_value(F.col("_block"), "status")
    source, level = trust(F.col("kind"), status)
    listed = lambda key: F.transform(F.regexp_extract_all(F.regexp_extract("_block", rf"(?m)^{key}:[ \t]*\n((?:[ \t]+- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]+- (.*)$"), F.lit(1)), F.trim)
    below = F.regexp_extract("_block", r"(?m)^owner:[ \t]*\n((?:[ \t]+\S.*\n?)+)", 1)
    of_owner = lambda key: F.nullif(X.stripped(F.regexp_extract(below, rf"(?m)^[ \t]+{key}[ \t]*:(.*)$", 1)), F.lit(""))
    owner = F.when(below != "", F.struct(*(of_owner(k).alias(k) for k in ("team", "service", "domain", "contact"))))
    return rows.withColumn("domain", domain).withColumn("title", name).select(
        _document_id().alias("id"),
        "repo", "path", "kind", "title", "domain", E.meta_value(F.col("_block"), "id").alias("external_id"), status.alias("status"),
        F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("anchor_type"), F.lit(None).cast("string").alias("language"),
        E.headings(F.col("_body")).alias("headings"), X.curated_keywords([F.col("repo"), F.col("kind"), F.col("domain")], [F.col("title"), E.meta_value(F.col("_block"), "id"), status], [owner["team"], owner["contact"]], [listed("related_anchors"), listed("related_contracts")]).alias("keywords"),
        X.gap_ids(F.col("_body")).alias("known_gap_ids"), listed("related_contracts").alias("related_contracts"), listed("related_anchors").alias("related_anchors"), owner.alias("owner"),
        lookup(KIND_WEIGHT, F.col("kind"), 55).alias("weight"), source.alias("source_type"), level.alias("trust_level"), "content_hash",
    )


def _typed_java() -> Column:
    """Type of a Java or Kotlin symbol by its name and folder, first match."""
    matches = lambda rule: F.col("symbol").rlike(rule[0]) | (F.lower(F.concat(F.lit("/"), "path")).rlike(rule[1]) if rule[1] else F.lit(False))
    return reduce(lambda out, rule: F.when(matches(rule), rule[2]).otherwise(out), reversed(ANCHOR_TYPES), F.lit("java_type"))


def code_anchors(code: DataFrame) -> DataFrame:
    """Anchors of code and test files with their ids, titles and excerpts; of several with one id the first line counts."""
    rows = C.anchors(code, _typed_java()).withColumn("id", F.concat(F.lit("anchor:"), "repo", F.lit(":"), "path", F.lit("#"), "symbol"))
    yaml = F.col("anchor_type") == "yaml_block"
    title = F.when(yaml, F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" \u2014 "), F.regexp_replace("symbol", "^application-", ""))).otherwise(F.concat("symbol", F.lit(" ("), "repo", F.lit(")")))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("line_start").asc_nulls_last(), "excerpt"))
    return rows.withColumn("title", title).withColumn("_n", first).where("_n = 1").drop("_n")


def anchor_records(code: DataFrame) -> DataFrame:
    """One record per anchor of code and test files, with the columns of document records and lines."""
    kind = F.when(F.col("anchor_type") == "test", "test_anchor").otherwise("code_anchor")
    none = F.array().cast("array<string>")
    return code_anchors(code).select(
        "id", "repo", "path", kind.alias("kind"), "title", "symbol", "anchor_type", "language", "line_start", "line_end", F.array("symbol").alias("headings"),
        X.curated_keywords([F.col("repo"), F.lit("code_anchor"), F.col("symbol"), F.col("anchor_type"), F.col("language")], [F.col("symbol")]).alias("keywords"), none.alias("known_gap_ids"),
        F.lit(KIND_WEIGHT["code_anchor"]).alias("weight"), kind.alias("source_type"), F.lit("implementation").alias("trust_level"),
    )


def openapi_records(found: DataFrame) -> DataFrame:
    """One record per interface description."""
    name = F.element_at(F.split("path", "/"), -1)
    none = F.array().cast("array<string>")
    return found.where(C.collector(F.col("path")) == "openapi").select(
        _document_id().alias("id"), "repo", "path", F.lit("openapi_spec").alias("kind"), name.alias("title"), none.alias("headings"), X.curated_keywords([F.col("repo"), F.lit("openapi_spec")], [name]).alias("keywords"),
        none.alias("known_gap_ids"), F.lit(KIND_WEIGHT["openapi_spec"]).alias("weight"), F.lit("openapi").alias("source_type"), F.lit("inferred").alias("trust_level"), "content_hash",
    )


def workspace_records(found: DataFrame) -> DataFrame:
    """Documents, interface descriptions and anchors of a workspace's files as one table; of equal ids the document counts."""
    documents = document_records(found.where(C.collector(F.col("path")) == "document"))
    union = documents.withColumn("_o", F.lit(0)).unionByName(openapi_records(found).withColumn("_o", F.lit(1)), True).unionByName(anchor_records(found).withColumn("_o", F.lit(2)), True)
    return union.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_o"))).where("_n = 1").drop("_n", "_o")


def workspace_chunks(found: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, title, heading, text): sections of documents, heads of interface descriptions, excerpts of anchors; numbered from 0."""
    markdown = found.where(C.collector(F.col("path")) == "document").select("repo", "path", "text")
    records = document_records(markdown.withColumn("content_hash", F.lit("")))
    bodies = markdown.select(_document_id().alias("id"), E.body(F.col("text")).alias("text"))
    packed = E.packed_sections(records.select("id", "kind", "title").join(bodies, "id").withColumnRenamed("id", "doc_id"))
    order = Window.partitionBy("doc_id").orderBy("section_no", "part_no")
    sections = packed.withColumn("_n", F.row_number().over(order) - 1).join(records.select(F.col("id").alias("doc_id"), "title"), "doc_id").select("doc_id", "_n", "title", "heading", F.col("chunk").alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    specs = found.where(C.collector(F.col("path")) == "openapi").select(_document_id().alias("doc_id"), F.lit(0).alias("_n"), name.alias("title"), name.alias("heading"), F.left("text", F.lit(C.EXCERPT_BYTES)).alias("text"))
    code = code_anchors(found).select(F.col("id").alias("doc_id"), F.lit(0).alias("_n"), "title", F.col("symbol").alias("heading"), X.stripped(F.col("excerpt")).alias("text"))
    union = sections.unionByName(specs).unionByName(code)
    return union.select(F.concat("doc_id", F.lit("#"), F.col("_n").cast("string")).alias("chunk_id"), "doc_id", "title", "heading", "text")


def workspace_links(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """``records`` with code_anchors, related_doc_ids and their unresolved symbols' number, by ``links.crosslinks``."""
    named = mentions(records, chunks)
    linked = crosslinks(named, records)
    forward = linked.groupBy("id").agg(F.array_sort(F.collect_set("anchor_id")).alias("code_anchors"))  # anchors of one record
    back = linked.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set(linked["id"])).alias("related_doc_ids"))  # records of one anchor
    lost = unresolved(named, records).groupBy("id").agg(F.count("*").alias("unresolved"))
    return records.join(forward, "id", "left").join(back, "id", "left").join(lost, "id", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files with one JSON object a line; blank and broken lines are skipped."""
    schema = "chunk_id string, doc_id string, title string, heading string, text string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("chunk_id is not null")


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now`` whose id is new or whose content_hash differs: what an incremental build has to read."""
    return now.join(before.select("id", "content_hash").distinct(), ["id", "content_hash"], "left_anti")
