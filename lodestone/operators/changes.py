"""Change sets and what they touch: files by kind, symbols, contracts, tests and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.links import records_at_paths
from lodestone.operators.matching import containing

# Endings of code files; how a class names its file; a method of a class; files of tests.
CODE_FILE = r"(?i)\.(java|kt|tsx?|jsx?|go|py|ya?ml)$"
CLASS_FILE = r"(?:^|/)([A-Z][A-Za-z0-9]+)\.(?:java|kt|ts|tsx|js|jsx|go|py)$"
METHOD = r"^([A-Z][A-Za-z0-9]+)\.([a-z][A-Za-z0-9]*)$"
TEST_FILE = r"(^|/)(test|tests)/|(^|/)test_[^/]*\.py$|_test\.go$|\.(spec|test)\.[jt]sx?$|Tests?\.(java|kt)$"
# Files of a change set that are listed; kinds that count as documents; least symbol of an anchor to look for in a test's.
LISTED, DOCUMENT_KINDS, LEAST_SYMBOL = 200, ["contract", "adr", "integrations", "architecture"], 5
# Endings of a test's name in order of what they prove.
TEST_ENDINGS = ["contracttest", "integrationtest", "securitytest", "test"]
LABELS = 4


def change_set(paths: DataFrame, most: int = LISTED) -> DataFrame:
    """(place, path, is_code, is_doc, is_test, total, truncated): the first distinct plain paths, and how many there are in all."""
    plain = paths.select(X.plain_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    total = plain.agg(F.count("*").alias("total"))
    low = F.lower("path")
    listed = plain.orderBy("path").limit(most).withColumn("place", F.row_number().over(Window.orderBy("path")))  # at most ``most`` rows
    return listed.crossJoin(total).select(
        "place", "path", F.col("path").rlike(CODE_FILE).alias("is_code"), (low.endswith(".md") & (low.contains("/docs/") | low.startswith("docs/"))).alias("is_doc"),
        F.col("path").rlike(TEST_FILE).alias("is_test"), "total", (F.col("total") > most).alias("truncated"),
    )  # one row of totals


def class_of_file(path: Column) -> Column:
    """The class that a code file is named after; null for other files."""
    return F.nullif(F.regexp_extract(X.plain_path(path), CLASS_FILE, 1), F.lit(""))


def symbol_target(target: Column) -> Column:
    """STRUCT(class_name, method) of ``Class.method``; anything else is all class."""
    plain = X.stripped(target)
    return F.struct(F.when(plain.rlike(METHOD), F.regexp_extract(plain, METHOD, 1)).otherwise(plain).alias("class_name"), F.nullif(F.regexp_extract(plain, METHOD, 2), F.lit("")).alias("method"))


def contracts_of_symbols(symbols: DataFrame, manifest: DataFrame) -> DataFrame:
    """(symbol, contract_id, by_anchor, by_contract): contracts linked to code anchors of each symbol.

    ``by_anchor``: an anchor names the contract; ``by_contract``: the contract names an anchor.
    """
    docs = manifest.select("id", "kind", "symbol", "related_doc_ids", "code_anchors").distinct()
    contracts = docs.where("kind = 'contract'")
    anchors = docs.where("kind = 'code_anchor'").join(symbols.select("symbol").where("symbol <> ''").distinct(), "symbol")
    forward = anchors.select("symbol", F.explode(X.strings(F.col("related_doc_ids"))).alias("contract_id")).join(contracts.select(F.col("id").alias("contract_id")), "contract_id").select("symbol", "contract_id", F.lit(True).alias("by_anchor"), F.lit(False).alias("by_contract"))
    named = contracts.select(F.col("id").alias("contract_id"), F.explode(X.strings(F.col("code_anchors"))).alias("id"))
    backward = named.join(anchors.select("id", "symbol"), "id").select("symbol", "contract_id", F.lit(False).alias("by_anchor"), F.lit(True).alias("by_contract"))
    return forward.unionByName(backward).groupBy("symbol", "contract_id").agg(F.max("by_anchor").alias("by_anchor"), F.max("by_contract").alias("by_contract"))


def documents_of_tests(changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(test_id, doc_id, named): documents that changed tests concern and that aren't changed themselves.

    A test concerns the documents it names and those with a code anchor whose symbol, of five
    characters or more, stands in the test's symbol, whatever the case.
    """
    touched = records_at_paths(changed, manifest).select("id").distinct()
    docs = manifest.select("id", "kind", "symbol", "related_doc_ids", "code_anchors").distinct()
    tests = docs.where("kind = 'test_anchor'").join(touched, "id").select(F.col("id").alias("test_id"), F.lower("symbol").alias("symbol"), "related_doc_ids")
    known = docs.where(F.col("kind").isin(*DOCUMENT_KINDS))
    named = tests.select("test_id", F.explode(X.strings(F.col("related_doc_ids"))).alias("doc_id")).join(known.select(F.col("id").alias("doc_id")), "doc_id").select("test_id", "doc_id", F.lit(True).alias("named"))
    symbols = docs.where("symbol <> ''").select("id", F.lower("symbol").alias("needle")).where(F.length("needle") >= LEAST_SYMBOL)
    anchored = known.select(F.col("id").alias("doc_id"), F.explode(X.strings(F.col("code_anchors"))).alias("id")).join(symbols, "id").select("doc_id", "needle").distinct()
    held = containing(anchored, "needle", tests.where("symbol <> ''"), "symbol", gram=LEAST_SYMBOL)
    alike = tests.join(held, "symbol").join(anchored, "needle").select("test_id", "doc_id", F.lit(False).alias("named"))
    both = named.unionByName(alike).groupBy("test_id", "doc_id").agg(F.max("named").alias("named"))
    return both.join(touched.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select("test_id", "doc_id", "named")


def documents_of_findings(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(finding_id, doc_id, tier): documents that findings (finding_id, external_id, path, summary) concern.

    Tier 1: the same external id; 2: paths that match by equality or tail; 3: the class of an
    anchor the document prefers stands in the summary.  Each document counts at its best tier.
    """
    docs = manifest.where(F.col("kind").isin(*DOCUMENT_KINDS)).select(F.col("id").alias("doc_id"), "external_id", "path", "related_anchors").distinct()
    rows = findings.select("finding_id", "external_id", X.plain_path(F.col("path")).alias("path"), "summary").distinct()
    one = rows.where("external_id <> ''").join(docs.select("doc_id", "external_id"), "external_id").select("finding_id", "doc_id", F.lit(1).alias("tier"))
    at = records_at_paths(rows, docs.select(F.col("doc_id").alias("id"), X.plain_path(F.col("path")).alias("path")))
    two = rows.join(at, F.col("path") == F.col("changed")).select("finding_id", F.col("id").alias("doc_id"), F.lit(2).alias("tier"))
    classes = docs.select("doc_id", F.explode(X.strings(F.col("related_anchors"))).alias("a")).select("doc_id", F.split("a", r"\.")[0].alias("needle")).where("needle <> ''").distinct()
    words = rows.where("summary <> ''").select("finding_id", F.explode(F.array_distinct(F.regexp_extract_all("summary", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    held = containing(classes, "needle", words, "word")
    three = words.join(held, "word").join(classes, "needle").select("finding_id", "doc_id", F.lit(3).alias("tier"))
    return one.unionByName(two).unionByName(three).groupBy("finding_id", "doc_id").agg(F.min("tier").alias("tier"))


def findings_of_symbols(symbols: DataFrame, findings: DataFrame) -> DataFrame:
    """(symbol, finding_id): findings whose summary holds the symbol, whatever the case, or whose external id holds it as written."""
    asked = symbols.select("symbol").where("symbol <> ''").distinct().withColumn("needle", F.lower("symbol"))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)))).alias("word")
    told = findings.where("summary <> ''").select("finding_id", words(F.lower("summary")))
    by_text = told.join(containing(asked, "needle", told, "word"), "word").join(asked, "needle").select("symbol", "finding_id")
    named = findings.where("external_id <> ''").select("finding_id", words(F.col("external_id")))
    by_id = named.join(containing(asked, "symbol", named, "word"), "word").select("symbol", "finding_id")
    return by_text.unionByName(by_id).distinct()


def test_labels(tests: DataFrame, manifest: DataFrame, by: str = "symbol", limit: int = LABELS) -> DataFrame:
    """(by, place, label): labels of the tests of each group, contract tests first, then integration, security and other tests.

    ``tests``: (by, test_id).  A label is the test's symbol, else its file without ending.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    labels = manifest.where("kind = 'test_anchor'").select(F.col("id").alias("test_id"), F.coalesce(F.nullif("symbol", F.lit("")), stem).alias("label")).where("label <> ''").distinct()
    rank = F.lit(len(TEST_ENDINGS))
    for place, ending in reversed(list(enumerate(TEST_ENDINGS))):
        rank = F.when(F.lower("label").endswith(ending), place).otherwise(rank)
    rows = tests.select(by, "test_id").distinct().join(labels, "test_id").select(by, "label").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(rank, "label"))).where(F.col("place") <= limit).select(by, "place", "label")
