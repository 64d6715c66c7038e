"""Links between records: crosslinks by symbol, related contracts, tests, caps and changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import search as S
from lodestone.operators.matching import containing
from lodestone.storage import materialize
from lodestone.vocab import ANCHOR_KEEP_RANK, ANCHOR_PRIORITY, ANCHOR_SOFT_CAP, lookup

# Kinds whose texts are searched for symbols; anchors kept per repository.
LINKING_KINDS = ["contract", "architecture", "integrations", "adr"]
ANCHORS_PER_REPO = 500
# Kinds that seed the tests of a query; seeds of a query; what each symbol of a seed and each token of the query add.
SEED_KINDS = ["contract", "integrations", "architecture", "code_anchor"]
SEEDS, SEED_SYMBOL, QUERY_TOKEN = 8, 5, 2


def mentions(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, repo, symbol): symbols that records of linking kinds prefer or mention, each once."""
    docs = manifest.where(F.col("kind").isin(*LINKING_KINDS)).select("id", "repo", "related_anchors").distinct()
    preferred = docs.select("id", "repo", F.explode(F.filter(F.transform(X.strings(F.col("related_anchors")), lambda a: F.split(F.trim(a), r"\.")[0]), X.linkable)).alias("symbol"))
    texts = chunks.select(F.col("doc_id").alias("id"), F.explode(X.mentioned_symbols(F.col("text"))).alias("symbol")).distinct()
    return preferred.unionByName(texts.join(docs.select("id", "repo"), "id").select("id", "repo", "symbol")).distinct()


def crosslinks(named: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, repo, symbol, anchor_id, tier) of mentioned symbols and the anchors they resolve to.

    Tier 1: the symbol in the record's repository; 2: a service's implementation there; 3: either
    in any repository.  Only the best tier of a mention counts.
    """
    anchors = manifest.where("kind = 'code_anchor' and symbol <> '' and repo <> ''").select(F.col("id").alias("anchor_id"), F.col("repo").alias("a_repo"), F.col("symbol").alias("a_symbol")).distinct()
    spelled = named.select("id", "repo", "symbol", F.explode(F.when(F.col("symbol").endswith("Service"), F.array(F.col("symbol"), F.concat("symbol", F.lit("Impl")))).otherwise(F.array("symbol"))).alias("a_symbol"))
    tier = F.when(F.col("a_symbol") == F.col("symbol"), 1).otherwise(2)
    own = spelled.join(anchors.withColumnRenamed("a_repo", "repo"), ["a_symbol", "repo"]).withColumn("tier", tier)
    best = own.groupBy("id", "symbol").agg(F.min("tier").alias("tier"))
    near = own.join(best, ["id", "symbol", "tier"])
    # anchors of other repositories are looked up only for mentions without one of their own
    far = spelled.join(best, ["id", "symbol"], "left_anti").join(anchors, "a_symbol").withColumn("tier", F.lit(3))
    return near.select("id", "repo", "symbol", "anchor_id", "tier").unionByName(far.select("id", "repo", "symbol", "anchor_id", "tier"))


def unresolved(named: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, repo, symbol) of mentions that no anchor of any repository bears."""
    symbols = manifest.where("kind = 'code_anchor' and symbol <> '' and repo <> ''").select(F.col("symbol").alias("_s"))
    bare = symbols.unionByName(symbols.where("_s like '%ServiceImpl'").select(F.expr("left(_s, length(_s) - 4)").alias("_s"))).distinct()
    return named.join(bare, named["symbol"] == bare["_s"], "left_anti")


def crosslink_statistics(named: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per repository: records with anchors, linked anchors, unresolved mentions and distinct ones."""
    linked = crosslinks(named, manifest)
    left = linked.groupBy("repo").agg(F.count_distinct("id").alias("records_with_anchors"), F.count_distinct("anchor_id").alias("anchors_linked"))
    right = unresolved(named, manifest).groupBy("repo").agg(F.count("*").alias("unresolved_total"), F.count_distinct("symbol").alias("unresolved_unique"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return left.join(right, "repo", "full").select("repo", zero("records_with_anchors"), zero("anchors_linked"), zero("unresolved_total"), zero("unresolved_unique"))


def linked_documents(linked: DataFrame) -> DataFrame:
    """(anchor_id, documents): how many records each anchor implements."""
    return linked.groupBy("anchor_id").agg(F.count_distinct("id").alias("documents"))


def capped_anchors(manifest: DataFrame, cap: int = ANCHORS_PER_REPO) -> DataFrame:
    """(repo, keep_rank, id) of the anchors kept of each repository: by type, weight and path."""
    anchors = manifest.where(F.col("kind").isin("code_anchor", "test_anchor")).select("id", "repo", "anchor_type", "weight", "path").distinct()
    order = Window.partitionBy("repo").orderBy(lookup(ANCHOR_KEEP_RANK, F.coalesce("anchor_type", F.lit("")), 50), F.coalesce("weight", F.lit(0)).desc(), F.coalesce("path", F.lit("")), "id")
    return anchors.withColumn("keep_rank", F.row_number().over(order)).where(F.col("keep_rank") <= cap).select("repo", "keep_rank", "id")


def cap_report(manifest: DataFrame, cap: int = ANCHORS_PER_REPO) -> DataFrame:
    """(repo, total, kept, dropped): anchors of each repository under the cap of ``capped_anchors``."""
    anchors = manifest.where(F.col("kind").isin("code_anchor", "test_anchor")).select("id", "repo").distinct()
    return anchors.groupBy("repo").agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(cap)).alias("kept"), F.greatest(F.count("*") - cap, F.lit(0)).alias("dropped"))


def softly_capped(manifest: DataFrame, limit: int = 12) -> DataFrame:
    """(id, place, anchor_id): anchors of each record, few of the plain types, ``limit`` in all."""
    docs = manifest.select("id", "kind", "symbol", "path", "anchor_type", "code_anchors").distinct()
    each = docs.select("id", F.explode(F.array_distinct(X.strings(F.col("code_anchors")))).alias("anchor_id"))
    about = docs.select(F.col("id").alias("anchor_id"), (F.col("kind") != "code_anchor").alias("_other"), F.coalesce(F.nullif("symbol", F.lit("")), F.coalesce("path", F.lit(""))).alias("_name"), F.coalesce("anchor_type", F.lit("")).alias("_type"))
    rows = each.join(about, "anchor_id")
    order = [lookup(ANCHOR_PRIORITY, F.col("_type"), 10).desc(), F.coalesce("_other", F.lit(True)), F.col("_name"), F.col("anchor_id")]
    of_type = F.row_number().over(Window.partitionBy("id", "_type").orderBy(*order))
    kept = rows.withColumn("_n", of_type).where(F.col("_n") <= lookup(ANCHOR_SOFT_CAP, F.col("_type"), limit))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("place") <= limit).select("id", "place", "anchor_id")


def related_records(manifest: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, hop, related_id): records reached over related contracts in one or two steps.

    An external id that several records bear names the last of them by id.  A record reached in
    one step isn't reached in two, and none reaches itself.
    """
    docs = manifest.select("id", "kind", "external_id", "related_contracts").distinct()
    bearer = docs.where("external_id <> ''").groupBy("external_id").agg(F.max("id").alias("related_id"))
    step = docs.select("id", "kind", F.explode(F.array_distinct(X.strings(F.col("related_contracts")))).alias("external_id")).join(bearer, "external_id").where("id <> related_id").select("id", "kind", "related_id")
    start = step if kinds is None else step.where(F.col("kind").isin(*kinds))
    first = start.select("id", F.lit(1).alias("hop"), "related_id")
    onward = step.select(F.col("id").alias("related_id"), F.col("related_id").alias("next"))
    second = first.join(onward, "related_id").select("id", F.lit(2).alias("hop"), F.col("next").alias("related_id")).where("id <> related_id")
    return first.unionByName(second).groupBy("id", "related_id").agg(F.min("hop").alias("hop")).select("id", "hop", "related_id")


def test_runs(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(test_id, path, run), distinct, of a test's symbol, title, path, keywords and its whole text.

    Chunks meet at line breaks, so no run crosses them and each gives its own.
    """
    tests = manifest.where("kind = 'test_anchor'").select(F.col("id").alias("test_id"), "symbol", "title", "path", "keywords").distinct()
    stack = F.array_union(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "title", "path"))), X.strings(F.col("keywords")))
    of_fields = tests.select("test_id", "path", F.explode(F.flatten(F.transform(stack, X.runs))).alias("run"))
    texts = tests.select("test_id", "path").distinct().join(chunks.where("chunk_id is not null and text <> ''").select(F.col("doc_id").alias("test_id"), "text"), "test_id")
    return of_fields.unionByName(texts.select("test_id", "path", F.explode(X.runs(F.col("text"))).alias("run"))).distinct()


def symbols_of_seeds(queries: DataFrame, manifest: DataFrame) -> DataFrame:
    """(query, symbol), distinct: the symbols of a query's best records of the seeding kinds and of the anchors these list.

    An anchor's symbol follows the last ``#`` of its id.  Symbols are trimmed; empty ones are none.
    """
    seeds = S.search(S.restricted(S.records(manifest), kinds=SEED_KINDS), queries, SEEDS).select("query", "id")
    anchors = F.filter(X.strings(F.col("code_anchors")), lambda a: F.contains(a, F.lit("#")))
    named = F.concat(X.strings(F.array("symbol")), F.transform(anchors, lambda a: F.substring_index(a, "#", -1)))
    symbols = manifest.select("id", F.explode(F.array_distinct(F.transform(named, X.stripped))).alias("symbol")).where("symbol <> ''").distinct()
    return seeds.join(symbols, "id").select("query", "symbol").distinct()


def tests_of_queries(queries: DataFrame, manifest: DataFrame, chunks: DataFrame, limit: int = 8, primary: DataFrame | None = None, require_primary: bool = False, least_tokens: int = 0) -> DataFrame:
    """(query, test_rank, test_id, score): the tests that hold most of each query.

    One sum of three parts, whatever the case: two points for every significant token, with
    repetitions; five for every symbol of the query's seeds; and 12 with the length of the longest
    stem, up to 16, of the query's ``primary`` symbols (query, symbol), which then are no symbols of
    seeds.  With ``require_primary`` a query that has primary symbols takes only tests that hold a
    stem of one.  A test that holds tokens only needs ``least_tokens`` points.
    """
    where = materialize(test_runs(manifest, chunks), "test-runs")
    asked = queries.select("query").where("query is not null").distinct()
    first = None if primary is None else materialize(primary.where("symbol <> ''").select("query", "symbol").distinct(), "primary-symbols")
    named = symbols_of_seeds(asked, manifest)
    if first is not None:
        named = named.join(first, ["query", "symbol"], "left_anti")
    tokens = asked.select("query", F.explode(X.significant(X.tokens(F.col("query")))).alias("needle"), F.lit(QUERY_TOKEN).alias("tokens"), F.lit(0).alias("symbols"))
    symbols = named.select("query", F.lower("symbol").alias("needle"), F.lit(0).alias("tokens"), F.lit(SEED_SYMBOL).alias("symbols"))
    each = materialize(tokens.unionByName(symbols).groupBy("query", "needle").agg(F.sum("tokens").alias("tokens"), F.sum("symbols").alias("symbols")), "test-needles")
    held = containing(each, "needle", where, "run").join(where, "run").select("needle", "test_id", "path").distinct()
    rows = each.join(held, "needle").groupBy("query", "test_id", "path").agg(F.sum("tokens").alias("tokens"), F.sum("symbols").alias("symbols"), F.lit(0).cast("bigint").alias("stem"))
    if first is not None:
        best = first.join(stems_held(first.select("symbol").distinct(), where), "symbol").groupBy("query", "test_id", "path").agg(F.max("score").alias("stem"))
        both = rows.unionByName(best.select("query", "test_id", "path", F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("symbols"), "stem"))
        rows = both.groupBy("query", "test_id", "path").agg(F.sum("tokens").alias("tokens"), F.sum("symbols").alias("symbols"), F.max("stem").alias("stem"))
        if require_primary:
            must = first.select("query").distinct().withColumn("must", F.lit(True))
            rows = rows.join(must, "query", "left").where("must is null or stem > 0")
    kept = rows.where((F.col("stem") > 0) | (F.col("symbols") > 0) | (F.col("tokens") >= least_tokens))
    return _best_tests(kept.withColumn("score", (F.col("tokens") + F.col("symbols") + F.col("stem")).cast("bigint")), "query", limit)


def stems_held(symbols: DataFrame, where: DataFrame) -> DataFrame:
    """(symbol, test_id, path, score): 12 and the longest shared stem, up to 16 characters, for each test that holds one."""
    stems = symbols.select("symbol", F.explode(X.symbol_stems(F.col("symbol"))).alias("stem"))
    hits = containing(stems, "stem", where, "run", gram=5)
    return stems.join(hits, "stem").join(where, "run").groupBy("symbol", "test_id", "path").agg((F.lit(12) + F.max(F.least(F.length("stem"), F.lit(16)))).cast("bigint").alias("score"))


def _best_tests(rows: DataFrame, by: str, limit: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.coalesce("path", F.lit("")), "test_id")
    return rows.withColumn("test_rank", F.row_number().over(order)).where(F.col("test_rank") <= limit).select(by, "test_rank", "test_id", "score")


def tests_of_names(symbols: DataFrame, manifest: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """(symbol, test_rank, test_id, score): the tests that share the longest stem with each symbol.

    A test is searched in its symbol, title, path, keywords and text.
    """
    where = materialize(test_runs(manifest, chunks), "test-runs")
    return _best_tests(stems_held(symbols.where("symbol <> ''").distinct(), where), "symbol", limit)


def tests_of_symbols(manifest: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """(symbol, test_rank, test_id, score): the same for every code symbol."""
    return tests_of_names(manifest.where("kind = 'code_anchor'").select("symbol"), manifest, chunks, limit)


def tested_by(manifest: DataFrame) -> DataFrame:
    """(anchor_id, test_id): code anchors whose symbol stands in a test's symbol or path, whatever the case.

    Of anchors with the same symbol the last by id counts.
    """
    last = manifest.where("kind = 'code_anchor' and symbol <> ''").groupBy(F.lower("symbol").alias("needle")).agg(F.max("id").alias("anchor_id"))
    tests = manifest.where("kind = 'test_anchor'").select(F.col("id").alias("test_id"), "symbol", "path").distinct()
    where = materialize(tests.select("test_id", F.explode(F.array_union(X.runs(F.col("symbol")), X.runs(F.col("path")))).alias("run")), "test-runs")
    hits = containing(last, "needle", where, "run", gram=5)
    return hits.join(where, "run").join(last, "needle").select("anchor_id", "test_id").distinct()


def records_at_paths(changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(changed, id): records whose path equals a changed path, or one is the tail of the other after a slash.

    Both sides' tails are matched by equality, so no pair of paths is compared.
    """
    paths = changed.select(F.col("path").alias("changed")).where("changed <> ''").distinct()
    docs = manifest.where("path <> ''").select("id", F.col("path").alias("p")).distinct()
    down = paths.select("changed", F.explode(X.path_suffixes(F.col("changed"))).alias("p")).join(docs, "p").select("changed", "id")
    up = docs.select("id", F.explode(X.path_suffixes(F.col("p"))).alias("changed")).join(paths, "changed").select("changed", "id")
    return down.unionByName(up).distinct()


def records_linked_to(touched: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, linked_id, direction): documents that changed code anchors name, or that name them.

    Changed documents themselves are left out.
    """
    docs = manifest.select("id", "kind", "code_anchors", "related_doc_ids").distinct()
    code = touched.select("id").distinct().join(docs.where("kind = 'code_anchor'"), "id")
    known = docs.select(F.col("id").alias("linked_id"))
    forward = code.select("id", F.explode(F.array_distinct(X.strings(F.col("related_doc_ids")))).alias("linked_id")).join(known, "linked_id").select("id", "linked_id", F.lit("named").alias("direction"))
    naming = docs.where("kind = 'contract'").select(F.col("id").alias("linked_id"), F.explode(F.array_distinct(X.strings(F.col("code_anchors")))).alias("id"))
    backward = naming.join(code.select("id"), "id").select("id", "linked_id", F.lit("naming").alias("direction"))
    return forward.unionByName(backward).join(touched.select(F.col("id").alias("linked_id")).distinct(), "linked_id", "left_anti").select("id", "linked_id", "direction")
