"""Checks of records against each other, drift between builds, and the state of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.vocab import KIND_WEIGHT, lookup

# States that a decision may have; default source type and trust of each kind.
ADR_STATES = ["proposed", "accepted", "superseded", "deprecated", "rejected"]
KIND_SOURCE = {
    "contract": ("contract", "confirmed"), "request_flow": ("contract", "confirmed"), "frontend_contract": ("contract", "confirmed"), "backend_contract": ("contract", "confirmed"),
    "adr": ("adr", "accepted"), "known_gaps": ("known_gap", "known_risk"), "code_anchor": ("code_anchor", "implementation"), "test_anchor": ("test_anchor", "implementation"),
    "openapi_spec": ("openapi", "inferred"), "architecture": ("contract", "confirmed"), "integrations": ("contract", "confirmed"), "agents": ("contract", "confirmed"),
    "workspace_doc": ("contract", "confirmed"), "doc": ("contract", "confirmed"), "touchpoint": ("contract", "confirmed"), "to_validate": ("contract", "draft"),
}
# States that override the trust of a kind.
CONTRACT_LIKE = ["contract", "request_flow", "frontend_contract", "backend_contract"]


def trust(kind: Column, status: Column) -> tuple[Column, Column]:
    """(source_type, trust_level) of a record by its kind and status; unknown kinds count as contracts."""
    state = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    source, level = F.lit("contract"), F.lit("confirmed")
    for name, (s, t) in KIND_SOURCE.items():
        source, level = F.when(kind == name, s).otherwise(source), F.when(kind == name, t).otherwise(level)
    like, adr, early = kind.isin(*CONTRACT_LIKE), kind == "adr", state.isin("draft", "proposed")
    level = F.when((like | adr) & early, "draft").when(like & state.isin("confirmed", "active", "approved"), "confirmed").when(adr & state.isin("accepted", "approved"), "accepted").otherwise(level)
    return source, level


def violations(manifest: DataFrame) -> DataFrame:
    """(check, id, value), distinct: what the records' lint finds.

    Checks: missing_id, missing_owner, missing_team, missing_service, bad_status (of contracts
    and decisions), duplicate_id, repeated_gap, id_is_gap, unknown_contract, unknown_anchor.
    """
    docs = manifest.select("id", "repo", "kind", "external_id", "status", "owner", "symbol", "known_gap_ids", "related_contracts", "related_anchors").distinct()
    checked = docs.where("kind in ('contract', 'adr')")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    state = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    own = F.array(
        F.when(blank("external_id"), F.struct(F.lit("missing_id").alias("check"), F.lit("").alias("value"))),
        F.when(F.col("owner").isNull(), F.struct(F.lit("missing_owner").alias("check"), F.lit("").alias("value"))),
        F.when(F.col("owner").isNotNull() & blank("owner.team"), F.struct(F.lit("missing_team").alias("check"), F.lit("").alias("value"))),
        F.when(F.col("owner").isNotNull() & blank("owner.service"), F.struct(F.lit("missing_service").alias("check"), F.lit("").alias("value"))),
        F.when((F.col("kind") == "adr") & ~state.isin(*ADR_STATES), F.struct(F.lit("bad_status").alias("check"), state.alias("value"))),
    )
    single = checked.select("id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("v")).select("v.check", "id", "v.value")
    named = docs.where("external_id <> ''").select("id", F.col("external_id").alias("value"))
    twice = named.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    duplicate = named.join(twice, "value").select(F.lit("duplicate_id").alias("check"), "id", "value")
    gaps = docs.select("id", F.explode(X.strings(F.col("known_gap_ids"))).alias("value"))
    register = docs.where("kind = 'known_gaps'").select("id", F.explode(X.strings(F.col("known_gap_ids"))).alias("value"))
    again = register.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    repeated = register.join(again, "value").select(F.lit("repeated_gap").alias("check"), "id", "value")
    also_gap = named.join(gaps.select("value").distinct(), "value", "left_semi").select(F.lit("id_is_gap").alias("check"), "id", "value")
    contracts = docs.select("id", F.explode(X.strings(F.col("related_contracts"))).alias("value"))
    unknown = contracts.join(named.select("value").distinct(), "value", "left_anti").select(F.lit("unknown_contract").alias("check"), "id", "value")
    anchors = docs.select("id", F.explode(X.strings(F.col("related_anchors"))).alias("value")).withColumn("_s", F.split(F.trim("value"), r"\.")[0])
    symbols = docs.where("kind in ('code_anchor', 'test_anchor') and symbol <> ''").select(F.col("symbol").alias("_s")).distinct()
    lost = anchors.join(symbols, "_s", "left_anti").select(F.lit("unknown_anchor").alias("check"), "id", "value")
    return single.unionByName(duplicate).unionByName(repeated).unionByName(also_gap).unionByName(unknown).unionByName(lost).distinct()


def build_changes(stats: DataFrame) -> DataFrame:
    """(repo, build_id, appeared, resolved): unresolved symbols that a build adds to and drops from the one before.

    Builds of a repository are in order of time, then id; symbols are compared as written,
    nulls and blanks are none.
    """
    rows = stats.select("build_id", "repo", "built_at", "unresolved_symbols").distinct()
    now = F.array_distinct(F.filter(X.strings(F.col("unresolved_symbols")), lambda s: F.trim(s) != ""))
    order = Window.partitionBy("repo").orderBy("built_at", "build_id")
    paired = rows.withColumn("_now", now).withColumn("_then", F.coalesce(F.lag("_now").over(order), F.array().cast("array<string>")))
    return paired.select("repo", "build_id", F.size(F.array_except("_now", "_then")).cast("bigint").alias("appeared"), F.size(F.array_except("_then", "_now")).cast("bigint").alias("resolved"))


def kind_counts(manifest: DataFrame) -> DataFrame:
    """(kind, repo, records, removed) with subtotals per kind and in all (null kind and repo)."""
    docs = manifest.select("id", "kind", "repo", "removed_at").distinct()
    return docs.rollup("kind", "repo").agg(F.count("*").alias("records"), F.count("removed_at").alias("removed"), F.grouping_id().cast("bigint").alias("level"))


def index_status(manifest: DataFrame, chunks: DataFrame, max_age_hours: float = 48.0) -> DataFrame:
    """One row per repository: sizes, missing chunks, age in hours against the newest build, whether to rebuild."""
    docs = manifest.select("id", "repo", "kind", "known_gap_ids", "indexed_at").distinct()
    held = chunks.select(F.col("doc_id").alias("id")).distinct().withColumn("held", F.lit(True))
    newest = docs.agg(F.max("indexed_at").alias("newest"))
    per_repo = docs.join(held, "id", "left").groupBy("repo").agg(
        F.count("*").alias("records"), F.count_if(F.col("kind") == "code_anchor").alias("code_anchors"), F.count_if(F.col("kind") == "test_anchor").alias("test_anchors"),
        F.count_if(F.col("held").isNull()).alias("without_chunks"), F.sum(F.size(X.strings(F.col("known_gap_ids")))).alias("gap_mentions"), F.max("indexed_at").alias("built"),
    ).crossJoin(newest)  # one row
    hours = F.bround((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("built").cast("timestamp"))) / 3.6e9, 2)
    return per_repo.select("repo", "records", "code_anchors", "test_anchors", "without_chunks", "gap_mentions", hours.alias("age_hours"), ((F.col("without_chunks") > 0) | (hours > max_age_hours)).alias("rebuild"))


def workspace_status(manifest: DataFrame, chunks: DataFrame, hits: DataFrame, stats: DataFrame) -> DataFrame:
    """(metric, value): counts over all records, chunks, hits and the newest build of each repository."""
    docs = manifest.select("id", "repo", "kind", "owner", "symbol", "known_gap_ids", "code_anchors", "related_doc_ids", "trust_level", "removed_at", "indexed_at").distinct()
    kind, some = F.col("kind"), lambda c: F.size(X.strings(F.col(c))) > 0
    of_docs = docs.agg(
        F.count("*").alias("records"), F.count("removed_at").alias("removed"), F.count_if(~kind.isin("code_anchor", "test_anchor", "openapi_spec")).alias("documents"),
        F.count_if(kind == "code_anchor").alias("code_anchors"), F.count_if(kind == "test_anchor").alias("test_anchors"), F.count_if(kind == "openapi_spec").alias("openapi_specs"),
        F.count_if(kind == "contract").alias("contracts"), F.count_if(kind == "adr").alias("decisions"), F.count_distinct("repo").alias("repos"), F.count("owner").alias("owned"),
        F.count_if(F.col("trust_level").isin("confirmed", "accepted", "implementation")).alias("trusted"), F.count_if((kind == "contract") & some("code_anchors")).alias("contracts_with_anchors"),
        F.count_if((kind == "code_anchor") & some("related_doc_ids")).alias("anchors_with_documents"), F.coalesce(F.sum(F.size(X.strings(F.col("known_gap_ids")))), F.lit(0)).alias("gap_mentions"),
    )
    gaps = docs.select(F.explode("known_gap_ids").alias("g")).agg(F.count_distinct("g").alias("gaps"))
    symbols = docs.where("kind = 'code_anchor'").agg(F.count_distinct("symbol").alias("symbols"))
    each = chunks.select("chunk_id", "doc_id", "text").where("chunk_id is not null").distinct()
    of_chunks = each.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("chunked_documents"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chunk_characters"))
    of_hits = hits.select("hit_id", "stale", "chunks_missing").distinct().agg(F.count("*").alias("hits"), F.count_if("stale").alias("stale_hits"), F.count_if("chunks_missing").alias("hits_without_chunks"))
    builds = stats.select("build_id", "repo", "built_at", "unresolved_symbols", "contract_symbols_unresolved_total").distinct()
    newest = builds.withColumn("_r", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("built_at").desc_nulls_last(), F.col("build_id").desc_nulls_last()))).where("_r = 1")
    of_builds = newest.agg(F.coalesce(F.sum("contract_symbols_unresolved_total"), F.lit(0)).alias("unresolved_total"), F.count("*").alias("builds"))
    lost = newest.select(F.explode("unresolved_symbols").alias("s")).agg(F.count_distinct("s").alias("unresolved_symbols"))
    one = of_docs.crossJoin(gaps).crossJoin(symbols).crossJoin(of_chunks).crossJoin(of_hits).crossJoin(of_builds).crossJoin(lost)  # one row each
    metrics = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in one.columns)))
    return one.select(metrics.alias("m")).select("m.metric", "m.value")


def domain_phrases(manifest: DataFrame) -> DataFrame:
    """(id, phrases, n_phrases): the owner's domain and the words of three letters or more of title and external id, sorted and joined by blanks."""
    docs = manifest.select("id", "owner", "title", "external_id").distinct()
    named = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("external_id", F.lit(""))))
    words = F.filter(F.split(named, "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    each = docs.select("id", F.explode(F.concat(F.array(F.coalesce("owner.domain", F.lit(""))), words)).alias("p")).where("p <> ''").distinct()
    listed = F.array_sort(F.collect_list("p"))  # words of one record
    return each.groupBy("id").agg(F.array_join(listed, " ").alias("phrases"), F.count("*").alias("n_phrases"))


def reciprocity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, only_in): values that only one of two tables has; nulls are none."""
    one, other = (df.select(key).where(F.col(key).isNotNull()).distinct() for df in (left, right))
    return one.join(other, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(other.join(one, key, "left_anti").withColumn("only_in", F.lit("right")))


def owners(manifest: DataFrame) -> DataFrame:
    """(team, service, domain, contact, records): distinct owners; nulls count as empty."""
    docs = manifest.where("owner is not null").select("id", "owner").distinct()
    empty = lambda c: F.coalesce(F.col(f"owner.{c}"), F.lit(""))
    return docs.groupBy(*(empty(c).alias(c) for c in ("team", "service", "domain", "contact"))).agg(F.count("*").alias("records"))


def services(manifest: DataFrame) -> DataFrame:
    """(service, records): the owner's service of each record, else its repository."""
    docs = manifest.select("id", "repo", "owner").distinct()
    return docs.select(F.coalesce(F.nullif("owner.service", F.lit("")), F.nullif("repo", F.lit(""))).alias("service")).where("service is not null").groupBy("service").agg(F.count("*").alias("records"))


def trust_differences(manifest: DataFrame) -> DataFrame:
    """(id, source_type, trust_level, expected_source, expected_trust, weight, expected_weight) where any differs."""
    docs = manifest.select("id", "kind", "status", "source_type", "trust_level", "weight").distinct()
    source, level = trust(F.col("kind"), F.col("status"))
    wanted = docs.withColumn("expected_source", source).withColumn("expected_trust", level).withColumn("expected_weight", lookup(KIND_WEIGHT, F.coalesce("kind", F.lit("")), 55))
    differ = ~(F.col("source_type").eqNullSafe(F.col("expected_source")) & F.col("trust_level").eqNullSafe(F.col("expected_trust")) & F.col("weight").eqNullSafe(F.col("expected_weight")))
    return wanted.where(differ).drop("kind", "status")
