"""How records came about: decisions on their paths, deciding records, validating tests; and traces over these links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.graph import path_history

# Kinds with a history of their own, with their trust where none is given; levels of trust that count as trusted.
HISTORY_TRUST = {"contract": "confirmed", "adr": "accepted", "test_anchor": "implementation"}
TRUSTED = ["confirmed", "accepted", "implementation"]

LINK = ["link_type", "source", "target", "repo", "path", "source_type", "trust_level"]


def evolution_links(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """(link_type, source, target, repo, path, source_type, trust_level), distinct.

    introduced_in and modified_by: the oldest and newest of the last decisions on a record's path;
    decided_in: from a contract to the decision record that relates to it; validated_by: from a
    contract to each test whose symbol starts with the class of an anchor the contract prefers.
    Records need a path and an external id, for validated_by only those of the contract; blank
    names link nothing.  Paths are compared in plain form.
    """
    docs = manifest.select("id", "repo", "path", "kind", "external_id", "symbol", "trust_level", "related_contracts", "related_anchors").distinct()
    named = docs.where("path <> '' and external_id <> ''")
    plain = decisions.select("repo", X.plain_path(F.col("path")).alias("path"), "decision_id", "decided_at")
    history = path_history(plain).select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), "link_type", F.col("decision_id").cast("string").alias("target"))
    own = F.coalesce("trust_level", *(F.when(F.col("kind") == k, t) for k, t in HISTORY_TRUST.items()))
    level = F.when(F.col("link_type") == "modified_by", "inferred").when(F.col("kind") == "test_anchor", HISTORY_TRUST["test_anchor"]).otherwise(own)
    kept = named.where(F.col("kind").isin(*HISTORY_TRUST)).withColumn("_p", X.plain_path(F.col("path")))
    mined = kept.join(history, (F.col("repo") == F.col("_repo")) & (F.col("_p") == F.col("_path"))).select(
        "link_type", F.col("external_id").alias("source"), "target", "repo", "path", F.when(F.col("link_type") == "modified_by", "git_mining").otherwise(F.col("kind")).alias("source_type"), level.alias("trust_level")
    )
    decided = named.where("kind = 'adr'").select(
        F.lit("decided_in").alias("link_type"), F.explode(X.strings(F.col("related_contracts"))).alias("source"), F.col("external_id").alias("target"),
        "repo", "path", F.lit("adr").alias("source_type"), F.coalesce("trust_level", F.lit(HISTORY_TRUST["adr"])).alias("trust_level"),
    ).where("source <> ''")
    classes = docs.where("kind = 'contract' and external_id <> ''").select(F.col("external_id").alias("source"), F.explode(X.strings(F.col("related_anchors"))).alias("a")).select("source", F.split("a", r"\.")[0].alias("begin")).where("begin <> ''").distinct()
    tests = docs.where("kind = 'test_anchor' and symbol <> ''").select("repo", "path", F.col("symbol").alias("target"), F.explode(X.beginnings(F.col("symbol"))).alias("begin"))
    validated = tests.join(classes, "begin").select(F.lit("validated_by").alias("link_type"), "source", "target", "repo", "path", F.lit("test_anchor").alias("source_type"), F.lit("implementation").alias("trust_level"))
    return mined.unionByName(decided).unionByName(validated).distinct()


def evolution_trace(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(needle, trust_class, link columns): the links that begin or end at each asked id or symbol.

    ``trust_class`` is trusted, inferred or other.  Needles are trimmed; blank ones find nothing.
    """
    needles = asked.select(F.trim("needle").alias("needle")).where("needle <> ''").distinct()
    ends = links.select(*LINK, F.explode(F.array_distinct(F.array("source", "target"))).alias("needle"))
    kind = F.when(F.col("trust_level").isin(*TRUSTED), "trusted").when(F.col("trust_level") == "inferred", "inferred").otherwise("other")
    return ends.join(needles, "needle").select("needle", kind.alias("trust_class"), *LINK)
