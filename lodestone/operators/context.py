"""What belongs to records that were found: references, owners, gaps, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.vocab import ANCHOR_PRIORITY, ANCHOR_SOFT_CAP, lookup

# Contracts listed of each repository, trust they must have; anchors listed for all seeds.
CONTRACTS, LISTED_TRUST, ANCHORS = 8, "confirmed", 12


def references(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """``hits`` (query, hit_rank, id, score) with repo, path, kind, title, external_id, symbol, line_start and trust_level; empty values are null."""
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    docs = manifest.select("id", "repo", "path", "kind", "title", some("external_id"), some("symbol"), "line_start", some("trust_level")).distinct()
    return hits.select("query", "hit_rank", "id", "score").join(docs, "id").select("query", "hit_rank", "id", "repo", "path", "kind", "title", "external_id", "symbol", "line_start", "trust_level", "score")


def belongings(found: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """(by, part, value), distinct: gaps, owners, services, sources and contracts of the records found for each group.

    An owner is a team, else a contact; a service that of the owner, else the repository; a source a
    path; a contract its external id.  Null and empty values are left out.
    """
    docs = manifest.select("id", "repo", "path", "kind", "external_id", "owner", "known_gap_ids").distinct()
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    part = lambda name, value: F.struct(F.lit(name).alias("part"), value.alias("value"))
    parts = F.concat(
        F.transform(X.strings(F.col("known_gap_ids")), lambda g: part("gap", g)),
        F.array(
            part("owner", F.coalesce(some("owner.team"), some("owner.contact"))), part("service", F.coalesce(some("owner.service"), some("repo"))),
            part("source", some("path")), part("contract", F.when(F.col("kind") == "contract", some("external_id"))),
        ),
    )
    return found.select(by, "id").distinct().join(docs, "id").select(by, F.explode(parts).alias("p")).select(by, "p.part", "p.value").where("value <> ''").distinct()


def anchors_of_seeds(seeds: DataFrame, manifest: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """(query, place, anchor_id): anchors of a query's seeds (query, seed, id), ``limit`` in all.

    Earlier seeds come first, then types by priority, code before other anchors, then symbols; of
    the plain types only few are taken.  An anchor of several seeds counts at the first.
    """
    docs = manifest.select("id", "kind", "symbol", "path", "anchor_type", "code_anchors").distinct()
    each = seeds.join(docs.select("id", "code_anchors"), "id").select("query", "seed", F.explode(X.strings(F.col("code_anchors"))).alias("anchor_id"))
    first = each.groupBy("query", "anchor_id").agg(F.min("seed").alias("seed"))
    about = docs.select(F.col("id").alias("anchor_id"), F.coalesce(F.col("kind") != "code_anchor", F.lit(True)).alias("_other"), F.coalesce(F.nullif("symbol", F.lit("")), F.coalesce("path", F.lit(""))).alias("_name"), F.coalesce("anchor_type", F.lit("")).alias("_type"))
    order = ["seed", lookup(ANCHOR_PRIORITY, F.col("_type"), 10).desc(), "_other", "_name", "anchor_id"]
    rows = first.join(about, "anchor_id").withColumn("_n", F.row_number().over(Window.partitionBy("query", "_type").orderBy(*order)))
    kept = rows.where(F.col("_n") <= lookup(ANCHOR_SOFT_CAP, F.col("_type"), limit))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= limit).select("query", "place", "anchor_id")


def first_contracts(manifest: DataFrame, limit: int = CONTRACTS) -> DataFrame:
    """(repo, place, id): the first confirmed contracts of each repository by path."""
    docs = manifest.where((F.col("kind") == "contract") & (F.col("trust_level") == LISTED_TRUST)).select("id", "repo", "path").distinct()
    order = Window.partitionBy("repo").orderBy(F.coalesce("path", F.lit("")), "id")
    return docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("repo", "place", "id")
