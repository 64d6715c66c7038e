"""References to records that do not exist at the time of the reference.

References and parent records are co-partitioned by the key they name and sorted by time; one
running sum over the merged stream gives, at each reference, how many parents are alive and how
many began before.  A reference without a living parent is an orphan: ``missing`` if no parent
ever exists, ``deleted`` if all that began have ended, ``late`` if the first one begins later.

Nothing is joined many to many.  Both streams are first reduced to one row per (key, time), with partial aggregation before the shuffle, so a key that a third of all records name
costs one row per distinct time.  The merge is cut by day: the sums of earlier days enter a day
as an offset, so even one key with very many times is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

#: array column of manifest_docs -> space of the keys it names
MANIFEST_FIELDS = {"code_anchors": "id", "related_doc_ids": "id", "related_contracts": "external_id"}

#: a key of a space as two hashes, 128 bits in all, so that shuffles carry no long names
PARTS = ["k1", "k2"]
#: share of all orphan references beyond which a key and time is joined by broadcast: at most 1 / share of them, whatever the tables
HEAVY = 1e-3


def spelled(name: Column) -> Column:
    """What a spelling names: without blanks around it, in lower case, with ``/`` for ``\\``."""
    stripped = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.lower(F.translate(stripped, "\\", "/"))


def hashed(df: DataFrame) -> DataFrame:
    """``df`` with its columns space and key made ``PARTS``."""
    return df.withColumn("k1", F.xxhash64("space", "key")).withColumn("k2", F.xxhash64(F.lit(2), "key", "space")).drop("space", "key")


def manifest_references(manifest: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_key, target_key, k1, k2, at) of the array columns.

    Null arrays, null elements and blank elements are no references; a record without
    ``indexed_at`` has no time to judge its references at and gives none.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("ref_field"), F.lit(s).alias("space"), F.col(c).alias("targets")) for c, s in MANIFEST_FIELDS.items()))
    each = manifest.where("indexed_at is not null").select(F.col("id").alias("ref_key"), F.col("indexed_at").alias("at"), F.explode(fields).alias("f"))
    rows = each.select(F.lit("manifest_docs").alias("ref_table"), "f.ref_field", "ref_key", F.explode("f.targets").alias("target_key"), "f.space", "at")
    return hashed(rows.withColumn("key", spelled(F.col("target_key"))).where("key <> ''"))


def stats_references(stats: DataFrame) -> DataFrame:
    """References of ``unresolved_symbols``: what follows the first colon names symbols."""
    rows = stats.where("built_at is not null").select(
        F.lit("crosslink_stats").alias("ref_table"), F.lit("unresolved_symbols").alias("ref_field"), F.col("build_id").alias("ref_key"),
        F.explode("unresolved_symbols").alias("target_key"), F.lit("symbol").alias("space"), F.col("built_at").alias("at"),
    )
    name = F.regexp_replace("target_key", r"(?s)^[^:]*:", "")
    return hashed(rows.where(spelled(F.col("target_key")) != "").withColumn("key", spelled(name)))


def parents(manifest: DataFrame) -> DataFrame:
    """(k1, k2, begins, ends): validity intervals of all names that records bear.

    A symbol that ends with ``Impl`` is also named without it.
    """
    symbol = spelled(F.col("symbol"))
    names = F.array(
        F.struct(F.lit("id").alias("space"), spelled(F.col("id")).alias("key")),
        F.struct(F.lit("external_id").alias("space"), spelled(F.col("external_id")).alias("key")),
        F.struct(F.lit("symbol").alias("space"), symbol.alias("key")),
        F.struct(F.lit("symbol").alias("space"), F.when(symbol.endswith("impl"), F.expr("left(symbol_key, length(symbol_key) - 4)")).alias("key")),
    )
    named = manifest.where("indexed_at is not null").withColumn("symbol_key", symbol).select(F.col("indexed_at").alias("begins"), F.col("removed_at").alias("ends"), F.explode(names).alias("n"))
    return hashed(named.select("n.space", "n.key", "begins", "ends").where("key is not null"))


def merged(references: DataFrame, named: DataFrame) -> DataFrame:
    """(k1, k2, at, reason, n) of the referenced keys and times without a living parent; ``n`` references name them."""
    valid = F.col("ends").isNull() | (F.col("ends") > F.col("begins"))
    steps = F.array(
        F.struct(F.col("begins").alias("at"), valid.cast("int").alias("alive"), F.lit(1).alias("begun")),
        F.struct(F.when(valid, F.col("ends")).alias("at"), F.lit(-1).alias("alive"), F.lit(0).alias("begun")),
    )
    changes = named.select(*PARTS, F.explode(steps).alias("s")).select(*PARTS, "s.*", F.lit(0).alias("asked")).where("at is not null")
    asked = references.select(*PARTS, "at", F.lit(0).alias("alive"), F.lit(0).alias("begun"), F.lit(1).alias("asked"))
    stream = changes.unionByName(asked).groupBy(*PARTS, "at").agg(F.sum("alive").alias("alive"), F.sum("begun").alias("begun"), F.sum("asked").alias("asked")).withColumn("day", F.to_date("at"))

    by_day = stream.groupBy(*PARTS, "day").agg(F.sum("alive").alias("day_alive"), F.sum("begun").alias("day_begun"))
    days = Window.partitionBy(*PARTS).orderBy("day")
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_day.select(
        *(F.col(c).alias(f"o_{c}") for c in (*PARTS, "day")),
        F.coalesce(F.sum("day_alive").over(before), F.lit(0)).alias("alive_before"),
        F.coalesce(F.sum("day_begun").over(before), F.lit(0)).alias("begun_before"),
        F.sum("day_begun").over(Window.partitionBy(*PARTS)).alias("begun_ever"),
    )
    same = [stream[c] == offsets[f"o_{c}"] for c in (*PARTS, "day")]
    within = Window.partitionBy(*PARTS, "day").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stream.join(offsets, same).select(
        *PARTS, "at", "asked", "begun_ever",
        (F.sum("alive").over(within) + F.col("alive_before")).alias("now_alive"),
        (F.sum("begun").over(within) + F.col("begun_before")).alias("now_begun"),
    )
    reason = F.when(F.col("begun_ever") == 0, "missing").when(F.col("now_begun") > 0, "deleted").otherwise("late")
    return placed.where("asked > 0 and now_alive <= 0").select(*PARTS, "at", reason.alias("reason"), F.col("asked").alias("n"))


def orphan_references(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per distinct orphan: (ref_table, period, ref_field, ref_key, target_key, reason).

    ``period`` is the month of the referring record, ``target_key`` the element as written.
    Re-delivered records and repeated elements count once; empty tables give no rows; columns
    other than those named are ignored.
    """
    references = manifest_references(manifest).unionByName(stats_references(stats))
    found = materialize(merged(references, parents(manifest)).withColumnsRenamed({c: f"m_{c}" for c in (*PARTS, "at")}), "orphan-keys")
    limit = HEAVY * (found.agg(F.sum("n")).first()[0] or 0)
    same = lambda keys: [references[c] == keys[f"m_{c}"] for c in (*PARTS, "at")]
    # a missing key that a large share of all records of one build names isn't gathered in one task
    heavy, light = F.broadcast(found.where(F.col("n") > limit)), found.where(F.col("n") <= limit)
    orphans = references.join(light, same(light)).unionByName(references.join(heavy, same(heavy)))
    return orphans.select("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "ref_field", "ref_key", "target_key", "reason").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct orphans per table, period, field and reason."""
    return orphans.groupBy("ref_table", "period", "ref_field", "reason").agg(F.count("*").alias("references"), F.count_distinct("ref_key").alias("records"))
