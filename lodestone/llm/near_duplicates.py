"""Similarity join of small sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most
k = (1 - t) / (1 + t) * (a + b) elements.  Pairs are banded by a + b; within a band the element
domain is cut by hash into groups of four parts, as many groups as make fewer than half of all
parts differ.  Then in some group at most one part differs, so enumerating the four subsets of
three parts of every group gives the pair a common signature: the hash of the set's elements in
those three parts.

A signature that few sets bear makes pairs at once.  One that many sets bear (few or common
elements, often none) is split further, exactly: similar sets also share one of their rarest
elements, as many as may be missing plus one, so signature and rare element together make the
key.  No bucket is cut off and no pair of a large bucket is written out.  A 64-bit sketch of each
set travels with its signatures and refutes most chance pairs before the exact check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

PARTS = 4
#: sets that may bear a signature before it is split by rare elements
BUCKET = 200
#: share of all shared signatures beyond which one is joined by broadcast: at most 1 / share of them, whatever the corpus
HEAVY = 1e-4
#: counters of the frequency sketch that orders elements by rarity (4 MB, whatever the corpus)
COUNTERS = 1 << 20
#: rows with signatures that one task joins
TASK_ROWS = 500_000
#: widths of the bands of a + b
FIRST_BAND = 9


def words(text: Column) -> Column:
    """Longest runs of letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def pair_set(text: Column) -> Column:
    """Sorted distinct hashes of the pairs of neighbouring words."""
    return F.expr("array_sort(array_distinct(zip_with(slice(_w, 1, greatest(size(_w) - 1, 0)), slice(_w, 2, greatest(size(_w) - 1, 0)), (a, b) -> xxhash64(a, b))))")


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set_id, elements) of each record with at least one pair of words.

    A record has one text, null in some of its rows; were there more, the first in binary order
    counts.  ``set_id`` is the hash of the set: records with equal sets share it.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).distinct()
    one = rows.groupBy(key).agg(F.min(text).alias("_t"))
    sets = one.select(key, words(F.col("_t")).alias("_w")).select(key, pair_set(F.col("_w")).alias("elements"))
    return sets.where(F.size("elements") > 0).select(key, F.xxhash64("elements").alias("set_id"), "elements")


def bands(threshold: float, largest: int) -> list[tuple[int, int, int]]:
    """(least sum, largest sum, groups) of the bands that sets of up to ``largest`` elements need."""
    out, low, high = [], 2, FIRST_BAND
    while low <= 2 * largest:
        differing = math.floor((1 - threshold) / (1 + threshold) * high + 1e-9)
        out.append((low, high, differing // 2 + 1))
        low, high = high + 1, 2 * high + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature_hashes(elements: np.ndarray, row: np.ndarray, rows: int, groups: int, seed: int) -> np.ndarray:
    """Rows x (4 * groups) signatures; ``elements`` of all rows with the row of each."""
    parts = groups * PARTS
    part = (_mixed(elements + np.uint64(seed)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(rows * parts, np.uint64)
    np.add.at(sums, row * parts + part, _mixed(elements ^ np.uint64(0x9E3779B97F4A7C15)))
    sums = sums.reshape(rows, groups, PARTS)
    # parts weigh differently, so that an element counts in its part only
    sums = _mixed(sums) * np.where(sums == 0, 0, 1).astype(np.uint64)
    weight = _mixed(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(7919))
    weighed = sums * (weight | np.uint64(1))
    whole = weighed.sum(axis=2, keepdims=True)
    place = _mixed(np.arange(parts, dtype=np.uint64).reshape(1, groups, PARTS) * np.uint64(104729) + np.uint64(seed * 31 + groups))
    return _mixed((whole - weighed) ^ place).reshape(rows, parts)


def sketch_bits(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    bits = np.left_shift(np.uint64(1), _mixed(elements + np.uint64(77)) & np.uint64(63))
    return np.bitwise_or.reduceat(bits, begins)


def signatures(sets: DataFrame, threshold: float, sizes: list[int]) -> DataFrame:
    """(sig, set_id, bits, size) of every set and band in which it can have a partner of a present size."""
    scheme = bands(threshold, max(sizes, default=0))
    present = np.array(sorted(sizes))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = batch["elements"].map(len).to_numpy()
            flat = np.concatenate(batch["elements"].to_list()).astype(np.int64).view(np.uint64)
            begins = np.concatenate([[0], np.cumsum(count)[:-1]])
            bits = sketch_bits(flat, begins).view(np.int64)
            ids = batch["set_id"].to_numpy()
            low = np.searchsorted(present, np.ceil(threshold * count - 1e-9))
            high = np.searchsorted(present, np.floor(count / threshold + 1e-9), side="right")
            for number, (least, most, groups) in enumerate(scheme):
                first = np.searchsorted(present, least - count)  # the least partner size with a sum in the band
                last = np.searchsorted(present, most - count, side="right")
                inside = np.maximum(first, low) < np.minimum(last, high)
                if not inside.any():
                    continue
                chosen = np.flatnonzero(inside)
                of = np.repeat(np.arange(len(chosen)), count[chosen])
                part = flat[np.repeat(inside, count)]
                sig = signature_hashes(part, of, len(chosen), groups, number + 1)
                each = sig.shape[1]
                yield pd.DataFrame({"sig": sig.reshape(-1).view(np.int64), "set_id": np.repeat(ids[chosen], each), "bits": np.repeat(bits[chosen], each), "size": np.repeat(count[chosen], each).astype(np.int32)})

    return sets.select("set_id", "elements").mapInPandas(emit, "sig bigint, set_id bigint, bits bigint, size int")


def _bucket_of(element: Column) -> Column:
    return F.pmod(F.xxhash64(element), F.lit(COUNTERS)).cast("int")


def with_rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """Adds ``rarest``: the elements of which two similar sets share at least one.

    Elements are ordered by a frequency sketch, ties by hash; any one order keeps every pair, a
    good one makes buckets small.  The sketch is a fixed number of counters.
    """
    counts = sets.select(F.explode("elements").alias("e")).groupBy(_bucket_of(F.col("e")).alias("b")).count()
    table = np.zeros(COUNTERS, np.int32)
    fetched = counts.select("b", F.least("count", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()  # at most COUNTERS pairs of ints
    table[fetched["b"].to_numpy()] = fetched["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for elements, at in zip(batch["elements"], batch["_b"], strict=True):
                order = np.lexsort((elements, shared.value[at]))
                out.append(elements[order[: len(elements) - math.ceil(threshold * len(elements) - 1e-9) + 1]])
            yield pd.DataFrame({"set_id": batch["set_id"], "rarest": out})

    rows = sets.select("set_id", "elements", F.transform("elements", lambda e: F.pmod(F.xxhash64(e), F.lit(COUNTERS)).cast("int")).alias("_b"))
    return rows.mapInPandas(emit, "set_id bigint, rarest array<bigint>")


def _pairs(bucketed: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Pairs of sets with a common ``sig`` that their sizes and sketches do not refute; tasks grow in number with ``rows``, not in size."""
    bucketed = bucketed.repartition(max(1, math.ceil(rows / TASK_ROWS)), "sig")
    a, b = bucketed.alias("a"), bucketed.alias("b")
    size_a, size_b = F.col("a.size"), F.col("b.size")
    near = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= (size_a + size_b) * ((1 - threshold) / (1 + threshold)) + 1e-9
    alike = F.least(size_a, size_b) >= F.greatest(size_a, size_b) * threshold - 1e-9
    return a.join(b, [F.col("a.sig") == F.col("b.sig"), F.col("a.set_id") < F.col("b.set_id"), near, alike]).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))


def similar_sets(sets: DataFrame, threshold: float, bucket: int = BUCKET) -> DataFrame:
    """(set_a, set_b, similarity) of all pairs of different sets of at least ``threshold``; set_a < set_b.

    ``sets``: a table of (set_id, elements) with distinct sets, read several times.
    """
    sizes = [row[0] for row in sets.select(F.size("elements").alias("n")).distinct().collect()]  # distinct sizes only
    signed = materialize(signatures(sets, threshold, sizes), "signatures")
    counts = materialize(signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "signature-counts")
    limit = max(bucket, math.ceil(HEAVY * (counts.agg(F.sum("n")).first()[0] or 0)))
    # a signature that very many sets bear isn't gathered in one task
    heavy = F.broadcast(counts.where(F.col("n") > limit))
    borne = materialize(signed.join(counts.where(F.col("n") <= limit), "sig").unionByName(signed.join(heavy, "sig")), "shared-signatures")
    few, many = F.col("n") <= bucket, F.col("n") > bucket
    rarest = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1
    expected = borne.agg(F.count_if(few).alias("small"), F.sum(F.when(many, rarest)).alias("large")).first()
    small = _pairs(borne.where(few), threshold, expected["small"])
    rare = with_rarest(sets, threshold)
    split = borne.where(many).join(rare, "set_id").select(F.explode("rarest").alias("e"), "sig", "set_id", "bits", "size").select(F.xxhash64("sig", "e").alias("sig"), "set_id", "bits", "size")
    large = _pairs(split, threshold, expected["large"] or 0)
    candidates = small.unionByName(large).distinct()
    left = sets.select(F.col("set_id").alias("set_a"), F.col("elements").alias("_ea"))
    right = sets.select(F.col("set_id").alias("set_b"), F.col("elements").alias("_eb"))
    common = F.size(F.array_intersect("_ea", "_eb"))
    checked = candidates.join(left, "set_a").join(right, "set_b").withColumn("_c", common)
    similarity = F.col("_c") / (F.size("_ea") + F.size("_eb") - F.col("_c"))
    return checked.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("set_a", "set_b", "similarity")


def similar_classes(df: DataFrame, key: str, text: str, threshold: float, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(key, set_id) of the records and (set_a, set_b) of the similar sets, as written tables.

    Records with equal sets are one class, so a group of n copies costs n rows here.  Records
    without two words are in no class.  Null keys and texts are left out, repeated rows count once.
    """
    members = materialize(records(df, key, text), "records")
    sets = materialize(members.groupBy("set_id").agg(F.first("elements").alias("elements")), "sets")
    pairs = materialize(similar_sets(sets, threshold, bucket).select("set_a", "set_b"), "set-pairs")
    return members.select(key, "set_id"), pairs


def expanded(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b) of all pairs of different records in equal or similar sets; key_a < key_b.

    As many rows as there are pairs: n copies give n * (n - 1) / 2 of them.
    """
    first = members.select(F.col(key).alias("_x"), F.col("set_id").alias("set_a"))
    second = members.select(F.col(key).alias("_y"), F.col("set_id").alias("set_b"))
    between = pairs.join(first, "set_a").join(second, "set_b").select("_x", "_y")
    copied = members.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("set_id").alias("set_a"))
    equal = first.join(copied, "set_a").join(second, F.col("set_a") == F.col("set_b")).where(F.col("_x") < F.col("_y")).select("_x", "_y")
    return between.unionByName(equal).select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))


def similar_records(df: DataFrame, key: str = "doc_id", text: str = "snippet", threshold: float = 0.6, bucket: int = BUCKET) -> DataFrame:
    """(key_a, key_b) of all pairs of different records of at least ``threshold``; records with equal sets have similarity 1."""
    return expanded(*similar_classes(df, key, text, threshold, bucket), key)


def groups(pairs: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(member, group_id): connected components of the pairs; ``group_id`` is the least member.

    Alternating large-star and small-star rounds, each written as a table; the number of rounds
    grows with the logarithm of the longest chain.
    """
    edges = materialize(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        seen, before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), seen
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("member"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("member"), F.col("v").alias("group_id"))).distinct()


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "snippet", threshold: float = 0.6) -> DataFrame:
    """(key, group_id, links) of every record with at least one similar other one.

    ``group_id`` is the least key of the records connected by similarity, ``links`` the number of
    similar records.  Records with equal sets are one node, so a group of copies costs its size,
    not its pairs.
    """
    members, pairs = similar_classes(df, key, text, threshold)
    sizes = members.groupBy("set_id").agg(F.count("*").alias("size"))
    both = pairs.unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b")))
    beside = both.join(sizes.withColumnRenamed("set_id", "set_b"), "set_b").groupBy(F.col("set_a").alias("set_id")).agg(F.sum("size").alias("beside"))
    linked = sizes.join(beside, "set_id", "left").select("set_id", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("links")).where("links > 0")
    connected = groups(pairs, "set_a", "set_b").select(F.col("member").alias("set_id"), F.col("group_id").alias("_g"))
    placed = linked.join(connected, "set_id", "left").withColumn("_g", F.coalesce("_g", "set_id"))
    each = members.join(placed, "set_id")
    least = each.groupBy("_g").agg(F.min(key).alias("group_id"))
    return each.join(least, "_g").select(key, "group_id", "links")
