"""Chunks of hits under character budgets, gaps and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.vocab import ANCHOR_PRIORITY, lookup

CHUNK = ["chunk_id", "doc_id", "title", "heading", "text"]


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks, each once, with ``number``: what follows the last ``#`` of the id (null if no number)."""
    each = chunks.select(*CHUNK).where("chunk_id is not null").distinct()
    return each.withColumn("number", F.expr("try_cast(substring_index(chunk_id, '#', -1) as int)"))


def parsed_chunk_ids(ids: DataFrame, column: str) -> DataFrame:
    """(chunk_id, doc_id, number): a chunk id split at its last ``#``; without one it is all document."""
    c = F.col(column)
    part = F.regexp_extract(c, r"^(?s)(.*)#([0-9]+)$", 1)
    valid = c.rlike(r"(?s)^.*#[0-9]+$")
    return ids.select(c.alias("chunk_id"), F.when(valid, part).otherwise(c).alias("doc_id"), F.when(valid, F.expr(f"try_cast(substring_index({column}, '#', -1) as int)")).alias("number"))


def best_chunks(hits: DataFrame, chunks: DataFrame, keep: int = 3) -> DataFrame:
    """(query, id, chunk_rank, chunk_id, heading, chunk_score) of the best chunks of each hit.

    A chunk scores one for every token of the query (with repetitions) its text contains; ties
    go to the smaller id as a string.  A null text contains nothing.
    """
    own = chunk_rows(chunks).select(F.col("doc_id").alias("id"), "chunk_id", "heading", F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = hits.select("query", "id", X.tokens(F.col("query")).alias("_tokens")).join(own, "id")
    score = F.size(F.filter("_tokens", lambda t: F.contains(F.col("_t"), t))).cast("bigint")
    ranked = Window.partitionBy("query", "id").orderBy(F.col("chunk_score").desc(), "chunk_id")
    return rows.withColumn("chunk_score", score).withColumn("chunk_rank", F.row_number().over(ranked)).where(F.col("chunk_rank") <= keep).select("query", "id", "chunk_rank", "chunk_id", "heading", "chunk_score")


def budgeted(rows: DataFrame, part: list[str], order: list[Column], text: str, total: int, cap: int | None = None) -> DataFrame:
    """Texts of each part in order until ``total`` characters are used, each at most ``cap``.

    Adds ``used`` (characters before), ``shown`` and ``was_cut``; rows after the budget are left
    out.  A null text is empty.
    """
    each = total if cap is None else min(cap, total)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_size", size).withColumn("used", F.coalesce(F.sum(F.least("_size", F.lit(each))).over(before), F.lit(0)))
    left = F.least(F.lit(each), F.lit(total) - F.col("used")).cast("int")
    kept = placed.where(F.col("used") < total).withColumn("_left", left)
    return kept.withColumn("shown", X.truncated(F.coalesce(F.col(text), F.lit("")), F.col("_left"))).withColumn("was_cut", F.col("_size") > F.col("_left")).drop("_size", "_left")


def document_chunks(chunks: DataFrame, most_chunks: int = 5, most_chars: int = 8000) -> DataFrame:
    """The first chunks of every document under one character budget; nothing follows a cut chunk."""
    numbered = chunk_rows(chunks).withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("number").asc_nulls_last(), "chunk_id"))).where(F.col("position") <= most_chunks)
    return budgeted(numbered, ["doc_id"], [F.col("position")], "text", most_chars)


def document_texts(chunks: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(doc_id, text): non-empty chunk texts joined by line breaks, up to ``most_chars`` without the breaks."""
    rows = chunk_rows(chunks).where("text <> ''")
    before = Window.partitionBy("doc_id").orderBy(F.col("number").asc_nulls_last(), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    used = rows.withColumn("_used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_used") < most_chars)
    piece = F.left(F.col("text"), (F.lit(most_chars) - F.col("_used")).cast("int"))
    joined = F.array_sort(F.collect_list(F.struct("_used", "chunk_id", piece.alias("p"))))  # at most most_chars characters
    return used.groupBy("doc_id").agg(joined.alias("_c")).select("doc_id", F.array_join(F.col("_c.p"), "\n").alias("text"))


def fetched(hits: DataFrame, manifest: DataFrame, chunks: DataFrame, hit_limit: int = 3, anchor_limit: int = 2, cap: int = 4000, total: int = 12000) -> DataFrame:
    """(query, hit_rank, part, chunk_id, used, shown, was_cut): texts of the first hits of each query.

    Part 0 is a hit's best chunk, parts 1 and on the first chunks of its best anchors; all parts
    of a query share one budget.
    """
    first = hits.where(F.col("hit_rank") <= hit_limit)
    main = best_chunks(first, chunks, 1).join(first.select("query", "id", "hit_rank"), ["query", "id"]).select("query", "hit_rank", F.lit(0).alias("part"), "chunk_id")
    anchors = related_anchors(manifest, anchor_limit).select(F.col("id"), "anchor_rank", F.concat("anchor_id", F.lit("#0")).alias("chunk_id"))
    side = first.select("query", "id", "hit_rank").join(anchors, "id").select("query", "hit_rank", F.col("anchor_rank").alias("part"), "chunk_id")
    texts = chunk_rows(chunks).select("chunk_id", "text")
    return budgeted(main.unionByName(side).join(texts, "chunk_id"), ["query"], [F.col("hit_rank"), F.col("part")], "text", total, cap).select("query", "hit_rank", "part", "chunk_id", "used", "shown", "was_cut")


def related_anchors(manifest: DataFrame, limit: int = 12) -> DataFrame:
    """(id, anchor_rank, anchor_id, anchor_total): the best anchors of every record.

    Anchors that the record prefers come first in its order, then types by priority, then
    symbols, all descending.  Ids that no record bears take a rank and are then left out.
    """
    docs = manifest.select("id", "symbol", "anchor_type", "code_anchors", "related_anchors").distinct()
    wanted = F.array_distinct(F.filter(F.transform(X.strings(F.col("related_anchors")), lambda a: F.split(F.trim(a), r"\.")[0]), X.linkable))
    listed = F.array_distinct(F.filter(X.strings(F.col("code_anchors")), lambda a: a != ""))
    each = docs.select("id", wanted.alias("_wanted"), F.size(X.strings(F.col("code_anchors"))).cast("bigint").alias("anchor_total"), F.explode(listed).alias("anchor_id"))
    named = docs.select(F.col("id").alias("anchor_id"), F.coalesce("symbol", F.lit("")).alias("_symbol"), "anchor_type", F.lit(True).alias("_there"))
    rows = each.join(named, "anchor_id", "left").withColumn("_symbol", F.coalesce("_symbol", F.lit("")))
    place = F.array_position("_wanted", F.col("_symbol"))
    preferred = F.when(place > 0, F.size("_wanted") - place + 1).otherwise(0)
    order = Window.partitionBy("id").orderBy(preferred.desc(), lookup(ANCHOR_PRIORITY, F.coalesce("anchor_type", F.lit("")), 10).desc(), F.col("_symbol").desc(), F.col("anchor_id"))
    ranked = rows.withColumn("anchor_rank", F.row_number().over(order)).where((F.col("anchor_rank") <= limit) & F.col("_there"))
    return ranked.select("id", "anchor_rank", "anchor_id", "anchor_total")


def snippets(chunks: DataFrame) -> DataFrame:
    """(doc_id, snippet) of the chunk with the least id, as a string, of each document."""
    first = Window.partitionBy("doc_id").orderBy("chunk_id")
    return chunk_rows(chunks).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def snippets_of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, id, hit_rank, chunk_id, snippet) from the best chunk of each hit; a hit without chunks has none."""
    best = best_chunks(hits, chunks, 1).join(hits.select("query", "id", "hit_rank"), ["query", "id"])
    return best.join(chunk_rows(chunks).select("chunk_id", "text"), "chunk_id").select("query", "id", "hit_rank", "chunk_id", X.snippet(F.col("text")).alias("snippet"))


def known_gaps(docs: DataFrame) -> DataFrame:
    """(gap_id, id, path, repo) of every listed gap, each record once per mention list entry."""
    return docs.select(F.explode(X.strings(F.col("known_gap_ids"))).alias("gap_id"), "id", "path", "repo")


def chunk_lookup(ids: DataFrame, chunks: DataFrame, manifest: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(chunk_id, doc_id, path, title, heading, shown, truncated) of the asked chunk ids that exist, each once.

    ``path`` is that of the document named in the id, null if no record bears it; a null text is empty.
    """
    asked = parsed_chunk_ids(ids, "chunk_id").select("chunk_id", F.col("doc_id").alias("id")).distinct()
    paths = manifest.select("id", "path").where("id is not null").groupBy("id").agg(F.min("path").alias("path"))
    text = F.coalesce("text", F.lit(""))
    found = asked.join(chunk_rows(chunks), "chunk_id").join(paths, "id", "left")
    return found.select("chunk_id", "doc_id", "path", "title", "heading", X.truncated(text, F.lit(most_chars)).alias("shown"), (F.length(text) > most_chars).alias("truncated"))


def gaps_filtered(gaps: DataFrame, prefix: str | None = None, gap_id: str | None = None) -> DataFrame:
    """Gaps that begin with a prefix, whatever the case, or are exactly one id, upper-cased."""
    if prefix and prefix.strip():
        gaps = gaps.where(F.upper("gap_id").startswith(prefix.strip().upper()))
    if gap_id and gap_id.strip():
        gaps = gaps.where(F.col("gap_id") == gap_id.strip().upper())
    return gaps


def gap_documents(docs: DataFrame) -> DataFrame:
    """(gap_id, document_count, repos); the documents themselves are the rows of ``known_gaps``."""
    return known_gaps(docs).groupBy("gap_id").agg(F.count("*").alias("document_count"), F.count_distinct("repo").alias("repos"))


def gap_prefixes(docs: DataFrame) -> DataFrame:
    """(prefix, occurrences, gaps): mentions and distinct gaps of each register."""
    return known_gaps(docs).withColumn("prefix", X.gap_prefix(F.col("gap_id"))).groupBy("prefix").agg(F.count("*").alias("occurrences"), F.count_distinct("gap_id").alias("gaps"))
