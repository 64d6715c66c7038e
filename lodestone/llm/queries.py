"""Registered queries of the subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import encoding, leakage, near_duplicates, source_origin, splitting, text_form, top_items
from lodestone.tables import table

TOP_GROUP = ["run_id", "repo", "anchor_type"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return source_origin.not_hand_written(table(spark, folder, "source_files")).select("repo", "path")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    found = source_origin.not_hand_written(table(spark, folder, "source_files"))
    return found.groupBy("repo", "reason").agg(F.count("*").alias("n_files"))


def p1_decisions(spark: SparkSession, folder: str) -> DataFrame:
    found = source_origin.not_hand_written(table(spark, folder, "source_files"))
    return source_origin.decisions_on_foreign(table(spark, folder, "path_decisions"), found)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_records(table(spark, folder, "search_hits"), "doc_id", "snippet", 0.6)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, folder, "search_hits"), "doc_id", "snippet", 0.6)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hits").where("anchor_type is not null")
    return top_items.top_items(hits, TOP_GROUP, "score", ["path"], "hit_id", 5).select(*TOP_GROUP, "hit_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.chunk_pieces(table(spark, folder, "search_hits"), table(spark, folder, "chunks"))


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each chunk give when put together: its own digest; whether sizes and overlaps keep their limits."""
    whole = splitting.rejoined(p5_pieces(spark, folder), "chunk_id")
    within = (F.col("largest") <= splitting.LIMIT) & (F.col("most_overlap") <= splitting.OVERLAP) & (F.col("pieces") > 1)
    return whole.select("chunk_id", F.md5("text").alias("digest"), within.alias("within_limits"))


def p5_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.snippet_pieces(table(spark, folder, "search_hits"), p5_pieces(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.token_counts(table(spark, folder, "documents"))


def p6_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and texts without tokens per source: the part of ``p6_counts`` that SQL can state."""
    return p6_counts(spark, folder).select("source", "documents", "without_tokens")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Digest and size of what the ids of each document stand for: equal to the text's own, null as empty."""
    texts = encoding.decoded(encoding.encoded(table(spark, folder, "documents")))
    return texts.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumn("coverage", F.round("coverage", 6))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.cleaned(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks by the words of the texts as stored, without bringing them to one form first."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), form=False).select("doc_id", "item_id")


def p7_touched(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which words are removed, again by the words as stored."""
    rows = leakage.cleaned(table(spark, folder, "documents"), table(spark, folder, "benchmark"), form=False)
    return rows.where("removed > 0").select("doc_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_form.variant_documents(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return text_form.text_forms(table(spark, folder, "documents")).select("doc_id", "form", "changed")


QUERIES = {
    "p1_found": p1_found, "p1_reasons": p1_reasons, "p1_decisions": p1_decisions,
    "p3_found": p3_found, "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined, "p5_snippets": p5_snippets,
    "p6_ids": p6_ids, "p6_counts": p6_counts, "p6_empty": p6_empty, "p6_decoded": p6_decoded,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_cleaned": p7_cleaned, "p7_verbatim": p7_verbatim, "p7_touched": p7_touched,
    "p8_found": p8_found, "p8_forms": p8_forms,
}

_LEAKS = r"""
i as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from benchmark where text is not null),
iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0)),
d as (select distinct doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
dw as (select doc_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw) where len(w) >= n)),
leaks as (select distinct doc_id, item_id from dw join iw using (n, g))
"""

_SIMILAR = r"""
w as (
  select distinct doc_id, regexp_extract_all(snippet, '[\p{L}\p{N}]+') as w from search_hits where snippet is not null
), s as (
  select doc_id, list_distinct([lower(w[i]) || ' ' || lower(w[i + 1]) for i in range(1, len(w))]) as e from w where len(w) > 1
), x as (
  select doc_id, unnest(e) as e, len(e) as n from s
), alike as (
  select a.doc_id as doc_id_a, b.doc_id as doc_id_b
  from x a join x b on a.e = b.e and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having count(*) >= 0.6 * (a.n + b.n - count(*))
)"""

ORACLE = {
    "p3_found": "with " + _SIMILAR + " select doc_id_a, doc_id_b from alike",
    "p3_groups": "with recursive " + _SIMILAR + """,
both_ways as (select doc_id_a as a, doc_id_b as b from alike union select doc_id_b, doc_id_a from alike),
reached as (select a as doc_id, a as other from both_ways union select r.doc_id, e.b from reached r join both_ways e on e.a = r.other)
select doc_id, min(other) as group_id, any_value(links) as links from reached join (select a as doc_id, count(*) as links from both_ways group by a) using (doc_id) group by doc_id""",
    "p4_found": """
select run_id, repo, anchor_type, hit_id
from (select distinct run_id, repo, anchor_type, hit_id, score, path from search_hits where score is not null and anchor_type is not null)
qualify row_number() over (partition by run_id, repo, anchor_type order by score desc, path asc nulls first, hit_id) <= 5""",
    "p6_empty": "select source, count(*) as documents, count(*) filter (coalesce(text, '') = '') as without_tokens from documents group by source",
    "p6_decoded": "select doc_id, md5(coalesce(text, '')) as digest, strlen(coalesce(text, '')) as n_bytes from documents",
    "p5_found": """
select distinct chunk_id from chunks
where strlen(text) > 2048 and chunk_id in (select unnest(top_chunk_ids) from search_hits)""",
    "p5_rejoined": """
select distinct chunk_id, md5(text) as digest, true as within_limits from chunks
where strlen(text) > 2048 and chunk_id in (select unnest(top_chunk_ids) from search_hits)""",
    "p7_verbatim": "with " + _LEAKS + "select doc_id, item_id from leaks",
    "p7_touched": "with " + _LEAKS + "select distinct doc_id from leaks",
}
