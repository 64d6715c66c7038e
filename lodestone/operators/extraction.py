"""What markdown documents hold: front matter, titles, headings, keywords, gaps, sections and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Headings kept per document; sizes at which texts are cut into chunks.
MOST_HEADINGS = 20
SINGLE_CHUNK_BYTES, CHUNK_BYTES = 8192, 2048
# Kinds whose texts are always cut at their sections.
SECTIONED_KINDS = ["contract", "known_gaps"]


def lines_of(text: Column) -> Column:
    """Text with all line ends made line feeds."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def front_matter(text: Column) -> Column:
    """The block between two ``---`` lines at the very start; empty if there is none or it isn't closed."""
    return F.regexp_extract(lines_of(text), r"(?s)\A[ \t]*---[ \t]*\n(.*?)(?<=\n)[ \t]*---[ \t]*(?:\n|\z)", 1)


def body(text: Column) -> Column:
    """The text after the front matter, without white space at its start."""
    plain = lines_of(text)
    rest = F.regexp_replace(plain, r"(?s)\A[ \t]*---[ \t]*\n(?:.*?\n)??[ \t]*---[ \t]*(?:\n|\z)", "")
    return F.when(plain == rest, plain).otherwise(F.regexp_replace(rest, r"\A\s+", ""))


def meta_value(block: Column, key: str) -> Column:
    """A scalar of the front matter, trimmed; null where the key is missing or has no value."""
    return F.nullif(X.stripped(F.regexp_extract(block, rf"(?m)^{key}[ \t]*:(.*)$", 1)), F.lit(""))


def headings(text: Column, deepest: int = 3, most: int = MOST_HEADINGS) -> Column:
    """Headings of levels 1 to ``deepest`` in order, at most ``most``."""
    found = F.regexp_extract_all(lines_of(text), F.lit(rf"(?m)^#{{1,{deepest}}}[ \t]+(\S.*)$"), F.lit(1))
    return F.slice(F.transform(found, lambda h: F.regexp_replace(h, r"^\s+|\s+$", "")), 1, most)


def title(text: Column, fallback: Column) -> Column:
    """The first heading of level 1, else the fallback."""
    first = F.regexp_extract(lines_of(text), r"(?m)^#[ \t]+(\S.*)$", 1)
    return F.coalesce(F.nullif(X.stripped(first), F.lit("")), fallback)


def outlines(documents: DataFrame) -> DataFrame:
    """One row per document: title, headings, keywords, gaps and front matter values, as strings.

    Null texts have no headings, gaps or values.
    """
    block, rest = front_matter(F.col("text")), body(F.col("text"))
    with_parts = documents.select("doc_id", "repo", "kind", "title", "text").withColumn("_block", block).withColumn("_body", rest)
    name = title(F.col("_body"), F.coalesce("title", F.lit("")))
    return with_parts.select(
        "doc_id", name.alias("title"), F.array_join(headings(F.col("_body")), " | ").alias("headings"),
        F.array_join(X.curated_keywords([F.col("repo"), F.col("kind")], [name]), " ").alias("keywords"),
        F.array_join(X.gap_ids(F.col("_body")), " ").alias("gap_ids"),
        meta_value(F.col("_block"), "id").alias("external_id"), meta_value(F.col("_block"), "status").alias("status"),
    )


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, section): texts cut at level-2 headings where they are large or of sectioned kinds.

    Small texts of other kinds are one section under the title; empty sections are left out,
    numbers count all.
    """
    rows = documents.where("text is not null").select("doc_id", "kind", F.coalesce("title", F.lit("")).alias("_title"), lines_of(F.col("text")).alias("_text"))
    whole = ~F.coalesce(F.col("kind").isin(*SECTIONED_KINDS), F.lit(False)) & (F.octet_length("_text") <= SINGLE_CHUNK_BYTES)
    parts = F.when(whole, F.array("_text")).otherwise(F.split("_text", r"(?m)^(?=##[ \t]+\S)"))
    each = rows.select("doc_id", "_title", whole.alias("_whole"), F.posexplode(parts).alias("section_no", "_part"))
    starts = ~F.col("_whole") & F.col("_part").rlike(r"\A##[ \t]+\S")
    heading = F.when(starts, F.trim(F.regexp_extract("_part", r"\A##[ \t]+(.*)", 1))).otherwise(F.col("_title"))
    content = F.regexp_replace(F.when(starts, F.regexp_replace("_part", r"\A##[^\n]*\n?", "")).otherwise(F.col("_part")), r"\A\s+|\s+\z", "")
    return each.select("doc_id", "section_no", heading.alias("heading"), content.alias("section")).where("section <> ''")


def packed_sections(documents: DataFrame, target: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, chunk_no, heading, chunk): sections, large ones packed from paragraphs up to ``target`` bytes.

    Paragraphs are taken greedily in order; one above the target stands alone.  The packing of a
    section is one fold over its paragraphs.
    """
    paragraphs = F.filter(F.transform(F.split("section", "\n\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")
    joined = lambda a, b: F.concat(a, F.lit("\n\n"), b)
    empty = F.array().cast("array<string>")

    def pack(done: Column, paragraph: Column) -> Column:
        last = F.element_at(done, -1)
        fits = F.octet_length(last) + F.octet_length(paragraph) + 2 <= target
        return F.when(F.size(done) == 0, F.array(paragraph)).when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, paragraph)))).otherwise(F.concat(done, F.array(paragraph)))

    chunks = F.when(F.octet_length("section") <= target, F.array("section")).otherwise(F.aggregate(paragraphs, empty, pack))
    rows = sections(documents).select("doc_id", "section_no", "heading", F.posexplode(chunks).alias("_n", "chunk"))
    return rows.select("doc_id", "section_no", F.col("_n").alias("part_no"), "heading", "chunk")


def inline_links(documents: DataFrame) -> DataFrame:
    """(doc_id, target, link_class): targets of inline markdown links outside code, images excepted; distinct.

    Classes: external (a scheme or //), anchor (within the page), local.
    """
    plain = F.regexp_replace(lines_of(F.col("text")), r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*(```|~~~)[^\n]*$|\z)", "")
    bare = F.regexp_replace(plain, r"`[^`\n]*`", " ")
    found = documents.select("doc_id", F.explode(F.regexp_extract_all(bare, F.lit(r"(?<!!)\[[^\]\n]+\]\(([^)\n]+)\)"), F.lit(1))).alias("target")).distinct()
    kind = F.when(F.col("target").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)"), "external").when(F.col("target").startswith("#"), "anchor").otherwise("local")
    return found.withColumn("link_class", kind)


def resolved_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, target, link_class) of inline links (repo, path, target) against the files (repo, path) that exist.

    Classes: skip_external, skip_anchor, ok, repo_not_there (the target leaves its repository for
    one without files) and target_not_found.  A target is taken from its file's folder, one with a
    leading slash from the repository's; fragments and queries are left out, folders count as files.
    """
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("target", r"\\+", "%2B")), r"[?#].*$", "")
    start = F.when(plain.startswith("/"), F.array("repo")).otherwise(F.concat(F.array("repo"), F.filter(F.split("path", "/"), lambda p: p != ""), F.array().cast("array<string>")))
    folder = F.when(plain.startswith("/"), start).otherwise(F.slice(start, F.lit(1), F.size(start) - 1))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    whole = F.array_join(F.aggregate(F.split(plain, "/"), folder, step), "/")
    kind = F.when(F.col("target").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)"), "skip_external").when(F.col("target").startswith("#"), "skip_anchor")
    rows = links.select("repo", "path", "target").distinct().withColumn("_k", kind).withColumn("_at", F.when(F.col("_k").isNull(), whole)).withColumn("_r", F.substring_index("_at", "/", 1))
    parts = F.split(F.concat("repo", F.lit("/"), "path"), "/")
    there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_at")).distinct().withColumn("_there", F.lit(True))
    repos = files.select(F.col("repo").alias("_r")).distinct().withColumn("_cloned", F.lit(True))
    judged = rows.join(there, "_at", "left").join(repos, "_r", "left")
    found = F.coalesce("_k", F.when(F.col("_there"), "ok").when(F.col("_cloned").isNull(), "repo_not_there").otherwise("target_not_found"))
    return judged.select("repo", "path", "target", found.alias("link_class"))
