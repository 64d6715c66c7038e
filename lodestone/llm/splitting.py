"""Splitting of oversized texts at natural boundaries with overlap, in SQL functions only.

The UTF-8 bytes of a text are viewed as a string with one character per byte, so that a bounded
quantifier counts bytes.  One regular expression then cuts it: its alternatives are ordered by
the strength of the boundary they end at (paragraph, line, sentence, word), each takes as much
as the limit allows, and the last one falls back to a character border.  Overlap comes from
offsets: a piece starts up to ``overlap`` characters before the end of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
OVERLAP = 200


def cut_pattern(limit: int) -> str:
    """Pattern over bytes whose successive matches cover a text in parts of at most ``limit``."""
    ends = [
        r"(?<=\n[ \t]{0,8}\r?\n)",  # paragraph
        r"(?<=\n)",  # line
        r"(?<=[.!?;:]\s)|(?<=\xE3\x80\x82|\xEF\xBC\x81|\xEF\xBC\x9F)",  # sentence, also of Japanese
        r"(?<=\s)(?=\S)",  # word
    ]
    half = max(1, limit // 2)
    far = [rf".{{{half},{limit}}}(?:{end})" for end in ends]
    near = [rf".{{1,{half}}}(?:{end})" for end in ends]
    return "(?s)" + "|".join([rf".{{1,{limit}}}\z", *far, *near, rf".{{1,{limit}}}(?![\x80-\xBF])"])


def as_bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def as_text(octets: Column) -> Column:
    return F.decode(F.encode(octets, "ISO-8859-1"), "UTF-8")


def running_sums(sizes: Column, block: int = 512) -> Column:
    """Sums of all earlier entries of an array, by blocks, so that appending costs little for long arrays."""
    append = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    blocks = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(block))
    totals = F.transform(blocks, lambda i: F.aggregate(F.slice(sizes, i, F.lit(block)), F.lit(0), lambda a, x: a + x))
    bases = F.aggregate(totals, F.array(F.lit(0)), append)
    within = lambda i, base: F.slice(F.aggregate(F.slice(sizes, i, F.lit(block)), F.array(base), append), 1, block)
    return F.slice(F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), within)), F.lit(1), F.size(sizes))


def split_oversized(df: DataFrame, key: str, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, keep columns, piece_no, begins, overlap, piece) of the texts of more than ``limit`` bytes.

    ``begins`` is the character offset of the piece in the text, counted from 0, ``overlap`` the
    number of characters it repeats from the end of what the piece before adds; leaving those out
    and joining the pieces by ``piece_no`` gives the text back.  A null or empty text, or one within
    the limit, gives no piece.  The bytes kept free for the overlap follow from the widest character
    of the text (1 to 4 bytes), so every piece of ``overlap`` + new characters stays within ``limit``.

    Pieces are made inside the array of parts, each from the tail of the part before and its own
    part, so the work is linear in the length of a text and no row carries the whole text.
    """
    if limit <= 4 * overlap + 4:
        raise ValueError("limit must exceed four bytes for each character of overlap")
    large = df.select(key, *keep, F.col(text).alias("_text")).where(F.octet_length("_text") > limit)
    octets = as_bytes(F.col("_text"))
    width = F.when(F.octet_length("_text") == F.length("_text"), 1).when(octets.rlike(r"[\xF0-\xFF]"), 4).when(octets.rlike(r"[\xE0-\xEF]"), 3).otherwise(2)
    parts = F.lit(None)
    for w in (1, 2, 3, 4):
        parts = F.when(F.col("_width") == w, F.regexp_extract_all("_octets", F.lit(cut_pattern(limit - w * overlap)), F.lit(0))).otherwise(parts)
    cut = large.select(key, *keep, octets.alias("_octets"), width.alias("_width")).withColumn("_parts", F.transform(parts, as_text)).drop("_octets")
    tails = F.transform("_parts", lambda p: F.right(p, F.lit(overlap)))
    before = F.concat(F.array(F.lit("")), F.slice(tails, F.lit(1), F.size("_parts") - 1))
    cut = cut.withColumn("_before", before).withColumn("_starts", running_sums(F.transform("_parts", F.length)))
    pieces = cut.select(key, *keep, F.posexplode(F.arrays_zip("_before", "_parts", "_starts")).alias("piece_no", "_p"))
    return pieces.select(
        key, *keep, "piece_no", (F.col("_p._starts") - F.length("_p._before")).alias("begins"), F.length("_p._before").alias("overlap"),
        F.concat("_p._before", "_p._parts").alias("piece"),
    )


def rejoined(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text, pieces, largest, most_overlap) put together again from pieces, in their order."""
    own = F.struct("piece_no", F.substring("piece", F.col("overlap") + 1, F.length("piece")).alias("new"))
    whole = pieces.groupBy(key).agg(  # the pieces of one text
        F.array_sort(F.collect_list(own)).alias("_p"), F.count("*").alias("pieces"), F.max(F.octet_length("piece")).alias("largest"), F.max("overlap").alias("most_overlap")
    )
    return whole.select(key, F.array_join(F.col("_p.new"), "").alias("text"), "pieces", "largest", "most_overlap")


def named_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, heading, text) of the chunks that at least one hit names, each once.

    Ids that no chunk bears are dropped; null arrays and null ids name nothing.
    """
    named = hits.select(F.explode("top_chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()
    large = chunks.where(F.octet_length("text") > LIMIT).select("chunk_id", "doc_id", "heading", "text").distinct()
    return large.join(named, "chunk_id", "left_semi")


def chunk_pieces(hits: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the oversized chunks that hits name, under the chunk's heading (may be null)."""
    return split_oversized(named_chunks(hits, chunks), "chunk_id", "text", ["doc_id", "heading"], limit, overlap)


def snippet_pieces(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, piece_no): the pieces that hold the beginning of their record's snippet.

    A snippet is the start of a chunk with line breaks made spaces and, when cut, ``...`` at its
    end; both sides are compared with runs of blanks made one space.  Null and blank snippets
    are found nowhere.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wanted = hits.where("snippet is not null").select("doc_id", squeeze(F.regexp_replace("snippet", r"\.\.\.$", "")).alias("_wanted")).where("_wanted <> ''").distinct()
    return pieces.join(wanted, "doc_id").where(F.contains(squeeze(F.col("piece")), F.col("_wanted"))).select("doc_id", "chunk_id", "piece_no").distinct()
