"""Column functions on text: tokens, ids of gaps, symbols, paths, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.vocab import STOPWORDS

# The forms of tokens, gap ids and symbols that results depend on.
TOKEN = r"[a-z0-9][a-z0-9_\-]*"
RUN = r"[a-z0-9_\-]+"
GAP_ID = r"(?U)\b[A-Z]{2,5}(?:-[A-Z0-9]+){1,5}-[0-9]{2,}\b"
GAP_PREFIX = r"^([A-Z]{2,5}-[A-Z0-9]+)"
PASCAL = r"^[A-Z][a-zA-Z0-9]+$"
QUOTED_SYMBOL = r"`([A-Z][A-Za-z0-9]{2,})`"
PROSE_SYMBOL = r"\b([A-Z][a-zA-Z0-9]*(?:ServiceImpl|Service|Controller|Client|Filter|Config|Configuration|Utils|Resolver|Limiter|Guard))\b"
# Fixed value: a part of a name in camel case.
CAMEL_PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"
# Names that are no symbols, and endings of such.
UNLINKED_SYMBOLS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "JSON", "URL", "HTTP", "HTTPS", "API", "JWT", "SQL", "Authorization", "Bearer"]
UNLINKED_SUFFIXES = ("Payload", "Dto", "DTO")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strings(values: Column) -> Column:
    """An array without null elements; null becomes empty."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())


def tokens(query: Column) -> Column:
    """Tokens of a query in order, with repetitions."""
    return F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(TOKEN), F.lit(0))


def significant(words: Column) -> Column:
    """Tokens that are neither stop words nor single characters."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def runs(text: Column) -> Column:
    """Distinct maximal runs of token characters: a token occurs in a text iff it occurs in a run."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0)))


def gap_ids(text: Column) -> Column:
    """Sorted distinct gap ids of a text; ids of decisions and contracts are none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GAP_ID), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda g: ~g.startswith("ADR-") & ~g.contains("-CONTRACT-"))))


def gap_prefix(gap: Column) -> Column:
    """The register a gap id belongs to; the whole id where it has no such prefix."""
    upper = F.upper(gap)
    prefix = F.regexp_extract(upper, GAP_PREFIX, 1)
    return F.when(prefix == "", upper).otherwise(prefix)


def linkable(symbol: Column) -> Column:
    """Whether a name can be linked to an anchor."""
    keep = symbol.rlike(PASCAL) & (F.length(symbol) >= 3) & (symbol != F.upper(symbol)) & ~symbol.isin(*UNLINKED_SYMBOLS)
    for suffix in UNLINKED_SUFFIXES:
        keep = keep & ~symbol.endswith(suffix)
    return keep


def mentioned_symbols(text: Column) -> Column:
    """Distinct symbols a text mentions, quoted ones first, then those in prose by their suffix."""
    source = F.coalesce(text, F.lit(""))
    both = F.concat(F.regexp_extract_all(source, F.lit(QUOTED_SYMBOL), F.lit(1)), F.regexp_extract_all(source, F.lit(PROSE_SYMBOL), F.lit(1)))
    return F.array_distinct(F.filter(both, linkable))


def symbol_stems(symbol: Column) -> Column:
    """Lower-cased symbol and its prefixes of at least two camel-case parts, five characters or more."""
    parts = F.regexp_extract_all(F.trim(symbol), F.lit(CAMEL_PART), F.lit(0))
    prefixes = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.size(parts), F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))).otherwise(F.array().cast("array<string>"))
    stems = F.transform(F.concat(F.array(F.trim(symbol)), prefixes), F.lower)
    return F.array_distinct(F.filter(stems, lambda s: F.length(s) >= 5))


def snippet(text: Column, most: int = 200) -> Column:
    """Text with line breaks as blanks, trimmed and cut to ``most`` characters with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "), r"^\s+|\s+$", "")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def truncated(text: Column, most: Column) -> Column:
    """At most ``most`` characters, the last three as an ellipsis where cut; unchanged for 0 or less.

    Limits of 1 and 2 give that many dots.
    """
    cut = F.concat(F.left(text, F.greatest(most - 3, F.lit(0))), F.left(F.lit("..."), F.least(most, F.lit(3))))
    return F.when((most <= 0) | (F.length(text) <= most), text).otherwise(cut)


def plain_path(path: Column) -> Column:
    """Forward slashes, without leading dots and slashes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", "")


def path_suffixes(path: Column) -> Column:
    """The path and all that follows one of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def beginnings(text: Column) -> Column:
    """All beginnings of a text, from one character to the whole; none of an empty one."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.left(text, n))).otherwise(F.array().cast("array<string>"))


def curated_keywords(whole: list[Column], split: list[Column], then: list[Column] | None = None, lists: list[Column] | None = None, most: int = 30) -> Column:
    """Whole values, the alphanumeric parts of others, then more whole values and the parts of lists: lower-cased, two characters or more, first occurrences."""
    one = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9]+"), F.lower)
    parts = F.concat(F.array(*map(one, whole)), *map(cut, split), *(F.array(one(c)) for c in then or []), *(F.flatten(F.transform(strings(c), cut)) for c in lists or []))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)), 1, most)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
