"""Files that nobody wrote by hand here: generated, minified, vendored, or data saved as code.

Third-party copies are found by winnowing: every window of a normalized token stream gives its
least k-gram hash as fingerprint, and a file most of whose fingerprints recur elsewhere in the way
that third-party code recurs is a copy, with or without local edits.  A fingerprint recurs like that

* if it stands in a large share of all unrelated repositories, or
* if it stands in several unrelated repositories and enough of them keep a copy as third-party
  code, by its folder or its licence.

Code that own repositories share recurs too, but nobody keeps it as third-party code, and single
repositories that do so don't outweigh the others.  Repositories that have most of their own files
in common (forks, splits) are one family and count once.  A folder or licence that says third-party
also decides for the file itself; so do its path and its own text for the other three kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

GRAM = 12
WINDOW = 16
#: share of a file's fingerprints that must recur, at the lower bound of its confidence interval
SHARE = 0.5
#: share of all unrelated repositories (lower bound) in which a fingerprint recurs like a library's
WIDE = 0.2
#: least unrelated repositories a fingerprint stands in, and share of them and of the files that keep it as third-party code
REPOS, KEPT = 2, 0.25
#: share of a repository's own files, and least number of them, that it has in common with a relative
RELATED, RELATED_FILES = 0.5, 2
#: width of the confidence intervals in standard deviations
DEVIATIONS = 2.0
#: fingerprints in more than this share of all files are joined by broadcast; there are at most
#: (fingerprints per file / share) of them, whatever the number of files
HEAVY = 0.01
_SALTS = 16

# Folders and names that tools give to their output and to third-party code.
GENERATED_PATH = r"(?i)(^|/)(gen|__generated__|generated|generated-sources|generated-src|autogen)/|_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h)$|\.(g|gen|generated|designer|freezed)\.\w+$"
MINIFIED_PATH = r"(?i)[.-]min\.(js|css|mjs)$|[.-]bundle\.(js|css|mjs)$|\.chunk\.(js|css|mjs)$|\.min\.map$"
VENDORED_PATH = r"(?i)(^|/)(vendor|node_modules|third[_-]party|thirdparty|bower_components|site-packages|extern|external)/[^/]+/|(^|/)lib/[\w.]+-\d+(\.\d+)+/"

# What a tool says about its output.  A comment counts if one of its clauses is such a statement
# from its beginning: then the file itself is its subject.  A clause that merely holds the words,
# as the object of another verb, is about something else.
_CLAUSE = re.compile(r"[.;,!|]+(?=\s|\W*$)|\s[-\u2013\u2014]+\s|(?<=\s)(?=do not (?:edit|modify|change)\W*$)|[<>]", re.I)
_MADE = r"(?:generated|produced|created|written|emitted|compiled)"
_STATEMENT = re.compile(
    rf"""(?ix) ^\W*(?:
      @generated\b | auto-?generated\b | automatically\s+generated\b | machine[\s-]+(?:written|generated)\b
    | (?:this\s+|the\s+)?(?:file|code|source|module|class|content)s?\s+(?:(?:is|was|has\s+been|are|were)\s+)?(?:auto(?:matically)?[\s-]*)?{_MADE}\s+(?:by|from|with|using|automatically)\b
    | this\s+\w+\s+(?:is|was|has\s+been)\s+(?:auto(?:matically)?[\s-]*)?{_MADE}\s+(?:by|from|with|using|automatically)\b
    | generated\s+(?:by|from|with|using)\b | output\s+of\s+(?:the\s+)?\S+\s+(?:codegen|generator|compiler)\b
    | (?:please\s+)?do\s+not\s+(?:edit|modify|change)\b
    | (?:manual\s+|your\s+|any\s+)?(?:changes|edits)\s+(?:are|will\s+be|get)\s+(?:lost|overwritten)\b | edit\s+the\s+source\b
    | (?:diese\s+datei\s+(?:ist|wurde)\s+)?automatisch\s+(?:erzeugt|generiert|erstellt)\b | (?:bitte\s+)?nicht\s+(?:\w+\s+)?(?:\u00e4ndern|bearbeiten|editieren)\b
    | (?:ce\s+)?fichier\s+(?:est\s+)?g\u00e9n\u00e9r\u00e9\b | g\u00e9n\u00e9r\u00e9\s+(?:automatiquement|par)\b | ne\s+pas\s+(?:modifier|\u00e9diter)\b
    | (?:este\s+)?archivo\s+(?:fue\s+)?generado\b | generado\s+(?:autom\u00e1ticamente|por)\b | no\s+(?:editar|modificar)\b
    )"""
)
# Words without which no statement of a tool and no licence of others can stand.
_HINT = re.compile(r"(?i)genera|g\u00e9n\u00e9r|generi|erzeugt|erstellt|produced|created|written|emitted|compil|codegen|edit|modif|change|nicht|machine|licens|\(c\)|copyright|redistrib|permission")
_LICENCE = re.compile(r"(?i)\blicensed to you under\b|\(c\) (\d{4}\S* )?the \S+ (contributors|authors)\b|copyright \(c\) .*\b(authors|contributors)\b|\bredistribution and use in source and binary forms\b|\bpermission is hereby granted, free of charge\b")
_COMMENT_START = ("//", "#", "/*", "*", "<!--", "--", '"""', "'''", ";", "%")
#: literals and what stands between them
_LITERAL = re.compile(r"""["'][^"'\n]*["']|-?\b0x[0-9a-fA-F]+\b|-?\b\d[\d.]*\b|[\s,:\[\]{}();+]""")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"[^\"\n]*\"|'[^'\n]*'|[^\s\w]")
_COMMENT_LINE = re.compile(r"(?m)^[ \t]*(?://|#|/\*|\*|<!--|--|\"\"\"|''').*$")

#: characters of a line beyond which it counts as long; characters that weigh as one observation
LONG_LINE, UNIT = 300, 8
#: lower bounds from which literals make a text data, and repeated line shapes generated
DATA_SHARE, REPEATED_SHARE = 0.7, 0.5


def lower_bound(hits: float, of: float, deviations: float = DEVIATIONS) -> float:
    """Lower end of Wilson's interval of a share: few observations bear little."""
    if of <= 0:
        return 0.0
    z = deviations * deviations
    share = min(1.0, max(0.0, hits / of))
    return (share + z / (2 * of) - deviations * ((share * (1 - share) + z / (4 * of)) / of) ** 0.5) / (1 + z / of)


def lower_bound_of(hits: Column, of: Column, deviations: float = DEVIATIONS) -> Column:
    """The same of columns."""
    z = deviations * deviations
    share = hits / of
    return (share + z / (2 * of) - deviations * F.sqrt((share * (1 - share) + z / (4 * of)) / of)) / (1 + z / of)


def _comments(lines: list[str]) -> list[str]:
    return [s for line in lines if (s := line.strip()).startswith(_COMMENT_START)]


def states_origin(comment: str) -> bool:
    """Whether a clause of the comment says that a tool made this file."""
    return any(_STATEMENT.match(clause) for clause in _CLAUSE.split(comment) if clause)


def own_reason(text: str) -> str | None:
    """Why a text isn't written by hand, from itself alone: generated, minified, data or vendored."""
    if not text or text.isspace():
        return None
    lines = [line for line in text.splitlines() if line.strip()]
    comments = _comments(lines)
    telling = [c for c in comments if _HINT.search(c)]
    if any(_LICENCE.search(c) for c in telling):
        return "vendored"
    if any(states_origin(c) for c in telling):
        return "generated"
    code = [line for line in lines if not line.lstrip().startswith(_COMMENT_START)] or lines
    size = sum(map(len, code))
    long = [line for line in code if len(line) > LONG_LINE]
    sample = text if len(comments) == 0 else "\n".join(code)
    literal = len(sample) - len(_LITERAL.sub("", sample))
    if lower_bound(literal / UNIT, len(sample) / UNIT) >= DATA_SHARE:
        return "data"
    # dense code in long lines; prose and messages in long lines have a blank for every word
    if sum(map(len, long)) > 0.5 * size:
        blanks = sum(line.count(" ") + line.count("\t") for line in long)
        if blanks < 0.08 * sum(map(len, long)):
            return "minified"
    shapes = len({_DIGITS.sub("0", line.strip()) for line in code})
    if lower_bound(len(code) - shapes, len(code)) >= REPEATED_SHARE:
        return "generated"
    return None


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint), distinct: winnowed hashes of the texts' normalized tokens.

    Comment lines are left out, numbers are alike, strings are alike.  A text of fewer tokens
    than a k-gram has none.
    """
    known: dict[str, int] = {}
    codes: list[int] = []
    sizes = []
    for text in texts:
        tokens = _TOKEN.findall(_COMMENT_LINE.sub("", text))
        sizes.append(len(tokens))
        for t in tokens:
            c = known.get(t)
            if c is None:
                c = known[t] = xxhash.xxh3_64_intdigest("0" if t[0].isdigit() else '"' if t[0] in "\"'" and len(t) > 1 else t)
            codes.append(c)
    total = len(codes)
    if total < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = np.array(codes, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = total - gram + 1
    hashed = np.zeros(n, np.uint64)
    for j in range(gram):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + token[j : j + n]
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    hashed[owner[:n] != owner[gram - 1 :]] = top
    least = hashed.copy()
    of = owner[:n]
    for j in range(1, min(window, n)):
        same = of[j:] == of[:-j]
        np.minimum(least[:-j], np.where(same, hashed[j:], top), out=least[:-j])
    keep = least != top
    keep[1:] &= (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    owner, print_ = of[keep], least[keep].view(np.int64)
    order = np.lexsort((print_, owner))
    owner, print_ = owner[order], print_[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (print_[1:] != print_[:-1])
    return owner[first], print_[first]


def path_reason(path: Column) -> Column:
    """Why a path alone says that a file isn't written by hand; null otherwise."""
    plain = F.translate(path, "\\", "/")
    return F.when(plain.rlike(VENDORED_PATH), "vendored").when(plain.rlike(GENERATED_PATH), "generated").when(plain.rlike(MINIFIED_PATH), "minified")


_CHUNK = 2000


def examined(files: DataFrame) -> DataFrame:
    """(file, repo, path, reason, kept, prints) of every row, by its own path and text.

    ``file`` numbers repo, path and text, so re-delivered rows have the same; ``kept`` tells that
    the path or a licence says third-party.  Texts go through one task each and aren't shuffled.
    """
    rows = files.select(F.xxhash64("repo", "path", "text").alias("file"), "repo", "path", "text", path_reason(F.col("path")).alias("by_path"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), _CHUNK):
                part = batch.iloc[begin : begin + _CHUNK]
                texts = [t or "" for t in part["text"]]
                by_text = [own_reason(t) for t in texts]
                by_path = [p if isinstance(p, str) else None for p in part["by_path"]]
                owner, prints = fingerprints(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists = [prints[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                both = list(zip(by_path, by_text, strict=True))
                yield pd.DataFrame({"file": part["file"], "repo": part["repo"], "path": part["path"], "reason": [p or t for p, t in both], "kept": ["vendored" in b for b in both], "prints": lists})

    return rows.mapInPandas(look, "file bigint, repo string, path string, reason string, kept boolean, prints array<bigint>")


def families(seen: DataFrame, share: float = RELATED, least: int = RELATED_FILES) -> DataFrame:
    """(r, family) of the repositories that have most of their own files in common with another.

    Files are compared by their two least fingerprints.  Each file that several repositories have
    speaks for the least of them; a repository whose files speak for the same other one often
    enough belongs to it.  No pairs of repositories are made.
    """
    own = seen.where(~F.col("kept") & (F.size("prints") > 1)).select(F.xxhash64("repo").alias("r"), F.xxhash64(F.slice("prints", 1, 2)).alias("f")).distinct()
    head = own.groupBy("f").agg(F.min("r").alias("family"), F.count("*").alias("n")).where("n > 1").select("f", "family")
    had = own.groupBy("r").agg(F.count("*").alias("n_own"))
    common = own.join(head, "f").where("r <> family").groupBy("r", "family").agg(F.count("*").alias("n"))
    best = common.groupBy("r").agg(F.max_by("family", F.struct("n", "family")).alias("family"), F.max("n").alias("n"))
    return best.join(had, "r").where((F.col("n") >= least) & (F.col("n") >= share * F.col("n_own"))).select("r", "family")


def recurrence(seen: DataFrame, share: float = SHARE, wide: float = WIDE, repos: int = REPOS, kept_share: float = KEPT) -> DataFrame:
    """(file, like): files whose fingerprints largely recur, ``kept`` like third-party copies or ``wide`` over all repositories.

    ``seen``: a table of ``examined``, read several times.  Counts are of families of
    repositories: first one row per fingerprint and family, then one per fingerprint.
    """
    related = families(seen).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    once = seen.where(F.size("prints") > 0).select("file", "kept", "prints", "repo").dropDuplicates(["file"])
    files = once.select("file", "kept", "prints", F.xxhash64("repo").alias("r"), F.pmod("file", F.lit(_SALTS)).cast("int").alias("salt"))
    files = materialize(files.join(related, ["r", "salt"], "left").select("file", "kept", "prints", F.coalesce("family", "r").alias("family")), "files-of-families")
    each = files.select("file", F.size("prints").alias("n_prints"), F.explode("prints").alias("print"))
    by_family = files.select("family", "kept", F.explode("prints").alias("print")).groupBy("print", "family").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n_files"), F.count_if("kept").alias("kept_files"))
    counted = by_family.groupBy("print").agg(F.count("*").alias("n"), F.sum("kept").alias("n_kept"), F.sum("n_files").alias("n_files"), F.sum("kept_files").alias("kept_files")).where(F.col("n") >= repos)
    totals = files.agg(F.count_distinct("family").alias("all_families"), F.count("*").alias("all_files"))
    judged = counted.crossJoin(totals).select(  # one row of totals
        "print", ((F.col("n_kept") >= kept_share * F.col("n")) & (F.col("kept_files") >= kept_share * F.col("n_files"))).alias("is_kept"), (lower_bound_of(F.col("n"), F.col("all_families")) >= wide).alias("is_wide"), (F.col("n_files") > HEAVY * F.col("all_files")).alias("heavy"),
    ).where("is_kept or is_wide")
    judged = materialize(judged, "recurring-prints")
    common = F.broadcast(judged.where("heavy").drop("heavy"))  # bounded, see HEAVY
    rare = each.join(common.select("print"), "print", "left_anti").join(judged.where("not heavy").drop("heavy"), "print")
    hits = each.join(common, "print").select("file", "n_prints", "is_kept", "is_wide").unionByName(rare.select("file", "n_prints", "is_kept", "is_wide"))
    shares = hits.groupBy("file").agg(F.max("n_prints").alias("n"), F.count_if("is_kept").alias("kept"), F.count("*").alias("any"))
    enough = lambda c: lower_bound_of(F.least(F.col(c), F.col("n")), F.col("n")) >= share
    return shares.select("file", F.when(enough("kept"), "kept").when(enough("any"), "wide").alias("like")).where("like is not null")


def judged_files(files: DataFrame) -> DataFrame:
    """(repo, path, reason, like) of every distinct file that comes from elsewhere; ``like`` tells how its fingerprints recur, if they do."""
    seen = materialize(examined(files.where("path is not null")), "examined")
    found = seen.select("file", "repo", "path", "reason", "kept").join(recurrence(seen), "file", "left")
    third_party = F.col("kept") | (F.col("like") == "kept")
    reason = F.when(third_party, "vendored").otherwise(F.coalesce("reason", F.when(F.col("like").isNotNull(), "vendored")))
    return found.select("repo", "path", reason.alias("reason"), "like").where("reason is not null")


def not_hand_written(files: DataFrame) -> DataFrame:
    """(repo, path, reason) of the files that come from elsewhere; reason is generated, minified, data or vendored.

    A null, empty or blank text is judged by its path.  A null repo counts as a repository of
    its own; rows without a path are left out.  Re-delivered files count once; of several texts
    of a path, any that comes from elsewhere decides.
    """
    return judged_files(files).groupBy("repo", "path").agg(F.max("reason").alias("reason"))


def plain_path(path: Column) -> Column:
    """A path without the differences of style: slashes, a leading ``./`` or ``/``, doubled slashes, blanks, case."""
    p = F.translate(F.lower(F.trim(path)), "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, "/(\\./)*/*", "/"), r"^(\./|/)+", "")


def decisions_on_foreign(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """(decision_id, repo, path, allowed, reason): policy decisions about files found not hand-written.

    Paths are compared without their style; a decision without repo matches nothing, as a path
    alone names files of many repositories.
    """
    left = decisions.select("decision_id", "repo", "path", "allowed").distinct().withColumn("_p", plain_path(F.col("path")))
    right = found.select(F.col("repo").alias("_repo"), plain_path(F.col("path")).alias("_path"), "reason").distinct()
    return left.join(right, (F.col("repo") == F.col("_repo")) & (F.col("_p") == F.col("_path"))).select("decision_id", "repo", "path", "allowed", "reason")
