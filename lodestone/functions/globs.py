"""Two dialects of path globs as regular expressions for ``rlike``; compiled on the driver."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"(\*\*/)|(\*\*)|(\*)|(\?)|(\[[!\]]?[^\]]*\])|(.)", re.S)
_INTO = ("(?:.*/)?", ".*", "[^/]*", "[^/]")


def policy_regex(glob: str) -> str:
    """A policy glob as a regular expression over the whole relative path.

    ``**/`` is any folders, ``**`` anything, ``*`` and ``?`` stay within a name, classes are
    taken as they are.  A leading slash anchors; a name with wildcards and without slash matches
    at any depth, a plain name only at the root; a trailing slash also means all below.
    """
    text = glob.replace("\\", "/").strip()
    anchored, text = text.startswith("/"), text.removeprefix("/")
    folder, text = text.endswith("/"), text.rstrip("/")
    body = ""
    for match in _PIECE.finditer(text):
        kind = match.lastindex - 1
        body += _INTO[kind] if kind < 4 else match.group() if kind == 4 else re.escape(match.group())
    nested = "/" in text.replace("**/", "").replace("**", "")
    floating = not anchored and not nested and any(c in text for c in "*?[")
    whole = f"(?:.*/)?{body}" if floating else body
    return f"(?s)^(?:{whole})$" + (f"|^{body}/.*$" if folder else "")


def ignore_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression: ``*`` crosses slashes where the pattern has one,
    a pattern without slash matches any part of the path, a trailing slash any folder of that name."""
    text = pattern.strip().replace("\\", "/").strip("/")
    if pattern.strip().endswith("/"):
        return rf"(^|/){re.escape(text)}(/|$)"
    inner = fnmatch.translate(text).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
    if "/" in text:
        return f"(?s)^(?:{inner})$"
    return f"(^|/)(?:{inner.replace('.*', '[^/]*')})(/|$)"


@dataclass(frozen=True)
class Policy:
    """Which paths are indexed.  ``repo:glob`` in include and exclude holds for that repository only."""

    mode: str = "denylist"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    repos: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if self.mode not in ("allowlist", "denylist"):
            raise ValueError("mode must be allowlist or denylist")
        if self.mode == "allowlist" and not self.include:
            raise ValueError("an allowlist needs patterns to include")
        if any(not p.strip() or p.strip().startswith("#") for p in (*self.include, *self.exclude)):
            raise ValueError("empty pattern")


def first_match(patterns: tuple[str, ...], path: Column, repo: Column, repos: frozenset[str], ignore: bool = False) -> Column:
    """The first pattern that matches, null if none does."""
    out = F.lit(None).cast("string")
    for raw in reversed(patterns):
        scope, _, rest = raw.partition(":")
        if not ignore and rest and scope in repos:
            hit = (repo == scope) & path.rlike(policy_regex(rest.lstrip("/")))
        else:
            hit = path.rlike(ignore_regex(raw) if ignore else policy_regex(raw))
        out = F.when(hit, raw).otherwise(out)
    return out


def decided(path: Column, repo: Column, policy: Policy) -> Column:
    """STRUCT(allowed, reason, matched_include, matched_exclude, matched_ignore).

    Order: not included (allowlist only), excluded, ignored, allowed; later layers aren't
    consulted once one denies.  A null path is denied as ``no_path``.
    """
    included = first_match(policy.include, path, repo, policy.repos) if policy.mode == "allowlist" else F.lit(None).cast("string")
    excluded = first_match(policy.exclude, path, repo, policy.repos)
    ignored = first_match(policy.ignore, path, repo, policy.repos, ignore=True)
    missing = F.lit(policy.mode == "allowlist") & included.isNull()
    reason = F.when(path.isNull(), "no_path").when(missing, "not_included").when(excluded.isNotNull(), "excluded").when(ignored.isNotNull(), "ignored").otherwise("allowed")
    none = F.lit(None).cast("string")
    return F.struct(
        (reason == "allowed").alias("allowed"), reason.alias("reason"), included.alias("matched_include"),
        F.when(reason == "excluded", excluded).otherwise(none).alias("matched_exclude"), F.when(reason == "ignored", ignored).otherwise(none).alias("matched_ignore"),
    )
