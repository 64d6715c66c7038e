import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.globs import Policy, decided, ignore_regex, policy_regex
from lodestone.operators import extraction as E
from lodestone.operators.matching import containing


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("src/**", "src/a/b.py", True), ("src/**", "lib/src/a", False), ("**/legacy/**", "legacy/x", True), ("**/legacy/**", "a/legacy/x", True), ("**/legacy/**", "alegacy/x", False),
        ("*.pem", "a/b/k.pem", True), ("package.json", "package.json", True), ("package.json", "a/package.json", False), ("/docs/*.md", "docs/a.md", True), ("/docs/*.md", "docs/a/b.md", False),
        ("a?c", "x/abc", True), ("tools/", "tools/x/y", True), ("tools/", "tools", True), ("[ab].txt", "b.txt", True), ("a.b", "axb", False), ("[x", "[x", True),
    ],
)
def test_policy_globs(glob, path, hit):
    assert bool(re.search(policy_regex(glob), path)) is hit


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("build/", "a/build/x", True), ("build/", "rebuild/x", False), ("*.log", "a/x.log", True), ("*.log", "x.log/y", True), ("a/*.key", "a/b/c.key", True), ("a/*.key", "b/a/c.key", False),
        ("[!a].txt", "b.txt", True), ("[!a].txt", "a.txt", False),
    ],
)
def test_ignore_patterns(pattern, path, hit):
    assert bool(re.search(ignore_regex(pattern), path)) is hit
    if "/" not in pattern:
        assert any(fnmatch.fnmatch(p, pattern) for p in path.split("/")) is hit


def test_policy_layers(spark):
    policy = Policy("allowlist", include=("src/**", "app:web/**"), exclude=("**/old/**",), ignore=("*.log",), repos=frozenset({"app"}))
    rows = [("x", "src/a.py"), ("x", "src/old/a.py"), ("x", "src/a.log"), ("x", "web/a"), ("app", "web/a"), ("x", None)]
    df = spark.createDataFrame(rows, "repo string, path string").select("repo", "path", decided(F.col("path"), F.col("repo"), policy).alias("d"))
    assert [r.d.reason for r in df.collect()] == ["allowed", "excluded", "ignored", "not_included", "allowed", "no_path"]
    for bad in ({"mode": "other"}, {"mode": "allowlist"}, {"exclude": (" ",)}):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_symbols_and_gaps(spark):
    assert value(spark, X.symbol_stems(F.lit("AuthLoginServiceImpl"))) == ["authloginserviceimpl", "authloginservice", "authlogin"]
    assert value(spark, X.symbol_stems(F.lit("URL"))) == []
    assert value(spark, X.gap_ids(F.lit("B-X-01 APP-KG-002, APP-KG-001 ADR-AB-01 AB-CONTRACT-03 xAPP-KG-004 APP-KG-001"))) == ["APP-KG-001", "APP-KG-002"]
    assert value(spark, X.mentioned_symbols(F.lit("uses `OrderDto` and `Foo` by PayClient, `HTTP`, payClient, `Foo`"))) == ["Foo", "PayClient"]
    assert value(spark, X.tokens(F.lit("The a-b_c, the 9x!"))) == ["the", "a-b_c", "the", "9x"]
    assert value(spark, X.plain_path(F.lit("./.github\\x"))) == "github/x"
    assert value(spark, X.path_suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]


@pytest.mark.parametrize(("text", "most", "expected"), [("abcdef", 0, "abcdef"), ("abcdef", 6, "abcdef"), ("abcdef", 5, "ab..."), ("abcdef", 2, ".."), ("abcdef", 3, "...")])
def test_truncated(spark, text, most, expected):
    assert value(spark, X.truncated(F.lit(text), F.lit(most))) == expected


def test_containing_equals_all_pairs(spark):
    needles = ["a", "ab", "abc", "token", "_x", "zz", "", None]
    runs = ["abcabc", "my_token-a", "x_x", "b", "", None, "zzz"]
    got = {tuple(r) for r in containing(spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(r,) for r in runs], "r string"), "r").collect()}
    assert got == {(n, r) for n in needles for r in runs if n and r and n in r}


DOC = "---\nid: APP-1\nstatus: draft\nowner:\n  team: x\n---\n\n# Title here\r\ntext APP-KG-001\n## One\nalpha\n\nbeta\n##Not\n## Two\n### deep\n"


def test_markdown(spark):
    df = spark.createDataFrame([(1, "r", "contract", "T", DOC), (2, "r", "doc", None, None), (3, "r", "doc", "Plain", "---\nid: x\nno end"), (4, None, None, None, "")], "doc_id long, repo string, kind string, title string, text string")
    rows = {r.doc_id: r for r in E.outlines(df).collect()}
    assert (rows[1].title, rows[1].headings, rows[1].gap_ids, rows[1].external_id, rows[1].status) == ("Title here", "Title here | One | Two | deep", "APP-KG-001", "APP-1", "draft")
    assert (rows[2].title, rows[2].headings, rows[3].external_id, rows[4].title) == ("", "", None, "")
    parts = [(r.section_no, r.heading, r.section) for r in E.sections(df).where("doc_id = 1").orderBy("section_no").collect()]
    assert parts[1:] == [(1, "One", "alpha\n\nbeta\n##Not"), (2, "Two", "### deep")]


def packed(section: str, target: int) -> list[str]:
    if len(section.encode()) <= target:
        return [section]
    out: list[str] = []
    for p in (q.strip() for q in section.split("\n\n")):
        if p and out and len(out[-1].encode()) + len(p.encode()) + 2 <= target:
            out[-1] += "\n\n" + p
        elif p:
            out.append(p)
    return out


def test_packing_equals_a_loop(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = df.selectExpr("-doc_id as doc_id", "kind", "title", "concat_ws('\\n\\n', text, repeat('é', 900), text, repeat('x', 3000), text) as text")
    both = df.select("doc_id", "kind", "title", "text").unionByName(long)
    got = {}
    for r in E.packed_sections(both).orderBy("doc_id", "section_no", "part_no").collect():
        got.setdefault((r.doc_id, r.section_no), []).append(r.chunk)
    expected = {(r.doc_id, r.section_no): packed(r.section, 2048) for r in E.sections(both).collect()}
    assert got == expected
    assert any(len(v) > 1 for v in got.values())
