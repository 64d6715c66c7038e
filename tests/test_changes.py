import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes as C
from lodestone.operators import evolution as V
from lodestone.operators import graph as G
from lodestone.operators import links as L
from lodestone.operators import retrieval as R
from lodestone.plans import catalog
from tests.parity import connect, rows_of, rows_of_sql

DOC = "id string, repo string, path string, kind string, title string, symbol string, external_id string, trust_level string, known_gap_ids array<string>, code_anchors array<string>, related_doc_ids array<string>, related_contracts array<string>, related_anchors array<string>, owner struct<team:string,service:string,domain:string,contact:string>, keywords array<string>, removed_at timestamp, doc_id string"
NOW = datetime.datetime(2024, 1, 1)


def doc(id, kind, path=None, symbol=None, external_id=None, anchors=None, docs=None, contracts=None, wanted=None, trust=None, repo="r", removed=None):
    return (id, repo, path, kind, None, symbol, external_id, trust, ["A-KG-01", None], anchors, docs, contracts, wanted, None, None, removed, "clash")


ROWS = [
    doc("c1", "contract", "docs/contracts/c1.md", external_id="C-1", anchors=["a1", "gone", None], wanted=["AuthLoginService.run", ".odd", None], contracts=["C-2"]),
    doc("c2", "contract", "docs/contracts/c2.md", external_id="C-2", anchors=["a2"], trust="draft", removed=NOW),
    doc("c2", "contract", "docs/contracts/c2.md", external_id="C-2", anchors=["a2"], trust="draft", removed=NOW),
    doc("d1", "adr", "docs/adrs/d1.md", external_id="ADR-1", contracts=["C-1", "", None]),
    doc("a1", "code_anchor", "src/AuthLoginService.py", symbol="AuthLoginService", docs=["c1", "c9"]),
    doc("a2", "code_anchor", "src/Other.py", symbol="Other"),
    doc("t1", "test_anchor", "tests/test_login.py", symbol="AuthLoginServiceIntegrationTest", docs=["d1"]),
    doc("t2", "test_anchor", "tests/other_test.go", symbol="testOtherThing"),
    doc("t3", "test_anchor", "tests/plain.spec.ts"),
    doc(None, "contract"),
]


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


def named(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_evolution(spark, manifest):
    decisions = [(1, "r", ".\\docs\\contracts\\c1.md", NOW), (2, "r", "docs/contracts/c1.md", NOW + datetime.timedelta(1)), (3, None, "docs/contracts/c1.md", NOW), (4, "r", "docs/contracts/c2.md", NOW), (4, "r", "docs/contracts/c2.md", NOW)]
    links = V.evolution_links(manifest, spark.createDataFrame(decisions, "decision_id long, repo string, path string, decided_at timestamp"))
    got = {(r.link_type, r.source, r.target, r.source_type, r.trust_level) for r in links.collect()}
    assert got == {
        ("introduced_in", "C-1", "1", "contract", "confirmed"), ("modified_by", "C-1", "2", "git_mining", "inferred"), ("introduced_in", "C-2", "4", "contract", "draft"),
        ("decided_in", "C-1", "ADR-1", "adr", "accepted"), ("validated_by", "C-1", "AuthLoginServiceIntegrationTest", "test_anchor", "implementation"),
    }
    traced = {(r.needle, r.link_type, r.trust_class) for r in V.evolution_trace(links, named(spark, "needle", " C-2 ", "ADR-1", "", None, "2")).collect()}
    assert traced == {("C-2", "introduced_in", "other"), ("ADR-1", "decided_in", "trusted"), ("2", "modified_by", "inferred")}


def test_change_set_counts_all_and_lists_some(spark):
    rows = C.change_set(named(spark, "path", "b.py", "./b.py", "docs/a.MD", "x/docs/tests/t.md", None, "", "c\\test_d.py"), most=3).orderBy("place").collect()
    assert [(r.place, r.path, r.is_code, r.is_doc, r.is_test) for r in rows] == [(1, "b.py", True, False, False), (2, "c/test_d.py", True, False, True), (3, "docs/a.MD", False, True, False)]
    assert {(r.total, r.truncated) for r in rows} == {(4, True)}
    assert [r[0] for r in named(spark, "p", "x/AuthPage.tsx", "authPage.ts", "A.md", None).select(C.class_of_file(F.col("p"))).collect()] == ["AuthPage", None, None, None]
    assert [tuple(r[0]) for r in named(spark, "t", " A1.run", "A1.Run", "a.b", None).select(C.symbol_target(F.col("t"))).collect()] == [("A1", "run"), ("A1.Run", None), ("a.b", None), (None, None)]


def test_contracts_of_symbols(spark, manifest):
    got = {tuple(r) for r in C.contracts_of_symbols(named(spark, "symbol", "AuthLoginService", "Other", "Other", "None", None, ""), manifest).collect()}
    assert got == {("AuthLoginService", "c1", True, True), ("Other", "c2", False, True)}


def test_documents_of_changed_tests(spark, manifest):
    changed = named(spark, "path", "app/tests/test_login.py", "tests/other_test.go", "docs/contracts/c2.md", None)
    assert {tuple(r) for r in C.documents_of_tests(changed, manifest).collect()} == {("t1", "d1", True), ("t1", "c1", False)}


def test_findings(spark, manifest):
    rows = [("f1", "C-2", None, "AuthLoginService"), ("f2", None, "contracts/c1.md", None), ("f3", None, None, "r:AuthLoginServices"), ("f4", "nothing", "", ""), ("f1", "C-2", None, "AuthLoginService")]
    findings = spark.createDataFrame(rows, "finding_id string, external_id string, path string, summary string")
    assert {tuple(r) for r in C.documents_of_findings(findings, manifest).collect()} == {("f1", "c2", 1), ("f1", "c1", 3), ("f2", "c1", 2), ("f3", "c1", 3)}
    assert {tuple(r) for r in C.findings_of_symbols(named(spark, "symbol", "authlogin", "thing", None), findings).collect()} == {("authlogin", "f1"), ("authlogin", "f3"), ("thing", "f4")}


def test_labels(spark, manifest):
    tests = spark.createDataFrame([("s", t) for t in ("t1", "t2", "t3", "t3", "gone")], "symbol string, test_id string")
    assert [tuple(r) for r in C.test_labels(tests, manifest).orderBy("place").collect()] == [("s", 1, "AuthLoginServiceIntegrationTest"), ("s", 2, "plain.spec"), ("s", 3, "testOtherThing")]


def test_combined_score_of_tests(spark, manifest, monkeypatch):
    monkeypatch.setattr(L, "symbols_of_seeds", lambda asked, _: asked.join(spark.createDataFrame([("other login", "Other"), ("other login", "AuthLoginService"), ("quiet thing", "Nothing")], "query string, symbol string"), "query"))
    chunks = spark.createDataFrame([("t2#0", "t2", "login")], "chunk_id string, doc_id string, text string")
    primary = spark.createDataFrame([("other login", "AuthLoginService")], "query string, symbol string")
    asked = named(spark, "query", "other login", "quiet thing", "a thing here now")
    run = lambda **how: {(r.query, r.test_id): r.score for r in L.tests_of_queries(asked, manifest, chunks, **how).collect()}
    assert run() == {("other login", "t1"): 2 + 5, ("other login", "t2"): 4 + 5, ("quiet thing", "t2"): 2, ("a thing here now", "t2"): 2}
    assert run(primary=primary, least_tokens=4) == {("other login", "t1"): 2 + 12 + 16, ("other login", "t2"): 4 + 5}
    assert run(primary=primary, require_primary=True, least_tokens=2) == {("other login", "t1"): 30, ("quiet thing", "t2"): 2, ("a thing here now", "t2"): 2}


def test_routes_and_pages(spark):
    text = "import A from '@/pages/admin/UserPage';\nimport b from './x';\n<Route exact path=\"/users\" element={<UserPage />} />\n<Route path='/x' element={<X/>}/>"
    df = spark.createDataFrame([("r", "web/main.tsx", text), ("r", "web/main.tsx", text), ("r", "web/other.tsx", text), ("r", "main.tsx", None)], "repo string, path string, text string")
    assert {tuple(r)[2:] for r in G.structural_edges(df).collect()} == {("UserPage", "/users", "implements_route"), ("X", "/x", "implements_route"), ("main", "UserPage", "imports")}


def test_chunk_lookup_and_gaps(spark, manifest):
    chunks = spark.createDataFrame([("c1#0", "c1", "T", None, "x" * 9000), ("odd", "z", "T", "h", None), ("c1#1", "c1", "T", "h", "y")], "chunk_id string, doc_id string, title string, heading string, text string")
    got = {r.chunk_id: (r.path, len(r.shown), r.truncated) for r in R.chunk_lookup(named(spark, "chunk_id", "c1#0", "c1#0", "odd", "gone#3", None), chunks, manifest).collect()}
    assert got == {"c1#0": ("docs/contracts/c1.md", 8000, True), "odd": (None, 0, False)}
    gaps = R.known_gaps(manifest.distinct())
    assert R.gaps_filtered(gaps, prefix=" a-kg").count() == R.gaps_filtered(gaps, gap_id="a-kg-01 ").count() == gaps.count() == 9 and R.gaps_filtered(gaps, prefix="b").count() == 0


@pytest.mark.parametrize("name", ["tested_by", "inline_links", "test_documents", "graph_edges", "evolution_links"])
def test_parity_where_the_given_tables_hold_nothing(spark, manifest, tmp_path, name):
    rows = [(1, "See [a](x.md#y), ![no](p.png) [b](https://z.org) `[c](d)` [e](#f)\n```\n[g](h)\n```", "k"), (2, None, "k"), (3, "[a](x.md)[a](x.md)", "k")]
    java = "package p;\nimport p.FooService;\n@RestController\nclass A {\n  private final FooService foo;\n}"
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, kind string"),
        "manifest_docs": manifest.union(spark.createDataFrame([doc("t9", "test_anchor", "tests/authloginservice.py", "x", docs=["c1"])], DOC)),
        "search_hits": spark.createDataFrame([(1, "tests/authloginservice.py", True), (2, "app/tests/test_login.py", True), (3, "x", False)], "hit_id long, path string, stale boolean"),
        "source_files": spark.createDataFrame([("r", "A.java", java)], "repo string, path string, text string"),
        "path_decisions": spark.createDataFrame([(1, "r", "docs/contracts/c1.md", NOW)], "decision_id long, repo string, path string, decided_at timestamp"),
    }
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/parts/{table}")
        next(tmp_path.glob(f"parts/{table}/*.parquet")).rename(tmp_path / f"{table}.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    columns, expected = rows_of_sql(connect(str(tmp_path)), catalog.oracle_sql()[name])
    assert sorted(got.columns) == columns and rows_of(got) == expected and expected
