import pytest

from lodestone.llm import queries as Q
from tests.parity import DATA, connect, rows_of, rows_of_sql

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    columns, expected = rows_of_sql(connect(), Q.ORACLE[name])
    df = Q.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of the queries that SQL can't state, and of their neighbours."""
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = Q.QUERIES[name](spark, LARGER).collect()
        return kept[name]

    return of


def keys(rows, *columns):
    return {tuple(r[c] for c in columns) for r in rows}


def given(column, name="documents", where="true"):
    return [r[0] for r in connect(LARGER).sql(f"select {column} from {name} where {where}").fetchall()]


def test_files(rows):
    found = rows("p1_found")
    assert found and len(found) == len(keys(found, "repo", "path")) == sum(r.n_files for r in rows("p1_reasons"))
    assert {r.reason for r in rows("p1_reasons")} <= {"generated", "minified", "data", "vendored"}
    assert keys(found, "repo") >= keys(rows("p1_decisions"), "repo") and set(given("decision_id", "path_decisions")) >= {r.decision_id for r in rows("p1_decisions")}


def test_pieces(rows):
    pieces = rows("p5_pieces")
    assert keys(pieces, "chunk_id") == keys(rows("p5_found"), "chunk_id") and pieces
    assert keys(rows("p5_snippets"), "chunk_id", "piece_no") <= keys(pieces, "chunk_id", "piece_no") and rows("p5_snippets")


def test_tokens(rows):
    ids = rows("p6_ids")
    assert sorted(r.doc_id for r in ids) == sorted(given("doc_id"))
    assert sum(len(r.ids) for r in ids) == sum(r.tokens for r in rows("p6_counts")) > 0
    assert {r.doc_id for r in ids if not r.ids} == set(given("doc_id", where="coalesce(text, '') = ''"))


def test_leaked_items(rows):
    found, leaks, cleaned = rows("p7_found"), rows("p7_leaks"), rows("p7_cleaned")
    assert found and keys(found, "doc_id", "item_id") == keys(leaks, "doc_id", "item_id") >= keys(rows("p7_verbatim"), "doc_id", "item_id")
    assert all(r.longest > 0 and 0 < r.coverage <= 1 for r in leaks)
    assert sorted(r.doc_id for r in cleaned) == sorted(given("doc_id")) and {r.doc_id for r in cleaned if r.removed} == {r.doc_id for r in found}


def test_forms(rows):
    forms = rows("p8_forms")
    assert sorted(r.doc_id for r in forms) == sorted(given("doc_id"))
    assert {r.doc_id for r in forms if r.changed} == {r.doc_id for r in rows("p8_found")} != set()


def test_queries_without_sql_have_a_test_here():
    assert set(Q.QUERIES) - set(Q.ORACLE) == {"p1_found", "p1_reasons", "p1_decisions", "p5_pieces", "p5_snippets", "p6_ids", "p6_counts", "p7_found", "p7_leaks", "p7_cleaned", "p8_found", "p8_forms"}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_on_empty_tables(spark, name, tmp_path):
    for table in ("documents", "benchmark", "search_hits", "chunks", "source_files", "path_decisions"):
        df = spark.read.parquet(f"{DATA}/{table}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert Q.QUERIES[name](spark, str(tmp_path)).count() == 0
