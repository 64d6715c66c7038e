import pytest

from lodestone.operators import search as S
from lodestone.tables import table

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("rare", "limit"), [(1000, 10), (5, 3), (0, 1)])
def test_bounds_lose_no_near_record(spark, monkeypatch, rare, limit):
    monkeypatch.setattr(S, "RARE_RECORDS", rare)
    docs = S.numbered(S.records(table(spark, FOLDER, "manifest_docs")), "records")
    asked = table(spark, FOLDER, "search_hits").where("hit_id % 400 = 0").select("query").union(spark.createDataFrame([("code anchor contract service",), ("service",), ("zzz",)], "query string"))
    parsed = S.numbered(S.parsed_queries(asked), "queries")
    matches = S.matched(docs, parsed)
    kth = {}
    every = S.scored(docs, parsed, matches).collect()
    for r in sorted(every, key=lambda r: -r.score):
        kth.setdefault(r.q, []).append(r.score)
    wanted = {(r.q, r.n, r.score) for r in every if r.score >= (kth[r.q][limit - 1] if len(kth[r.q]) >= limit else 0)}
    got = {(r.q, r.n, r.score) for r in S.scored_near(docs, parsed, matches, limit).collect()}
    assert wanted <= got <= {(r.q, r.n, r.score) for r in every} and wanted
    if rare:
        assert len(got) < len(every)


def test_bounds_of_nothing(spark):
    docs = S.numbered(S.records(table(spark, FOLDER, "manifest_docs").limit(0)), "records")
    parsed = S.numbered(S.parsed_queries(spark.createDataFrame([("a query",)], "query string")), "queries")
    assert S.scored_near(docs, parsed, S.matched(docs, parsed), 3).count() == 0
    assert S.search(docs.drop("n"), spark.createDataFrame([(None,)], "query string")).count() == 0
