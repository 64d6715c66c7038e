import pytest

from lodestone.operators import context as T
from lodestone.operators import links as L
from lodestone.tables import TableNotFound, table

DOC = "id string, repo string, path string, kind string, symbol string, anchor_type string, external_id string, trust_level string, known_gap_ids array<string>, code_anchors array<string>, owner struct<team:string,service:string,domain:string,contact:string>, query string"


def test_a_missing_table_is_named(spark, tmp_path):
    with pytest.raises(TableNotFound, match="chunks"):
        table(spark, str(tmp_path), "chunks")


def test_belongings(spark):
    rows = [
        ("a", "r", "p", "contract", None, None, "C-1", None, ["G", None, "G"], None, ("", None, "d", "me@x"), "clash"), ("a", "r", "p", "contract", None, None, "C-1", None, ["G", None, "G"], None, ("", None, "d", "me@x"), "clash"),
        ("b", None, None, "doc", None, None, "D-1", None, None, None, None, "clash"),
    ]
    found = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), ("x", "gone"), (None, "a")], "query string, id string")
    got = {tuple(r) for r in T.belongings(found, spark.createDataFrame(rows, DOC), "query").collect()}
    parts = {("gap", "G"), ("owner", "me@x"), ("service", "r"), ("source", "p"), ("contract", "C-1")}
    assert got == {(q, *p) for q in ("q", None) for p in parts}


def test_anchors_of_seeds_keep_few_plain_types(spark):
    names = [f"e{i}" for i in range(4)] + ["s1", "s2", "gone"]
    rows = [("seed1", None, None, "contract", None, None, None, None, None, ["e0", "e1", "e2", None], None, None), ("seed2", None, None, "contract", None, None, None, None, None, ["s1", "e3", "s2", "e0", "gone"], None, None)]
    rows += [(n, "r", "p", "code_anchor", n.upper(), "entity" if n[0] == "e" else "service", None, None, None, None, None, None) for n in names if n != "gone"]
    seeds = spark.createDataFrame([("q", 1, "seed1"), ("q", 2, "seed2")], "query string, seed int, id string")
    got = [r.anchor_id for r in T.anchors_of_seeds(seeds, spark.createDataFrame(rows, DOC)).orderBy("place").collect()]
    assert got == ["e0", "e1", "s1", "s2"]


def test_caps_and_first_contracts(spark):
    rows = [(f"c{i:02}", "r", f"p{i:02}", "contract" if i < 10 else "code_anchor", None, None, None, "confirmed", None, None, None, None) for i in range(14)] + [("z", "r", None, "contract", None, None, None, "draft", None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:3], DOC)
    assert [r.id for r in T.first_contracts(df).orderBy("place").collect()] == [f"c{i:02}" for i in range(8)]
    assert [tuple(r) for r in L.cap_report(df, 3).collect()] == [("r", 4, 3, 1)]
