import datetime as dt

from lodestone.operators.orphans import orphan_references, orphan_report

MANIFEST = "id string, external_id string, symbol string, code_anchors array<string>, related_doc_ids array<string>, related_contracts array<string>, indexed_at timestamp, removed_at timestamp, day string, key string"
STATS = "build_id string, built_at timestamp, unresolved_symbols array<string>, space string"


def at(day: int) -> dt.datetime:
    return dt.datetime(2025, 1 + (day - 1) // 28, 1 + (day - 1) % 28, 12)


def record(id_, begins, ends=None, external=None, symbol=None, anchors=None, docs=None, contracts=None):
    return (id_, external, symbol, anchors, docs, contracts, at(begins) if begins else None, at(ends) if ends else None, "x", "y")


def found(spark, manifest, stats=()):
    df = orphan_references(spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(list(stats), STATS))
    return {(r.ref_field, r.ref_key, r.target_key): r.reason for r in df.collect()}


def test_missing_deleted_late_and_alive(spark):
    rows = [
        record("a", 10, anchors=["gone", "never", "later", " ALIVE ", "", None, "never", "same\\path"], docs=["ends-now", "begins-now"], contracts=["X-1", "x-2"]),
        record("gone", 1, 5), record("later", 20), record("alive", 1, 15), record("same/path", 3), record("ends-now", 1, 10), record("begins-now", 10), record("c", 2, external="x-1"),
    ]
    assert found(spark, rows) == {
        ("code_anchors", "a", "gone"): "deleted", ("code_anchors", "a", "never"): "missing", ("code_anchors", "a", "later"): "late",
        ("related_doc_ids", "a", "ends-now"): "deleted", ("related_contracts", "a", "x-2"): "missing",
    }


def test_one_of_many_bearers_is_enough(spark):
    rows = [record("a", 10, contracts=["E"]), record("b", 1, 2, external="E"), record("c", 9, external="e "), record("d", 11, external="E")]
    assert found(spark, rows) == {}


def test_symbols_are_named_with_and_without_impl(spark):
    rows = [record("s", 1, symbol="FooImpl"), record("t", 1, 5, symbol="Bar")]
    stats = [("b1", at(9), ["r:Foo", "r:fooimpl ", "r:Bar", "r:FooImplImpl", " ", None], "k"), ("b2", None, ["r:Nope"], "k"), ("b3", at(9), None, "k")]
    assert found(spark, rows, stats) == {("unresolved_symbols", "b1", "r:Bar"): "deleted", ("unresolved_symbols", "b1", "r:FooImplImpl"): "missing"}


def test_redelivered_and_inverted_intervals(spark):
    rows = [record("a", 10, anchors=["w"]), record("a", 10, anchors=["w"]), record("w", 8, 3), record("w", 8, 3)]
    assert found(spark, rows) == {("code_anchors", "a", "w"): "deleted"}


def test_times_of_one_key_across_days(spark):
    rows = [record(f"r{d}", d, docs=["k"]) for d in range(1, 40)] + [record("k", 5, 9), record("K", 20, 30)]
    got = found(spark, rows)
    assert {int(key[1:]): why for (_, key, _), why in got.items()} == {d: "late" if d < 5 else "deleted" for d in range(1, 40) if not (5 <= d < 9 or 20 <= d < 30)}


def test_empty_tables_and_report(spark):
    assert found(spark, []) == {}
    df = orphan_references(spark.createDataFrame([record("a", 1, anchors=["x", "y"])], MANIFEST), spark.createDataFrame([], STATS))
    (row,) = orphan_report(df).collect()
    assert (row.ref_table, row.period, row.reason, row.references, row.records) == ("manifest_docs", "2025-01", "missing", 2, 1)
