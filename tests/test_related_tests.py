from lodestone.operators import links as L

MANIFEST = """id string, repo string, path string, kind string, title string, domain string, external_id string, status string, symbol string, anchor_type string,
headings array<string>, keywords array<string>, known_gap_ids array<string>, weight int, trust_level string, code_anchors array<string>"""
CHUNKS = "chunk_id string, doc_id string, title string, heading string, text string"


def record(id_, kind, title=None, symbol=None, anchors=None):
    return (id_, "r", f"{id_}.x", kind, title, None, None, None, symbol, None, [], [], [], 0, None, anchors)


def test_symbols_of_seeds_count(spark):
    manifest = spark.createDataFrame([
        record("c", "contract", "ledger export", anchors=["anchor:r:a.java#LedgerWriter", "anchor:r:a.java#LedgerWriter", "anchor:r:b.java#Other ", "anchor:r:c.java", None]),
        record("d", "adr", "ledger export", anchors=["anchor:r:d.java#NotSeeding"]), record("a", "code_anchor", "ledger (r)", symbol="LedgerReader"), record("e", "code_anchor", "e (r)", symbol="Unasked"),
        record("t1", "test_anchor", symbol="LedgerWriterTest"), record("t2", "test_anchor", "export of the ledger"), record("t3", "test_anchor", symbol="NotSeedingTest"),
        record("t4", "test_anchor", symbol="OtherTest"), record("t5", "test_anchor", symbol="UnaskedTest"),
    ], MANIFEST)
    chunks = spark.createDataFrame([("t4#0", "t4", None, None, "uses LEDGERWRITER and LedgerReader")], CHUNKS)
    asked = spark.createDataFrame([("ledger export",), ("ledger export",), (None,), ("nothing-here",)], "query string")
    assert {(r.query, r.symbol) for r in L.symbols_of_seeds(asked, manifest).collect()} == {("ledger export", s) for s in ("LedgerWriter", "Other", "LedgerReader")}
    got = [tuple(r) for r in L.tests_of_queries(asked, manifest, chunks).orderBy("query", "test_rank").collect()]
    assert got == [("ledger export", 1, "t4", 17), ("ledger export", 2, "t1", 7), ("ledger export", 3, "t2", 4)]


def test_whole_texts_count(spark):
    manifest = spark.createDataFrame([record("a", "code_anchor", symbol="LedgerWriter"), record("t1", "test_anchor"), record("t2", "test_anchor")], MANIFEST)
    long = "filler " * 2000
    chunks = spark.createDataFrame([("t1#0", "t1", None, None, long), ("t1#1", "t1", None, None, long + "LedgerWriter"), ("t2#0", "t2", None, None, "Ledger"), ("t2#1", "t2", None, None, "Writer")], CHUNKS)
    assert [tuple(r) for r in L.tests_of_symbols(manifest, chunks).collect()] == [("LedgerWriter", 1, "t1", 24)]
    got = L.tests_of_queries(spark.createDataFrame([("ledgerwriter",)], "query string"), manifest, chunks).collect()
    assert [tuple(r) for r in got] == [("ledgerwriter", 1, "t1", 7)]
